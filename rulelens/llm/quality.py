"""Quality rules: word, symbol and repetition rules, then cross-document line frequency.

Normalised lines are hashed and counted over the distinct documents of a host: rows with equal texts are one
document, near copies are several, and choosing among those is left to the duplicate stage. Lines above the limit are
removed; a document that loses most of its words is rejected. Rows are reduced to distinct (host, line, text) before
they meet per line, so a line that half a host repeats is spread over its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.text import SPACE, column, let, lower_ascii, words
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save

#: Repeated windows up to which their places are found by lookup; beyond, by sorting all windows.
FEW = 48


def window_hashes(w: Column) -> Column:
    """Hashes of a text's three-word windows, in order."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def _starts_by_lookup(h: Column, repeated: Column) -> Column:
    return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())


def _starts_by_sort(h: Column) -> Column:
    def repeated(p: Column) -> Column:
        same = F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)


def repeat_words(h: Column) -> Column:
    """Words that stand in a window whose hash is in ``h`` twice or more."""

    def covered(repeated: Column) -> Column:
        starts = F.when(F.size(repeated) <= FEW, _starts_by_lookup(h, repeated)).otherwise(_starts_by_sort(h))
        add = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n"))
        total = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), add)["n"]
        return F.when(F.size(repeated) == 0, 0).otherwise(total)

    twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False)))))
    return let(twice, covered)


def normal_line(line: Column) -> Column:
    return lower_ascii(F.trim(F.regexp_replace(line, SPACE, " ")))


def digest(docs: DataFrame, text_col: str, host_col: str, keep: list[str]) -> DataFrame:
    """Base counts and line hashes of each row, beside the columns in ``keep``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = F.transform(lines, lambda x: let(normal_line(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.size(F.split(y, " ")).alias("n"))))
    numbers = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(window_hashes(w), repeat_words).cast("long").alias("n_repeat_words")))
    return docs.select(
        *keep,
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("null")).alias("_host"),
        F.xxhash64(text).alias("_text"),
        numbers.alias("_n"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        counted.alias("_lines"),
    )


def frequent_lines(digests: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(host, line hash) of lines above the limits."""
    each = digests.select("_host", "_text", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_line")).distinct()
    lines = each.groupBy("_host", "_line").agg(F.count("*").alias("texts")).where(F.col("texts") > min_docs)
    texts = digests.select("_host", "_text").distinct()  # before the host, so a hot one is spread
    hosts = save(texts.groupBy("_host").agg(F.count("*").alias("docs")), "quality-hosts")
    return checked_join(lines, hosts, ["_host"], "inner").where(F.col("texts") > F.col("docs") * min_share).select("_host", "_line")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat: int = 50,
    min_docs: int = 20, min_share: float = 0.002, min_left: int = 30, keep_text: bool = False,
) -> DataFrame:
    """The verdict on every row of ``docs``, and the hashes of the lines it loses.

    A document fails the base rules with fewer than ``min_words`` words or more than ``max_repeat`` percent of
    its words in repeated three-word windows. It is depleted if under ``min_left`` percent of its words stand
    outside lines that more than ``min_docs`` distinct texts of its host, and more than ``min_share`` of its
    distinct texts, hold. A null text is an empty one and fails; a null host is a host of its own; repeated rows are
    judged alike and stay repeated; an empty table gives no rows. With ``keep_text`` the input's columns follow
    under ``_doc``.
    """
    kept = [F.col(id_col).alias("doc_id")] + ([F.struct(*[column(c).alias(c) for c in docs.columns]).alias("_doc")] if keep_text else [])
    digests = save(digest(docs, text_col, host_col, kept), "quality-digest")
    digests = digests.withColumns({"n_words": F.col("_n.n_words"), "n_repeat_words": F.col("_n.n_repeat_words")})
    frequent = save(frequent_lines(digests, min_docs, min_share), "quality-lines")
    lost = checked_join(digests.select("_row", "_host", F.explode("_lines").alias("x")).select("_row", "_host", F.col("x.h").alias("_line"), "x.n"), frequent, ["_host", "_line"], "inner")
    lost = lost.groupBy("_row").agg(F.sum("n").alias("lost_words"), F.collect_set("_line").alias("lost_lines"))
    out = digests.join(lost, "_row", "left")
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & (left * 100 >= F.col("n_words") * min_left)).alias("kept"),
        F.coalesce("lost_words", F.lit(0)).cast("long").alias("lost_words"), "lost_lines", *(["_doc"] if keep_text else []),
    )


def clean(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The kept documents without the lines above the limits; columns as in ``docs``."""
    judged = judge(docs, text_col=text_col, keep_text=True, **options).where("kept")
    text = F.col("_doc").getField(text_col)
    stays = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("lost_lines"), F.xxhash64(normal_line(x)))), "\n")
    new = F.when(F.col("lost_lines").isNull(), text).otherwise(stays)
    return judged.select(*[new.alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lost_lines")


# Words, windows and lines are compared as they are, where the job compares their hashes.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
repeated AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
lines AS (
  SELECT r, source, t, line,
         translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS y
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
frequent AS (
  SELECT l.source, y FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, y, docs HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > docs * 0.002),
lost AS (
  SELECT r, sum(len(string_split(l.y, ' '))) AS n
  FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.y = f.y GROUP BY r),
told AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN lost USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM told)
SELECT *, NOT base_failed AND (n_words - lost_words) * 100 >= n_words * 30 AS kept FROM based
"""
