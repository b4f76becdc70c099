"""Generators: tokens, sentences, paragraphs, clauses, markers and claims over documents.

A document's tokens stay in its row as an array of sentences, each an array of words. What stands before or after a
token, scopes, runs and clauses are expressions on these arrays, so the only rows shuffled are those of the final sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions.arrays import at, indexed, labelled, let, run_length
from rulelens.plans.reading import spread, table
from rulelens.sources.rules import MARKERS, Table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
_SQL_TOKENS = r"""
sents AS (
  SELECT doc_id, lang, source, u.sentence, u.ord AS sent_idx FROM (SELECT doc_id, lang, source, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents) d,
  LATERAL (SELECT unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS ord) u),
tokens AS (
  SELECT doc_id, lang, source, sent_idx, u.token, u.ord AS pos FROM (SELECT *, list_filter(list_transform(string_split(sentence, ' '), lambda x: lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda x: x <> '') AS l FROM sents) s,
  LATERAL (SELECT unnest(l) AS token, generate_subscripts(l, 1) - 1 AS ord) u)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def sentence_texts(text: Column) -> Column:
    """Text cut at full stops, marks and newlines; blank parts dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def words_of(sentence: Column) -> Column:
    """Lower-case words without edge punctuation: from a part's first letter or digit to its last."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0))


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (…, sent_idx, sentence): blanks squeezed, empty ones dropped."""
    parts = F.transform(sentence_texts(F.col(text)), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("sent_idx", "sentence"))


def tokens(sents: DataFrame) -> DataFrame:
    """Rows (…, sent_idx, pos, token)."""
    return sents.select(*[c for c in sents.columns if c != "sentence"], F.posexplode(words_of(F.col("sentence"))).alias("pos", "token"))


def tokens_of(text: Column) -> Column:
    """A text's sentences, each an array of its words. To unfold it, unfold this, no column of it: that is worked out twice."""
    return F.transform(sentence_texts(text), words_of)


def token_arrays(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sents``, an array of sentences of words, in place of the text."""
    return docs.withColumn("sents", tokens_of(F.col(text))).drop(text)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_arrays(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))


def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, sent_idx, toks)."""
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(tokens_of(F.col("text"))).alias("sent_idx", "toks"))


def found(rows: DataFrame, hits: Column, *columns: str) -> DataFrame:
    """The rows' named columns beside each hit's fields; rows without a hit have none.

    Hits are unfolded as they are worked out. Were they a column first, Spark would test its size before and so work all
    of them out two or three times.
    """
    return rows.select(*columns, F.inline(hits))


def counted_once(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(value, times)`` of each distinct value of an array."""
    return let(values, lambda v: F.transform(F.array_distinct(v), lambda x: body(x, F.size(F.filter(v, lambda y: y == x)))))


def claims(toks: DataFrame, markers: DataFrame) -> DataFrame:
    """Each token with the markers of its language; a proof kind by confidence, Zero where nothing matches."""
    found = toks.join(F.broadcast(markers), (toks.token == markers.form) & (toks.lang == markers.lang), "left").drop(markers.lang)
    kind = F.when(F.col("form").isNull(), "Zero").when((F.col("confidence") >= 0.9) & (F.col("priority") >= 8), "Certificate").otherwise("Hypothesis")
    return found.withColumn("proof", kind)


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_tokens(spark, sf_dir).select("doc_id", "lang", "source", "sent_idx", F.posexplode("toks").alias("pos", "token"))


def g01_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, sentences, distinct tokens and letters of each document that has a token; all within its row."""

    def stats(sents: Column) -> Column:
        last = F.array_max(F.transform(sents, lambda x, i: F.when(F.size(x) > 0, i + 1)))
        return let(F.flatten(sents), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), last.cast("long").alias("n_sentences"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("letters")))

    return document_tokens(spark, sf_dir).select("doc_id", let(F.col("sents"), stats).alias("s")).select("doc_id", "s.*").where("n_tokens > 0")


G01 = f"WITH {_SQL_TOKENS} SELECT doc_id, count(*) AS n_tokens, (max(sent_idx) + 1)::BIGINT AS n_sentences, count(DISTINCT token) AS n_distinct, sum(length(token))::BIGINT AS letters FROM tokens GROUP BY doc_id"


#: Marker forms by language, kind and proof.
_PROOFS: dict[str, dict[tuple[str, str], list[str]]] = {}
for _form, _lang, _kind, _, _priority, _confidence in MARKERS.rows:
    _PROOFS.setdefault(_lang, {}).setdefault((_kind, "Certificate" if _confidence >= 0.9 and _priority >= 8 else "Hypothesis"), []).append(_form)
FORMS = {lang: sorted({f for forms in of.values() for f in forms}) for lang, of in _PROOFS.items()}


def marked(token: Column, lang: Column) -> Column:
    """Whether a token is a marker of its language."""
    return F.coalesce(labelled(token, lang, [(f, g, "marker") for g, forms in FORMS.items() for f in forms]).isNotNull(), F.lit(False))


def claims_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: claims over all documents by language, marker kind and proof. A document counts its own claims."""

    def of_document(words: Column) -> Column:
        said = lambda kind, proof, n: F.struct(F.lit(kind).alias("kind"), F.lit(proof).alias("proof"), n.cast("long").alias("n"))
        out = F.array(said("none", "Zero", F.size(words)))
        for lang, groups in _PROOFS.items():
            rest = said("none", "Zero", F.size(F.filter(words, lambda t: ~t.isin(FORMS[lang]))))  # noqa: B023
            out = F.when(F.col("lang") == lang, F.array(rest, *[said(*g, F.size(F.filter(words, lambda t: t.isin(forms)))) for g, forms in groups.items()])).otherwise(out)  # noqa: B023
        return F.filter(out, lambda x: x["n"] > 0)

    rows = document_tokens(spark, sf_dir).withColumn("told", let(F.flatten("sents"), of_document))
    each = rows.select("lang", F.inline("told"))
    return each.groupBy("lang", "kind", "proof").agg(F.sum("n").alias("n_claims"), F.count("*").alias("n_docs"))


_CLAIMS = "claims AS (SELECT t.*, m.form, m.kind, m.meaning, m.priority, m.confidence, CASE WHEN m.form IS NULL THEN 'Zero' WHEN confidence >= 0.9 AND priority >= 8 THEN 'Certificate' ELSE 'Hypothesis' END AS proof FROM tokens t LEFT JOIN markers m ON t.token = m.form AND t.lang = m.lang)"
CLAIMS_BY_MARKER = f"WITH {MARKERS.sql()}, {_SQL_TOKENS}, {_CLAIMS} SELECT lang, coalesce(kind, 'none') AS kind, proof, count(*) AS n_claims, count(DISTINCT doc_id) AS n_docs FROM claims GROUP BY ALL"


def a14_top_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest markers of each language (a top-k report)."""
    words = document_tokens(spark, sf_dir).select("lang", F.explode(F.filter(F.flatten("sents"), lambda t: marked(t, F.col("lang")))).alias("form"))
    kinds = F.broadcast(MARKERS.frame(spark).select("form", "lang", "kind"))
    c = words.groupBy("lang", "form").count().join(kinds, ["form", "lang"]).groupBy("lang", "form", "kind").agg(F.sum("count").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "form", "kind")
    return c.withColumn("rank", F.row_number().over(best)).where("rank <= 10")


A14 = f"WITH {MARKERS.sql()}, {_SQL_TOKENS}, {_CLAIMS}, c AS (SELECT lang, form, kind, count(*) AS n FROM claims WHERE form IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, form, kind)::INT AS rank FROM c QUALIFY rank <= 10"


def a10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a real claim against all tokens, per document; Zero claims never count (A10, A30). Within the row."""
    numbers = let(F.flatten("sents"), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.filter(w, lambda t: marked(t, F.col("lang")))).cast("long").alias("hits")))
    d = document_tokens(spark, sf_dir).select("doc_id", numbers.alias("c")).select("doc_id", "c.*").where("n > 0")
    return d.select("doc_id", "n", "hits", F.round(100.0 * F.col("hits") / F.col("n"), 4).alias("coverage"), F.when(F.col("hits") == 0, "none").when(F.col("hits") * 4 < F.col("n"), "low").otherwise("covered").alias("status"))


A10 = f"WITH {MARKERS.sql()}, {_SQL_TOKENS}, {_CLAIMS}, t AS (SELECT doc_id, sent_idx, pos, max((proof <> 'Zero')::INT) AS hit FROM claims GROUP BY ALL), d AS (SELECT doc_id, count(*) AS n, sum(hit)::BIGINT AS hits FROM t GROUP BY doc_id) SELECT *, round(100.0 * hits / n, 4) AS coverage, CASE WHEN hits = 0 THEN 'none' WHEN hits * 4 < n THEN 'low' ELSE 'covered' END AS status FROM d"


NEGATIONS = [(r[0], r[1], str(r[5])) for r in MARKERS.rows if r[2] == "negation"]


def d04_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation markers with their scope: the next three tokens of the sentence."""
    hits = indexed(
        F.col("toks"),
        lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.array_join(F.slice("toks", i + 2, F.lit(3)), " ").alias("scope"), labelled(t, F.col("lang"), NEGATIONS).cast("double").alias("confidence")),
        lambda x: x["confidence"].isNotNull(),
    )
    return found(sentence_tokens(spark, sf_dir), hits, "doc_id", "sent_idx")


D04 = f"WITH {MARKERS.sql()}, {_SQL_TOKENS}, s AS (SELECT *, coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' '), '') AS scope FROM tokens) SELECT doc_id, sent_idx, pos, token, scope, confidence FROM s JOIN markers m ON form = token AND m.lang = s.lang AND kind = 'negation'"


#: The kind of a marker form: that of its highest priority, then the last by name.
KINDS = [(*k, max((r[4], r[2]) for r in MARKERS.rows if (r[0], r[1]) == k)[1]) for k in sorted({(r[0], r[1]) for r in MARKERS.rows})]


def kinds_of(toks: Column, lang: Column) -> Column:
    return F.transform(toks, lambda t: labelled(t, lang, KINDS))


def w17_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what stands before and after each marker kind, with a marker within the last three."""

    def around(ks: Column) -> Column:
        near = lambda i: F.exists(F.slice(ks, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda k: k.isNotNull())
        seen = lambda k, i: F.struct(k.alias("kind"), F.coalesce(at(ks, i - 1), F.lit("-")).alias("prev"), F.coalesce(at(ks, i + 1), F.lit("-")).alias("next"), near(i).cast("long").alias("near"))
        return indexed(ks, seen, lambda x: x["kind"].isNotNull())

    rows = found(sentence_tokens(spark, sf_dir), let(kinds_of(F.col("toks"), F.col("lang")), around), "lang")
    return rows.groupBy("lang", "kind", "prev", "next").agg(F.count("*").alias("n"), F.sum("near").alias("n_near"))


W17 = f"WITH {MARKERS.sql()}, {_SQL_TOKENS}, k AS (SELECT form, lang, max(struct_pack(p := priority, k := kind)).k AS kind FROM markers GROUP BY form, lang), t AS (SELECT t.*, k.kind FROM tokens t LEFT JOIN k ON token = form AND t.lang = k.lang), w AS (SELECT *, lag(kind) OVER o AS prev, lead(kind) OVER o AS next, max((kind IS NOT NULL)::INT) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS near FROM t WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY pos)) SELECT lang, kind, coalesce(prev, '-') AS prev, coalesce(next, '-') AS next, count(*) AS n, coalesce(sum(near), 0)::BIGINT AS n_near FROM w WHERE kind IS NOT NULL GROUP BY ALL"


#: Connectives that open a clause, by language; a conditional overrides a connective.
CONNECTIVES = Table("connectives", "form lang type priority", "string string string int", (("and", "en", "coordinate", 1), ("or", "en", "coordinate", 1), ("that", "en", "complement", 2), ("if", "en", "condition", 9), ("et", "fr", "coordinate", 1), ("ou", "fr", "coordinate", 1), ("qui", "fr", "relative", 2), ("que", "fr", "complement", 2), ("und", "de", "coordinate", 1), ("dass", "de", "complement", 2), ("die", "de", "relative", 2), ("y", "es", "coordinate", 1), ("que", "es", "complement", 2), ("se", "es", "condition", 9)))


#: The type that a connective opens: that of its highest priority.
OPENERS = [(*k, max((r[3], r[2]) for r in CONNECTIVES.rows if (r[0], r[1]) == k)[1]) for k in sorted({(r[0], r[1]) for r in CONNECTIVES.rows})]


def clauses(toks: Column, lang: Column) -> Column:
    """Spans (clause, start, end, type, before) of a sentence's tokens, from its start or a connective to the next,
    typed by their first word (G36 to G39, W22)."""

    def spans(types: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(types) - 1), lambda i: (i == 0) | at(types, i).isNotNull())
        kind = lambda ss, k: F.coalesce(at(types, at(ss, k)), F.lit("main"))
        span = lambda ss: lambda s, k: F.struct(k.alias("clause"), s.alias("start"), (F.coalesce(at(ss, k + 1), F.size(types)) - 1).alias("end"), kind(ss, k).alias("type"), F.when(k == 0, "start").otherwise(kind(ss, k - 1)).alias("before"))
        return let(starts, lambda ss: F.transform(ss, span(ss)))

    typed = F.transform(toks, lambda t: labelled(t, lang, OPENERS))
    empty = F.array().cast("array<struct<clause:int,start:int,end:int,type:string,before:string>>")
    return F.when(F.size(toks) > 0, let(typed, spans)).otherwise(empty)


def g36_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = found(sentence_tokens(spark, sf_dir), clauses(F.col("toks"), F.col("lang")), "lang")
    length = F.col("end") - F.col("start") + 1
    return c.groupBy("lang", "type", "before").agg(F.count("*").alias("n"), F.sum(length).alias("n_tokens"), F.max(length).alias("longest"))


_CLAUSES = """best AS (SELECT form, lang, max(struct_pack(p := priority, t := type)).t AS type FROM connectives GROUP BY form, lang),
o AS (SELECT t.*, b.type, (b.type IS NOT NULL OR row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY pos) = 1)::INT AS opens FROM tokens t LEFT JOIN best b ON t.token = b.form AND t.lang = b.lang),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS clause FROM o),
clauses AS (SELECT doc_id, lang, sent_idx, clause, min(pos) AS start, max(pos) AS stop, coalesce(min(struct_pack(p := pos, t := type)).t, 'main') AS type FROM n GROUP BY ALL)"""
G36 = f"WITH {CONNECTIVES.sql()}, {_SQL_TOKENS}, {_CLAUSES}, b AS (SELECT *, coalesce(lag(type) OVER (PARTITION BY doc_id, sent_idx ORDER BY clause), 'start') AS before FROM clauses) SELECT lang, type, before, count(*) AS n, sum(stop - start + 1)::BIGINT AS n_tokens, max(stop - start + 1) AS longest FROM b GROUP BY ALL"


def w12_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each negation, the nearest earlier preposition of its clause (W12, J15: as-of within a scope): one fold."""
    breaks = [r[0] for r in CONNECTIVES.rows if r[2] == "coordinate"]
    kind = lambda t: labelled(t, F.col("lang"), [(r[0], r[1], r[2]) for r in MARKERS.rows if r[2] in ("preposition", "negation")])

    def step(acc: Column, t: Column) -> Column:
        anchor = F.when(t.isin(breaks), F.lit(None).cast("string")).otherwise(acc["anchor"])
        hit = F.array(F.struct(acc["at"].alias("pos"), t.alias("token"), anchor.alias("anchor")))
        return F.struct((acc["at"] + 1).alias("at"), F.when(kind(t) == "preposition", t).otherwise(anchor).alias("anchor"), F.when(kind(t) == "negation", F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("anchor"), F.array().cast("array<struct<pos:int,token:string,anchor:string>>").alias("out"))
    return found(sentence_tokens(spark, sf_dir), F.aggregate("toks", start, step)["out"], "doc_id", "sent_idx")


_BREAKS = ", ".join(f"'{r[0]}'" for r in CONNECTIVES.rows if r[2] == "coordinate")
W12 = f"WITH {MARKERS.sql()}, {_SQL_TOKENS}, t AS (SELECT t.*, kind, sum((token IN ({_BREAKS}))::INT) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos) AS scope FROM tokens t LEFT JOIN markers m ON form = token AND m.lang = t.lang AND kind IN ('preposition', 'negation')), a AS (SELECT *, last_value(CASE WHEN kind = 'preposition' THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_idx, scope ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM t) SELECT doc_id, sent_idx, pos, token, anchor FROM a WHERE kind = 'negation'"


def g06_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph and sentence ids of the claim grid for sentences of ten characters or more."""
    p = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para", "p"))
    s = p.select("doc_id", "para", F.posexplode(F.split("p", r"[.!?]\s+")).alias("sent", "s")).where(F.length(F.trim("s")) >= 10)
    return s.select(F.concat(F.lit("D"), "doc_id", F.lit("_para"), "para", F.lit("_sent"), "sent").alias("claim_id"), F.length(F.trim("s")).alias("n_chars"))


G06 = r"WITH p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS para FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), s AS (SELECT doc_id, para, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent FROM (SELECT doc_id, para, regexp_split_to_array(p, '[.!?]\s+') AS l FROM p)) SELECT 'D' || doc_id || '_para' || para || '_sent' || sent AS claim_id, length(trim(s))::INT AS n_chars FROM s WHERE length(trim(s)) >= 10"


def w18_number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring digit tokens with the token they count."""
    number = lambda t: F.coalesce(t.rlike(r"^[0-9]+$"), F.lit(False))
    toks = F.col("toks")
    starts = indexed(toks, lambda t, i: F.when(number(t) & ~number(at(toks, i - 1)), i), lambda i: i.isNotNull())
    runs = F.transform(starts, lambda i: let(run_length(toks, i, number), lambda n: F.struct(i.alias("start"), n.cast("long").alias("length"), at(toks, i + n).alias("counted"), F.array_join(F.slice(toks, i + 1, n), " ").alias("digits"))))
    return found(sentence_tokens(spark, sf_dir), runs, "doc_id", "sent_idx")


W18 = f"WITH {_SQL_TOKENS}, t AS (SELECT *, lead(token) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos) AS next FROM tokens), r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY pos) AS island FROM t WHERE regexp_matches(token, '^[0-9]+$')) SELECT doc_id, sent_idx, min(pos) AS start, count(*) AS length, arg_max_null(next, pos) AS counted, string_agg(token, ' ' ORDER BY pos) AS digits FROM r GROUP BY doc_id, sent_idx, island"


def d02_speech_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech act of each turn: question by mark or opening word, then exclamation, then statement."""
    text = F.coalesce("text", F.lit(""))
    first = F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))
    act = F.when(text.rlike(r"\?\s*$"), "question").when(first.isin("what", "who", "why", "how", "qui", "que", "wer", "was"), "question_word").when(text.rlike(r"!\s*$"), "exclamation").when(text == "", "none").otherwise("statement")
    kind = F.when(act == "question", "Certificate").when(act == "none", "Zero").otherwise("Hypothesis")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", act.alias("act"), kind.alias("proof"))


D02 = r"WITH a AS (SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '\?\s*$') THEN 'question' WHEN lower(regexp_extract(coalesce(text, ''), '^\s*(\S+)', 1)) IN ('what', 'who', 'why', 'how', 'qui', 'que', 'wer', 'was') THEN 'question_word' WHEN regexp_matches(coalesce(text, ''), '!\s*$') THEN 'exclamation' WHEN coalesce(text, '') = '' THEN 'none' ELSE 'statement' END AS act FROM conversations) SELECT *, CASE WHEN act = 'question' THEN 'Certificate' WHEN act = 'none' THEN 'Zero' ELSE 'Hypothesis' END AS proof FROM a"


def d27_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker and addressee of each turn, the frame it answers, and carried state."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    other = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumns({"parent": other, "depth": F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "next_role": F.lead("role").over(order)})
    return c.select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("next_role", F.lit("audience")).alias("addressee"), "parent", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


D27 = "SELECT conv_id, turn, role AS speaker, coalesce(lead(role) OVER o, 'audience') AS addressee, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent, coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS depth FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)"

QUERIES = {
    "claims_by_marker": claims_by_marker, "g01_token_stats": g01_token_stats, "a14_top_markers": a14_top_markers, "a10_coverage": a10_coverage, "d04_negation_scope": d04_negation, "w17_neighbours": w17_neighbours,
    "g36_clauses": g36_clauses, "w12_scoped_asof": w12_scoped, "g06_claim_grid": g06_paragraphs, "w18_number_runs": w18_number_runs, "d02_speech_act": d02_speech_act, "d27_frames": d27_frames,
}
ORACLE = {
    "claims_by_marker": CLAIMS_BY_MARKER, "g01_token_stats": G01, "a14_top_markers": A14, "a10_coverage": A10, "d04_negation_scope": D04, "w17_neighbours": W17,
    "g36_clauses": G36, "w12_scoped_asof": W12, "g06_claim_grid": G06, "w18_number_runs": W18, "d02_speech_act": D02, "d27_frames": D27,
}
