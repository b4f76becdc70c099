"""Secret scans over an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its content. A ledger holds the pairs of blob and rule
version that have been scanned and, with each span, the rule version that found it. A run scans only the pairs that
the ledger lacks, each distinct blob once however many documents carry it, appends them, and joins the spans of the
rule versions now in force back to all documents. Rule versions that the ledger has never seen lack for every blob,
so their scan needs no join; texts are dealt out only where several rows carry them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.text import column, let
from rulelens.plans.joins import BROADCAST_ROWS, checked_join
from rulelens.plans.scratch import place, save

SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,version:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group that must have ``least`` characters, and texts worth searching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:12]}"


#: Kinds in the order in which they are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}", 0, 24, ("sk_live_",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, ("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, ("eyJ",)),
)
BASE = 3
#: Rows of blobs with spans up to which they are broadcast.
FOUND_ROWS = BROADCAST_ROWS // 4


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule in code points: what lies between matches gives their places."""

    def place(found: Column) -> Column:
        between = F.split(text, rule.pattern, -1)
        held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), held.alias("held"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            span = F.array(F.struct(start.alias("start"), F.lit(rule.version).alias("version"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(F.length(x["held"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out")), step)["out"]
        return F.when(F.size(found) == 0, F.array().cast(FOUND)).otherwise(placed)

    spans = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), place)
    if not rule.needs:
        return spans
    worth = F.contains(text, F.lit(rule.needs[0]))
    for x in rule.needs[1:]:
        worth = worth | F.contains(text, F.lit(x))
    return F.when(worth, spans).otherwise(F.array().cast(FOUND))


def _texts(blobs: DataFrame) -> DataFrame:
    """Each distinct blob once, with its text: those of one row where they stand."""
    copied = save(blobs.groupBy("blob").count().where("count > 1").select("blob"), "secret-copied")
    few = copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = F.broadcast(copied) if few else copied
    single = blobs.join(named, "blob", "left_anti")
    once = blobs.join(named, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    return single.select("blob", "text").unionByName(once)


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _scanned(texts: DataFrame, rules: list[Rule], lacking: Column | None = None) -> DataFrame:
    """Ledger rows: each blob, the rule versions that scanned it (all, or those it was lacking) and what they found."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    due = lambda r, spans: spans if lacking is None else F.when(F.array_contains(lacking, r.version), spans).otherwise(F.array().cast(FOUND))
    found = F.concat(*[due(r, spans_of(F.col("text"), r)) for r in rules])
    return texts.select("blob", (versions if lacking is None else lacking).alias("scanned"), found.alias("found"))


def update(blobs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Append to ``ledger`` the pairs of blob and rule version that it lacks; ``blobs`` has blob and text, repeats too.

    Appending is one Spark job, so a run that breaks off leaves the ledger as it was. Two runs at once may append the
    same pairs; readers take equal pairs as one.
    """
    spark, live = blobs.sparkSession, {r.version: r for r in rules}
    known, texts = _read(spark, ledger), None
    seen = [] if known is None else [r[0] for r in known.select(F.explode("scanned")).distinct().collect()]  # rule versions ever used
    fresh, older = [r for v, r in live.items() if v not in seen], [r for v, r in live.items() if v in seen]
    texts, new = _texts(blobs), []
    if fresh:
        new.append(_scanned(texts, fresh))
    if older:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        due = F.array(*[F.lit(r.version) for r in older])
        lacking = blobs.select("blob").distinct().join(done, "blob", "left")
        lacking = lacking.select("blob", F.array_except(due, F.coalesce("done", F.array().cast("array<string>"))).alias("lacking"))
        lacking = save(lacking.where(F.size("lacking") > 0), "secret-lacking")
        if not lacking.isEmpty():
            new.append(_scanned(checked_join(texts, lacking, ["blob"], "inner"), older, F.col("lacking")))
    if new:
        reduce(DataFrame.unionByName, new).write.option("compression", "zstd").mode("append").parquet(ledger)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans (start, kind: the rule's place in ``rules``, end) of blobs in which rules in force found any."""
    kinds = F.create_map(*[x for r, k in {r.version: k for k, r in reversed(list(enumerate(rules)))}.items() for x in (F.lit(r), F.lit(k))])
    live = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.element_at(kinds, x["version"]).alias("kind"), x["end"].alias("end")))
    rows = ledger.select("blob", F.filter(live, lambda x: x["kind"].isNotNull()).alias("spans")).where(F.size("spans") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """doc_id, blob and spans (start, kind number, end; sorted) of every row of ``docs``.

    ``ledger`` is a Parquet folder, made by the first run; without one, a scratch folder serves this run alone. Rule
    versions are told apart by pattern, group and least length, so a changed rule scans every blob anew, a removed
    one no longer shows, and the order of ``rules`` decides only the numbers of kinds. A null text is the empty blob;
    repeated rows stay repeated and are scanned once; an empty table gives no rows; other columns are ignored,
    whatever they are called. Offsets count code points, ends are exclusive.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    ledger = ledger or place(docs.sparkSession, "secret-ledger")
    update(blobs.select("blob", "text"), ledger, rules)
    known = _read(docs.sparkSession, ledger)
    found = save(findings(known, rules), "secret-found")
    return checked_join(blobs.select("doc_id", "blob"), found, ["blob"], limit=FOUND_ROWS).withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans become one.

    Rows, columns and their order stay, repeated rows and columns of any name included; a null text stays null, an
    empty one empty; an empty table gives no rows. ``id_col`` may hold nulls and repeats: rows are matched by content.
    """
    found = scan(docs, id_col, text_col, **options).where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    found = save(found, "secret-masked")
    text = F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    named = docs.select(F.struct(*[column(c).alias(c) for c in docs.columns]).alias("doc"))
    named = checked_join(named.withColumn("blob", F.unhex(F.sha2(text, 256))), found, ["blob"], limit=FOUND_ROWS)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    masked = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, finish)
    was = lambda c: F.col("doc").getField(c)
    return named.select(*[F.when(F.col("spans").isNull(), was(c)).otherwise(masked).alias(c) if c == text_col else was(c).alias(c) for c in docs.columns])


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the base kinds first, then all; the second scans only the pairs with later kinds."""
    docs, ledger = spark.read.parquet(f"{sf_dir}/documents.parquet"), place(spark, "secret-ledger")
    text = F.coalesce("text", F.lit(""))
    update(docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")), ledger, RULES[:BASE])
    found = scan(docs, ledger=ledger)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(as_text(F.filter("spans", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )


SQL = None
