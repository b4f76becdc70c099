"""Mixing sources to target weights by hash-threshold histograms.

Every document hashes to 60 bits. Words are summed by (source, leading 12 bits); the running sum over a source's
4,096 buckets finds the one bucket in which its budget ends. Only that bucket's rows are binned again by the next
12 bits, and so on, which gives a threshold per source: a document is taken once more if its hash is at or below
it. Nothing is sorted, the histogram is summed before the shuffle, and one source with a third of all rows costs
no more than its buckets. Thresholds for a smaller budget lie below those for a larger one, so budgets nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.text import column, n_words
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save

#: Bits of the hash binned in a round; five rounds read all 60.
BITS, ROUNDS = 12, 5


def source_targets(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """Targets from one row a source (source, source_size).

    Sources in code-point order, null last, weigh ``cycle`` over and over and share ``share`` of all words by
    weight; no target exceeds ``cap`` times its source's size, and what a capped source leaves is shared anew by
    weight. Capping in order of cap/weight reaches that fixed point in one pass. One row a source goes through
    one task here, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int"))
    weighed = totals.withColumn("weight", turns).withColumn("_most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_most").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = weighed.withColumn("_level", level).withColumn("_place", F.row_number().over(by_ratio))
    free = F.col("_most") >= F.col("weight") * F.col("_level")
    final = F.min(F.when(free, F.struct("_place", "_level"))).over(every)["_level"]
    target = F.coalesce(F.least(F.col("_most").cast("double"), F.col("weight") * final), F.col("_most").cast("double"))
    return levelled.select("source", "source_size", target.alias("target"))


def hash60(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns; it can be computed in any SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 1, 15), 16, 10).cast("long")


def _boundary(rows: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """For each source the bucket in which its budget ends, what is left of the budget there, and its words."""
    hist = rows.groupBy("_source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"))
    running = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket"))
    cut = checked_join(hist.withColumn("running", running), budgets, ["_source"], "inner").where(F.col("running") >= F.col("need"))
    first = F.row_number().over(Window.partitionBy("_source").orderBy("bucket"))
    return cut.withColumn("_first", first).where("_first = 1").select("_source", "bucket", (F.col("need") - (F.col("running") - F.col("words"))).alias("need"), "words", "low", "high")


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def thresholds(sized: DataFrame, cycle: tuple[int, ...], cap: int, share: float) -> DataFrame:
    """One row a source: _source, source_size, target, rounds, and threshold (null: no part round)."""
    totals = sized.groupBy("_source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), cycle, cap, share)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = save(
        targets.withColumn("_source", _named(F.col("source"))).withColumn("rounds", rounds)
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")).drop("source"),
        "mix-plan",
    )
    rows, budgets, found = sized.select("_source", "key", "size"), plan.where("rest > 0").select("_source", F.col("rest").alias("need")), []
    for k in range(1, ROUNDS + 1):
        shift = BITS * (ROUNDS - k)
        edge = save(_boundary(rows, budgets, shift), "mix-edge")
        found.append(edge.where("low = high"))
        budgets = edge.where("low < high").select("_source", "need")
        if k == ROUNDS or budgets.isEmpty():
            break
        inside = edge.where("low < high").select("_source", "bucket")
        rows = save(checked_join(rows, inside, ["_source"], "inner").where(F.shiftright("key", shift) == F.col("bucket")).select("_source", "key", "size"), "mix-inside")
    ends = found[0]
    for x in found[1:]:
        ends = ends.unionByName(x)
    # The boundary hash is taken if that brings the source nearer to its target.
    ends = ends.select("_source", F.when(F.col("need") * 2 >= F.col("words"), F.col("low")).otherwise(F.col("low") - 1).alias("threshold"))
    return save(plan.join(ends, "_source", "left"), "mix-thresholds")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        hash60(F.col(id_col), F.col(text_col)).alias("key"),
    )
    return save(rows.withColumn("_source", _named(F.col("source"))), "mix-sized")


def _copies() -> Column:
    return (F.col("rounds") + F.when(F.col("key") <= F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """How often each document goes into the mix.

    Returns one row per input row: doc_id, size, source_size, target, taken, copies, source and key. ``copies``
    is at most ``cap``. Whole documents are taken, so a source misses its target by half its boundary document
    at most; rows equal in id and text share a hash and are taken or left together. A null source is a source
    of its own; a null or empty text has size 0, never counts and is never taken beyond its source's whole
    rounds; an empty table gives no rows. Other columns are ignored.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan = thresholds(sized, cycle, cap, share)
    return (
        checked_join(sized, plan, ["_source"]).withColumn("copies", _copies())
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "key")
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``mix`` takes it, with its own columns.

    Rows are filtered by their hash and their source's threshold where they are read; no text is shuffled.
    """
    plan = thresholds(_sized(docs, id_col, text_col, source_col), cycle, cap, share).select("_source", "rounds", "threshold")
    aside = F.struct(*[column(c).alias(c) for c in docs.columns]).alias("_doc")  # names of the input can't clash
    keyed = docs.select(aside, hash60(column(id_col), column(text_col)).alias("key"), _named(column(source_col)).alias("_source"))
    columns = [F.col("_doc").getField(c).alias(c) for c in docs.columns]
    dealt = checked_join(keyed, plan, ["_source"], "inner").withColumn("_n", _copies()).where("_n > 0")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals),
levelled AS (
  SELECT *, row_number() OVER r AS place,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighed
  WINDOW r AS (ORDER BY 3 * source_size / weight, source NULLS LAST),
         b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, place) AS level FROM levelled WHERE 3 * source_size >= weight * level),
plan AS (
  SELECT l.source, source_size, coalesce(least((3 * source_size)::DOUBLE, weight * final.level), (3 * source_size)::DOUBLE) AS target
  FROM levelled l, final),
rested AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM plan),
summed AS (
  SELECT s.*, p.source_size, p.target, p.rounds, p.target - p.rounds * p.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, key) AS here
  FROM sized s JOIN rested p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((rounds + CASE WHEN rest > 0 AND (upto < rest OR (upto - here < rest AND 2 * (rest - (upto - here)) >= here AND here > 0)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (rounds + CASE WHEN rest > 0 AND (upto < rest OR (upto - here < rest AND 2 * (rest - (upto - here)) >= here AND here > 0)) THEN 1 ELSE 0 END)::INT AS copies,
       source
FROM summed
"""
