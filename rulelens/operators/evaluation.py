"""Evaluation: accuracy, confusion, hold-out, drift, boundaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.operators.graph import _EDGES, relations
from rulelens.operators.morphology import M13_SQL, classes
from rulelens.plans.joins import checked_join
from rulelens.sources.analysed import sentences
from rulelens.sources.readings import READINGS_SQL, read_words

#: A plain prediction to measure: marked words make a text poor, insults make it toxic.
POOR, INSULTS = r"[#*$%&|]{2,}|!!", r"(?i)\b(idiot|stupid|moron|loser|pathetic|worthless|trash|scum|clown|disgusting)\b"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels of documents beside predictions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    seen = docs.select("doc_id", "lang", "source", (~F.col("text").rlike(POOR)).cast("int").alias("p_quality"), F.col("text").rlike(INSULTS).cast("int").alias("p_toxic"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").join(seen, "doc_id")


_P = f"p AS (SELECT l.*, lang, source, (NOT regexp_matches(coalesce(text, ''), '{POOR}'))::INT AS p_quality, regexp_matches(coalesce(text, ''), '{INSULTS}')::INT AS p_toxic FROM labels l JOIN documents d USING (doc_id))"


def a15_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts with shares of their gold class, one row per metric and pair."""
    p = predictions(spark, sf_dir)
    long = p.select(F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").alias("gold"), F.col("p_quality").alias("said")), F.struct(F.lit("toxic").alias("metric"), F.col("toxic").alias("gold"), F.col("p_toxic").alias("said")))).alias("x")).select("x.*")
    c = long.groupBy("metric", "gold", "said").agg(F.count("*").alias("n"))
    totals = c.groupBy("metric", "gold").agg(F.sum("n").alias("of"))
    return c.join(totals, ["metric", "gold"]).withColumn("share", F.round(F.col("n") / F.col("of"), 6))


A15 = f"WITH {_P}, l AS (SELECT 'quality' AS metric, quality AS gold, p_quality AS said FROM p UNION ALL SELECT 'toxic', toxic, p_toxic FROM p), c AS (SELECT metric, gold, said, count(*) AS n FROM l GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY metric, gold))::BIGINT AS of, round(n / sum(n) OVER (PARTITION BY metric, gold), 6) AS share FROM c"


def a17_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on the three sixteenths of documents held out by digest, by language and whether their source was seen."""
    p = predictions(spark, sf_dir).withColumn("held", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2"))
    sources = p.where("not held and source is not null").select("source").distinct().withColumn("seen", F.lit(True))
    h = p.where("held").join(sources, "source", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return h.groupBy("lang", "seen").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("p_quality")).cast("double")), 6).alias("quality_accuracy"), F.round(F.avg((F.col("toxic") == F.col("p_toxic")).cast("double")), 6).alias("toxic_accuracy"))


A17 = f"WITH {_P}, h AS (SELECT *, substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2') AS held FROM p), s AS (SELECT DISTINCT source FROM h WHERE NOT held) SELECT lang, s.source IS NOT NULL AS seen, count(*) AS n, round(avg((quality = p_quality)::INT), 6) AS quality_accuracy, round(avg((toxic = p_toxic)::INT), 6) AS toxic_accuracy FROM h LEFT JOIN s USING (source) WHERE held GROUP BY ALL"


def a21_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of even documents as the baseline against odd ones, with a tolerance (A21: full outer join)."""
    p = predictions(spark, sf_dir).withColumn("run", F.pmod("doc_id", F.lit(2)))
    by = p.groupBy("run", "lang").agg(F.avg((F.col("quality") == F.col("p_quality")).cast("double")).alias("accuracy"))
    old, new = by.where("run = 0").select("lang", F.col("accuracy").alias("before")), by.where("run = 1").select("lang", F.col("accuracy").alias("after"))
    j = old.join(new, "lang", "full")
    return j.select("lang", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.coalesce(F.abs(F.col("after") - F.col("before")) > 0.02, F.lit(True)).alias("drifts"))


A21 = f"WITH {_P}, b AS (SELECT doc_id % 2 AS run, lang, avg((quality = p_quality)::INT) AS accuracy FROM p GROUP BY ALL) SELECT lang, round(o.accuracy, 6) AS before, round(n.accuracy, 6) AS after, coalesce(abs(n.accuracy - o.accuracy) > 0.02, true) AS drifts FROM (SELECT * FROM b WHERE run = 0) o FULL JOIN (SELECT * FROM b WHERE run = 1) n USING (lang)"


def a24_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of line ends predicted by full stops, per language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.coalesce("text", F.lit("")).alias("t"))
    n = lambda r: F.size(F.regexp_extract_all("t", F.lit(r), F.lit(0)))
    c = docs.groupBy("lang").agg(F.sum(n(r"\.\n")).alias("tp"), F.sum(n(r"\. ")).alias("fp"), F.sum(n(r"[^.\n]\n")).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return c.select("lang", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


A24 = r"WITH c AS (SELECT lang, sum(len(regexp_extract_all(coalesce(text, ''), '\.\n')))::BIGINT AS tp, sum(len(regexp_extract_all(coalesce(text, ''), '\. ')))::BIGINT AS fp, sum(len(regexp_extract_all(coalesce(text, ''), '[^.\n]\n')))::BIGINT AS fn FROM documents GROUP BY lang), r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT lang, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM r"


def a13_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length bucket and language with all totals in one pass (A13, A27 as a roll-up of documents)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("bucket", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 4000, "middle").otherwise("long"))
    r = d.rollup("lang", "bucket").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))
    return r.select("lang", "bucket", "n", "chars", F.col("level").cast("int").alias("level"))


A13 = "SELECT lang, bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(lang, bucket)::INT AS level FROM (SELECT *, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END AS bucket FROM documents) GROUP BY ROLLUP (lang, bucket)"


def f43_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies by kind with one example each (of documents; the gates and sweeps tell those of words)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kinds = F.array_compact(F.array(F.when(F.col("t").rlike("!!"), "shouting"), F.when(F.col("t").rlike(r"[#*$%&]{3}"), "marked"), F.when(F.col("t").contains(" | "), "table"), F.when(F.length("t") < 100, "short"), F.when(F.col("t").rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "address")))
    return docs.select("doc_id", F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


F43 = r"WITH k AS (SELECT doc_id, unnest([CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'marked' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN length(coalesce(text, '')) < 100 THEN 'short' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'address' END]) AS kind FROM documents) SELECT kind, count(*) AS n, min(doc_id) AS example FROM k WHERE kind IS NOT NULL GROUP BY kind"

#: Modes of the ablation: the whole evidence, and that without one kind of it.
MODES = {"whole": "marks AND long", "no_marks": "long", "no_length": "marks"}


def a18_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each mode on all labelled documents, and how many the whole mode alone or the mode alone gets right."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = docs.select("doc_id", (~F.col("text").rlike(POOR)).alias("marks"), (F.length("text") >= 400).alias("long"))
    p = spark.read.parquet(f"{sf_dir}/labels.parquet").join(seen, "doc_id").withColumns({m: (F.expr(said).cast("int") == F.col("quality")) for m, said in MODES.items()})
    long = p.select("whole", F.explode(F.create_map(*[x for m in MODES for x in (F.lit(m), F.col(m))])).alias("mode", "right"))
    n = lambda holds: F.count(F.when(holds, 1))
    c = long.groupBy("mode").agg(F.count("right").alias("n"), n(F.col("right")).alias("correct"), n(F.col("whole") & ~F.col("right")).alias("lost"), n(~F.col("whole") & F.col("right")).alias("won"))
    return c.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6))


A18 = f"""WITH s AS (SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '{POOR}') AS marks, length(coalesce(text, '')) >= 400 AS long FROM documents),
p AS (SELECT {", ".join(f"({said})::INT = quality AS {m}" for m, said in MODES.items())} FROM labels JOIN s USING (doc_id)),
l AS ({" UNION ALL ".join(f'SELECT whole, \'{m}\' AS mode, p.{m} AS ok FROM p' for m in MODES)})
SELECT mode, count(ok) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (whole AND NOT ok) AS lost, count(*) FILTER (NOT whole AND ok) AS won, round(count(*) FILTER (ok) / count(ok), 6) AS accuracy FROM l GROUP BY mode"""



def a15_word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's classes against those that words were built with: confusion by what decided, held-out words apart.

    Shares are of a true class within its part. A fifth of the words is held out by digest: nothing is fitted, so the parts
    should agree.
    """
    told = read_words(spark, sf_dir).select("id", "word", F.col("class").alias("truth"))
    held = (F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int") % 5 == 0).alias("held_out")
    j = checked_join(told, classes(told).select("word", F.col("class").alias("said"), "source"), ["word"], "inner")
    c = j.groupBy(held, "truth", "said", "source").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("held_out", "truth"))
    return c.withColumn("share", F.round(F.col("n") / whole, 6))


A15_WORDS = f"""WITH told AS (SELECT * FROM (WITH {READINGS_SQL} SELECT id, word, class AS truth FROM readings)), c AS (SELECT ('0x' || substr(md5(word), 1, 4))::INT % 5 = 0 AS held_out, truth, m.class AS said, m.source, count(*) AS n FROM told JOIN ({M13_SQL}) m USING (id) GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY held_out, truth), 6) AS share FROM c"""


def a26_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by name: how many of each proof, their mean distance, and what share of all tokens they leave from."""
    toks = sentences(spark, sf_dir)
    tokens = toks.count()
    e = relations(toks, spark).groupBy("name").agg(
        F.count("*").alias("n"), *[F.sum((F.col("proof") == p).cast("long")).alias(p.lower()) for p in ("Certificate", "Hypothesis", "Zero")], F.round(F.avg("distance"), 6).alias("mean_distance"), F.count_distinct("sent", "source").alias("covered")
    )
    return e.select("name", "n", "certificate", "hypothesis", "zero", "mean_distance", F.round(F.col("covered") / F.lit(tokens), 6).alias("share"))


A26 = f"""WITH {_EDGES}, t AS (SELECT count(*) AS tokens FROM toks) SELECT name, count(*) AS n, count(*) FILTER (proof = 'Certificate') AS certificate, count(*) FILTER (proof = 'Hypothesis') AS hypothesis, count(*) FILTER (proof = 'Zero') AS zero, round(avg(distance), 6) AS mean_distance,
  round(count(DISTINCT (sent, source)) / any_value(tokens), 6) AS share FROM edges, t GROUP BY name"""

QUERIES = {"a18_ablation": a18_ablation, "a15_confusion": a15_confusion, "a17_holdout": a17_holdout, "a21_drift": a21_drift, "a24_boundaries": a24_boundaries, "a13_sweep_rollup": a13_sweep, "f43_anomalies": f43_anomalies, "a15_word_classes": a15_word_classes, "a26_relations": a26_relations}
ORACLE = {"a18_ablation": A18, "a15_confusion": A15, "a17_holdout": A17, "a21_drift": A21, "a24_boundaries": A24, "a13_sweep_rollup": A13, "f43_anomalies": F43, "a15_word_classes": A15_WORDS, "a26_relations": A26}
