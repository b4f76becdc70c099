"""Queries of the scalar functions over the tables that have what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import scalars as fn
from rulelens.operators.tokens import W18, w18_number_runs
from rulelens.plans.reading import spread, table


def x31_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties with its type as canonical JSON, sealed."""
    e = spread(table(spark, sf_dir, "events"))
    m = F.map_concat(F.from_json(F.coalesce("props", F.lit("{}")), "map<string,string>"), F.create_map(F.lit("event_type"), F.coalesce("event_type", F.lit("")), F.lit("a.b"), F.lit('q"')))
    e = e.select("event_id", m.alias("m"))
    return e.select("event_id", fn.canonical_json(F.col("m")).alias("canonical"), fn.seal(fn.canonical_json(F.col("m"))).alias("seal"), fn.level_digest(fn.canonical_json(F.col("m"))).alias("level"), fn.attribute(F.col("m"), "k", "none").alias("k"), fn.attribute(F.col("m"), "absent", "none").alias("absent"))


def x24_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly each user's events spread over types, in bits."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    each = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("n").cast("double"))).alias("counts"))
    return each.select("user_id", F.size("counts").alias("types"), F.abs(F.round(fn.entropy(F.col("counts")), 6)).alias("bits"))


def x25_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each run of numbers and how a counted word agrees with it (X25, X26). Parts of more than nine digits are no counts."""
    parts = F.filter(F.split("digits", " "), lambda x: F.length(x) <= 9)
    runs = w18_number_runs(spark, sf_dir).withColumn("value", fn.number_value(parts))
    return runs.select("doc_id", "sent_idx", "start", "value", fn.agreement_band(F.col("value")).alias("band"))


X31 = """WITH m AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
c AS (SELECT event_id, k, '{"a.b":"q\\\\"",' || '"event_type":"' || coalesce(event_type, '') || '"' || CASE WHEN k IS NOT NULL THEN ',"k":"' || k || '"' ELSE '' END || '}' AS canonical FROM m)
SELECT event_id, canonical, 'sha256:' || sha256(canonical) AS seal, left(sha256(canonical), 6) AS level, coalesce(k, 'none') AS k, 'none' AS absent FROM c""".replace("\\\\", "\\")
X24 = """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, count(*)::INT AS types, abs(round(sum(-(n / total) * log2(n / total)), 6)) AS bits FROM t GROUP BY user_id"""
X25 = f"""WITH r AS ({W18}), v AS (SELECT doc_id, sent_idx, start, coalesce(list_sum(list_transform(list_filter(string_split(digits, ' '), lambda x: length(x) <= 9), lambda x: x::BIGINT)), 0)::BIGINT AS value FROM r)
SELECT *, CASE WHEN value = 0 THEN 'zero' WHEN value = 1 THEN 'singular' WHEN value = 2 THEN 'dual' WHEN value <= 10 THEN 'plural_genitive' WHEN value <= 99 THEN 'singular_accusative' WHEN value % 100 = 0 THEN 'singular_genitive' WHEN value % 100 BETWEEN 3 AND 10 THEN 'plural_genitive' WHEN value % 100 BETWEEN 11 AND 99 THEN 'singular_accusative' ELSE 'singular_genitive' END AS band FROM v"""

QUERIES = {"x31_seals": x31_seals, "x24_entropy": x24_entropy, "x25_numbers": x25_numbers}
ORACLE = {"x31_seals": X31, "x24_entropy": X24, "x25_numbers": X25}
