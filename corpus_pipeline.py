"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, encoding.

Each stage takes what the stage before wrote and its decisions take effect: documents that the quality rules reject
and lines above their limits go; of each group of near duplicates (five words, similarity 0.8) one document stays;
secrets are masked; documents stand in the mix as often as their source's target asks; texts are encoded.

Null and empty texts fail the quality rules and go in the first stage; null sources are a source of their own; repeated
rows are judged alike, and of equal texts one row stays after the second stage; a null doc_id is kept by all stages.
Columns beyond those of ``documents`` pass through all stages but the last, whatever they are called. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulelens.llm import bpe, mixing, quality, secret_ledger, set_join
from rulelens.plans.scratch import save


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return set_join.one_of_each(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: Sketches, redaction and encoding have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"pipeline-{name}")
    return docs
