"""Reading tables so that all cores work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its files split into fewer parts than there are cores.

    Row groups can't be split, so a small table often is one task however many cores there are. A large one has more
    parts than cores and is left as it is: nothing of it is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
