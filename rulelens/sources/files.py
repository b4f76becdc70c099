"""Readers and writers of the file formats the engine meets: rule tables, verses, pages, reports, resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A rule table from CSV with a header; a repeated header row is no rule."""
    rows = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")
    first = rows.columns[0]
    return rows.where(F.trim(F.col(first)) != first)


def rule_set(spark: SparkSession, path: str, schema: str, column: str) -> DataFrame:
    """Distinct trimmed values of a column, empty ones dropped."""
    return rule_rows(spark, path, schema).select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "").distinct()


def rule_map(spark: SparkSession, path: str, schema: str, key: str, value: str, order: str) -> DataFrame:
    """Key and value; of a repeated key the row last in ``order`` counts."""
    return rule_rows(spark, path, schema).groupBy(key).agg(F.max_by(value, order).alias(value))


def verses(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited chapter, verse, text; lines without two numbers are no verse."""
    line = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\|\d+\|"))
    return line.select(F.trim(F.split_part("value", F.lit("|"), F.lit(1))).cast("int").alias("chapter"), F.split_part("value", F.lit("|"), F.lit(2)).cast("int").alias("verse"), F.regexp_extract("value", r"^\s*\d+\|\d+\|(.*)$", 1).alias("text"))


def verse_range(table: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Verses from ``low`` to ``high``, both included, across chapters; a reversed range is an error."""
    if low > high:
        raise ValueError(f"{low} comes after {high}")
    at = F.struct(F.col("chapter"), F.col("verse"))
    return table.where((at >= F.struct(F.lit(low[0]), F.lit(low[1]))) & (at <= F.struct(F.lit(high[0]), F.lit(high[1]))))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def book_pages(spark: SparkSession, path: str) -> DataFrame:
    """Part (from the file's name), page and text, cut at ``/// page N ///``; a file without one is one page."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).cast("int").alias("part"), F.col("value").alias("t"))
    mark = r"/+ *page +(\d+) */+"
    numbers = F.regexp_extract_all("t", F.lit(mark), F.lit(1))
    texts = F.split("t", mark)
    zipped = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("1").alias("page"), F.col("t").alias("raw_text")))).otherwise(F.arrays_zip(numbers.alias("page"), F.slice(texts, 2, F.size(numbers)).alias("raw_text")))
    return whole.select("part", F.explode(zipped).alias("p")).select("part", F.col("p.page").cast("int").alias("page"), F.regexp_replace("p.raw_text", r"^\s+|\s+$", "").alias("raw_text"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sorted_csv(df: DataFrame, path: str, by: list[str]) -> None:
    """CSV with a total order over its files: range-partitioned and sorted, so no task holds the table (K-2)."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").csv(path, header=True)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append rows whose key the folder lacks: a run that broke off is resumed by running it again (K-4, K-5)."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df = df.join(spark.read.schema(df.schema).json(path).select(*key).distinct(), key, "left_anti")
    df.write.mode("append").json(path)
