"""Tables written to the shared folder, to cut lineage and to compute a costly column once.

A written table outlives the executors that wrote it, so a lost executor costs a re-read, never a recomputation.
The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and everything runs in
one local process (tests, a laptop) is a temporary folder made. Each application writes to a folder of its own.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The scratch folder of this application."""
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/rulelens-{app}"
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="rulelens-"))
    return f"file://{_own[0]}/{app}"


def place(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, no other's; call it when their results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    while _own:
        shutil.rmtree(_own.pop(), ignore_errors=True)
