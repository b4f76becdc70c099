"""Joins whose small side is broadcast only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a few narrow columns is broadcast (some 20 MB).
BROADCAST_ROWS = 200_000
SALTS = 32


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` (one row a key) to ``big``: broadcast if counted at ``limit`` rows at most, else salted.

    ``small`` should be a written table, since it is counted first. Keys must not be null. Past the limit each
    small row is repeated once for each salt and big rows are dealt over the salts, so that a key that holds a
    third of the rows is spread over as many tasks.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.lit(SALTS)).cast("int"))
    return large_join(dealt, salted, [*on, "_salt"], how).drop("_salt")


def large_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the input: dealt by key and merged, no side is sent whole to all tasks.

    Left alone, Spark guesses a written table's size from its compressed files and doesn't count rows that an explode
    adds, so it sends sides of millions of rows through the driver.
    """
    return left.join(right.hint("merge"), on, how)
