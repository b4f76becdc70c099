"""Joins of points with the ranges that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.plans.joins import BROADCAST_ROWS


def interval_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str) -> DataFrame:
    """Each point with every range of equal ``on`` for which start <= point <= end; ranges may overlap and have any length.

    A range is filed under the one or two cells that cover it at the level of its length, a power of two; a point asks one
    cell at each level that some range has, 64 at most. Cells are joined by equality and each pair is checked, so work
    grows with points and matches, never with points times ranges. Nulls and ranges that end before they start match
    nothing. ``ranges`` should be a written table: it is read for its levels and its size.
    """
    ranges = ranges.where(F.col(start) <= F.col(end)).withColumn("_level", F.ceil(F.log2(F.col(end).cast("long") - F.col(start).cast("long") + 1)).cast("int"))
    levels = sorted(r[0] for r in ranges.select("_level").distinct().collect())  # 64 at most
    cell = lambda x, level: F.expr(f"shiftright(cast({x} as bigint), {level})")
    filed = ranges.withColumn("_cell", F.explode(F.sequence(cell(start, "_level"), cell(end, "_level"))))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", cell(point, "_level"))
    side = F.broadcast(filed) if filed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else filed
    return asked.join(side, [*on, "_level", "_cell"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_level", "_cell")


def first_range(joined: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """For each point (``keys``) the first of its ranges by ``order``, and how many hold it."""
    return joined.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_first"), F.count("*").alias("n_ranges")).select(*keys, "_first.*", "n_ranges")
