"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.plans.scratch import save


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); a component is named by its least node.

    Each round hooks every node to its least neighbour, follows the hooks four steps up, and contracts the edges
    to what they reached; the number of rounds grows with the logarithm of the nodes at most. Rounds are written,
    so a lost executor costs one step. Minima are taken before shuffles, and nothing is collected.
    """
    edges = save(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    reached = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        hooks = save(hooks, f"{name}-hooks")
        up = hooks
        for _ in range(2):
            step = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            up = up.join(step, "to").select("node", F.col("next").alias("to"))
        up = save(up, f"{name}-up")
        at = lambda c: up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        moved = edges.join(at("a"), "a").select("a_to", "b").join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        # A node reached that is itself hooked keeps that hook as an edge.
        rest = up.select(F.col("to").alias("node")).distinct().join(hooks, "node").select(F.col("node").alias("a"), F.col("to").alias("b"))
        edges = save(moved.unionByName(rest).where("a <> b").distinct(), f"{name}-edges")
        if reached is None:
            reached = up
        else:
            newer = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            reached = save(reached.join(newer, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{name}-reached")
    if reached is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return reached.select("node", F.col("to").alias("component"))
