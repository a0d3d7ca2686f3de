"""Connected components by alternating large-star and small-star steps; every step is an aggregate and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.llm.storage import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the larger (or the smaller) neighbours of every node at the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    if not large:
        both = edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))
    lowest = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("root"))
    moved = both.where(F.col("hi") > F.col("lo")) if large else both
    moved = moved.join(lowest, "lo").select("root", F.col("hi").alias("node"))
    if not large:
        moved = moved.unionByName(lowest.select("root", F.col("lo").alias("node")))
    return moved.where(F.col("root") != F.col("node")).select(
        F.least("root", "node").alias("lo"), F.greatest("root", "node").alias("hi")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge to another: root is the smallest node of its component.

    Nodes are whole numbers; edges with a null end or equal ends are ignored, repeated ones count once. Hot nodes are
    fine: minima combine before the shuffle and the joins can be split. No edges give no rows.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    edges, before = checkpoint(edges.where(F.col("lo") != F.col("hi")).distinct()), None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = tuple(seen)
        edges = checkpoint(_star(_star(edges, large=True), large=False))
