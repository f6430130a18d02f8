"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is a few joins and aggregates over the edges and is written to the shared folder; nothing but two sums per
round reaches the driver. Nodes are longs; the result maps each node that has an edge to the smallest node it reaches.

Contract: edges in either direction, repeated or of a node to itself change nothing, and a node with no other edge isn't in
the result; edges with a null end link nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones, from both directions; small: the lesser ones) are linked to its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b)."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    for _ in range(most):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        now = staged(_star(_star(now, True), False), name)
    raise RuntimeError(f"no fixpoint after {most} rounds")
