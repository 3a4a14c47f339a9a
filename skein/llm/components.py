"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregate and one join, so no component, hub or edge list is ever
held by one task or the driver; the steps stop when the edges no longer change
(a number of rounds that grows with the logarithm of the longest path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Hang neighbours on the least node around each node."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (least node it can reach) for every node of edges (a, b) that
    isn't least itself. Self-edges and repeated edges are allowed."""
    edges = stash(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        edges = stash(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"the components didn't settle in {rounds} rounds")
