"""Connected components of links between longs, by alternating stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) for every node that a link (a, b) names, but the roots.

    Each round moves every node's links to its smallest neighbour; rounds grow with the logarithm of the
    longest chain. Nodes with many links are handled by aggregation and join, never gathered. Every round is
    written to the checkpoint folder.
    """
    edges = cut(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        # a > b in every edge; nothing is made distinct before the end of a round, so each step is one exchange
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                            .alias("e")).select("e.a", "e.b")
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(smallest, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.filter("a <> b").distinct())
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that changes with any of them."""
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())
