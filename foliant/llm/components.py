"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, join_weighted, stored


def _with_least(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """edges joined to least (a, m, n), their node's least neighbour; where there are many, nodes with very many edges are split off."""
    return join_weighted(edges, stored(least, "least"), ["a"], "n", "inner") if many else edges.join(least, "a")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, many).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge.

    edges: columns a and b of one orderable type; direction and repeats do not matter, loops are dropped.
    Beyond BROADCAST_ROWS edges, those of a node with very many are split off before they are joined to it; fewer are little for one
    task. Every round is written to the shared folder, so a lost executor costs one round at most. The rounds end when one changes
    nothing; they grow with the logarithm of the longest chain.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(down, "edges")
    before, mark = None, _mark(now)
    while mark != before:
        many = mark[0] > BROADCAST_ROWS
        large = _large_star(now, many)
        now = stored(_small_star(stored(large, "edges") if many else large, many), "edges")
        before, mark = mark, _mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
