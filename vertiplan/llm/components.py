"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, keep, shuffled_anew


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v: every node's neighbours hook on the least of them. Edges may repeat."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = shuffled_anew(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
    linked = both.join(least, "u")
    if large:
        pairs = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return pairs.where("u > v")


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and those it leads to have none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) of longs -> (node, component): the least node reachable, for every
    node with at least one edge to another node; self-loops and null ends are ignored.

    Each step is a grouped minimum and a join on a node, both splittable when one node is hot; the
    number of steps grows with the logarithm of the graph's size. The edges of every step are a
    written table, and only whether they are settled comes to the driver.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not _is_settled(now):
        after = keep(_star(_star(now, True), False).distinct(), name)
        drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
