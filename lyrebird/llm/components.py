"""Connected components over edge tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.runtime import stage_table


def _least(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours; partial minima go before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v), two bigint columns; component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest one, then every node and its smaller
    neighbours on the smallest of these, until nothing changes; the edges are then stars around the
    smallest nodes. Rounds grow with the logarithm of the graph's size. A node with very many neighbours
    is only ever reduced by a partial minimum and joined, never gathered. Nodes without an edge to another
    node don't show; null ends are dropped; repeated edges and loops do no harm. Only a count and a
    checksum of each round's edges go to the driver; each round is a table in the shared folder.
    """
    edges = stage_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        all_ways = _both_ways(edges)
        large = all_ways.join(_least(all_ways), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u != v").distinct()  # every edge points to a smaller node
        low = _least(large)
        small = large.join(low, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = small.union(low.select("u", F.col("least").alias("v"))).where("u != v").distinct()
        edges = stage_table(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = state
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
