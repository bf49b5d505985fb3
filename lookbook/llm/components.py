"""Connected components of a link table by alternating large-star and small-star rounds.

The edge table never leaves the executors; the driver sees one count and one checksum a round. Each round is two
aggregations (combined before the shuffle) and two equi-joins, whose hub nodes adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Re-hang neighbours on the smallest one: those above the node (large star) or all of those below it (small star)."""
    sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = sides.groupBy("u").agg(F.min("v").alias("low"))
    if both_ways:
        least = least.withColumn("low", F.least("u", "low"))
        return sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    hung = sides.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.union(least.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another node; root is the smallest node of its component.

    Null ends and self-links are ignored, repeated links count once, no links give no rows.
    """
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = cut(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if tuple(state) == before:
            break
        before = tuple(state)
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
