"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated) and a join on the node, so a node with very
many links is split like any skewed join key; the edges of each round are written to the shared
folder. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. One step: links of each node are moved to its smallest neighbour."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u > v")
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link to another; the label is the smallest node."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    while True:
        now = durable(_star(_star(now, True), False), "edges")
        # done when every node has one neighbour below it, which has none
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1")
        if open_.isEmpty():
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionAll(stars.select(F.col("label").alias("node"), "label").distinct())
