"""Connected components by alternating large-star and small-star steps on an edge table.

Each step joins the edges with one minimum per node, so no node's neighbours meet in one task and nothing but a yes or no
reaches the driver. The steps end after O(log^2 n) rounds, in practice one or two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u, v) of longs, u > v, distinct -> written table (node, root) of each node that isn't its component's smallest."""
    now = scratch.write(edges.select("u", "v"))
    while not _is_forest_of_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(small)
        scratch.drop(large)
        scratch.drop(now)
        now = after
    out = now.withColumnsRenamed({"u": "node", "v": "root"})
    out._scratch_path = now._scratch_path
    return out


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node but a smallest one has one edge, which leads to a smallest one."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    onward = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return twice.union(onward).isEmpty()
