"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of ``edges`` (``a``, ``b``, any comparable type); the root is the smallest node.

    Large-star and small-star steps in turn, until the edges are stars around their roots: the number of rounds
    grows with the logarithm of the longest path, and no step makes more rows than there are edges. Minima are
    aggregated before the shuffle; a hub's edges are an ordinary skewed join. Each round is a table in the shared
    folder, so a lost executor costs one round. Null ends and loops are left out; an empty table has no nodes.
    """
    # From the larger to the smaller end, once each.
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        now = stage(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(root.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
