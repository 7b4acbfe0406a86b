"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (partially aggregated before the shuffle) joined back to the edges, so a node with very many
neighbours is an ordinary skewed join and no neighbour list is ever held. Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (u, v); nodes without an edge are not listed.

    Self-edges, repeated edges and either direction are allowed; nulls are dropped; an empty table gives an empty result.
    """
    stars = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpoint(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct())
        after = _digest(stars)
        if after == before:
            break
        before = after
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select("root", "root").toDF("node", "root").distinct())
