"""Connected components of a link table, by alternating star contractions.

Every round is two grouped minima and joins back; nothing is collected but the number of nodes that
are not yet leaves or roots of a star. A hot node is a group of a minimum (summed before the
shuffle) and a hot key of a join, which adaptive execution splits. The rounds grow with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.staging import stage


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either the ``u`` of one edge or only a ``v``: stars, and nothing else."""
    ends = F.explode(
        F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")),
            F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")),
        )
    )
    nodes = edges.select(ends.alias("x")).groupBy("x.node")
    sums = nodes.agg(F.sum("x.up").alias("up"), F.sum("x.root").alias("root"))
    return sums.where("up > 1 OR (up > 0 AND root > 0)").count() == 0


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (columns a, b).

    Links of a node to itself and links with nulls are left out; repeated links count once.
    """
    edges = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = stage(edges, "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "stars")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots)
