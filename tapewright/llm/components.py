"""Connected components of an edge table by alternating large and small stars, each round cut with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.session import cut_lineage


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (u, v), itself included.

    Edges may repeat and run in either direction; an empty table gives an empty one. Each round is a few combining
    aggregates and joins; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        # Stars whose centres are no rays, with one centre a ray: done. Else another round.
        centres = edges.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        if centres.where("n > 1").unionByName(centres.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minimum(both).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _minimum(larger)
        smaller = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(
            smaller.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
