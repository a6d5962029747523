"""Connected components of a link table by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hopweave.llm.scratch import Scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node hangs from one centre that hangs from none: then nothing is left to do."""
    if not edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: columns a and b, in any order. Returns (node, component) for every linked node, component the least node.

    A node's neighbours are never gathered: each round takes minima by partial aggregation and joins them back.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small_least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(small_least, "a")
        new = scratch.keep(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        for old in (edges, least, large, small_least):
            scratch.drop(old)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
