"""Connected components of a table of links, computed by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reached) for every end of ``links`` (a long, b long).

    Alternates large-star steps (a node's greater neighbours move to its smallest) and small-star steps (its
    smaller ones do) until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder, and minima are grouped before they meet the links again, so a
    node with very many links only makes a skewed join, which Spark splits.
    """
    spark = links.sparkSession
    edges = common.stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        new = common.stage(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct(), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.drop(spark, edges)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
