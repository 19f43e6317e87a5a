"""Connected components of a table of links by large-star and small-star rounds, on slim rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) in both directions for the large star; with u > v for the small star."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        met = edges.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        met = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return met.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long), in any direction. For each node that has links: node, root (the smallest node it reaches)."""
    down = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last = written(down, "links")
    while True:
        # done when every node has one parent and no parent has a parent: then each star's centre is its least node
        several = last.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        deep = last.select(F.col("v").alias("u")).distinct().join(last, "u", "left_semi")
        if several.isEmpty() and deep.isEmpty():
            return last.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(last.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = last.unionByName(last.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = written(_star(large, False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        remove(last)
        last = new
