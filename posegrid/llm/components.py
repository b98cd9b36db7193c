"""Connected components by alternating star steps, without gathering a group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, settle, shuffled


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(shuffled(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(shuffled(least), "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node of its component.

    Each round is written to the shared folder, and the round before is deleted. Rounds end when the edges are stars around roots; their
    number grows with the logarithm of the longest chain. Only counts reach the driver.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = settle(edges, "edges")
    summary = None
    while True:
        large = settle(_large_star(edges).distinct(), "large-star")
        small = settle(_small_star(large).distinct(), "small-star")
        forget(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == summary or now[0] == 0:
            break
        summary = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a"))).distinct().toDF("node", "root")
