"""Distributed connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself: the larger ones, or the others."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # edges run from larger to smaller
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the component's smallest node.

    Alternates large and small stars until the edges are stars around the smallest nodes. Each round costs a few
    shuffles of at most as many edges as before, needs about log2(nodes) rounds, and is written to the shared
    folder in place of the one before. Nulls and loops are ignored. Joins are by sorting, so no side is gathered at the
    driver. Nothing but a count and a checksum of the edges comes to the driver.
    """
    named = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x <> y")
    edges = staged(named.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    digest = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = edges.agg(*digest).first()
    while before[0]:
        large = staged(_star(edges, True), "large-star")
        small = staged(_star(large, False), "small-star")
        discard(edges, large)
        edges = small
        after = edges.agg(*digest).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
