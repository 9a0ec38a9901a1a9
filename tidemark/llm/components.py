"""Connected components of a link table by alternating stars, each round cut off by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b: neighbours move to the least neighbour.  Least values by
    aggregation and an equi-join, so that a node with very many links is no single group."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("x"), "m")
    if not large:
        out = out.unionByName(least.select(F.col("a").alias("x"), "m"))
    return out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has a link; the root is the least node of its component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges, "edges0")
    mark, k = None, 0
    while True:
        k += 1
        edges = scratch.keep(_star(_star(edges, True), False), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
