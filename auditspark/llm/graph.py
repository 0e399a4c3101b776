"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's least neighbour, or to the node if that is less."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node itself, is linked to the node's least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return least.select("u", F.col("least").alias("v")).unionAll(moved)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs) that has a partner; root is its component's least node.

    Nodes are never collected: each step is two joins against per-node minima, hubs included (a join's hot key is
    split at run time, minima are aggregated before the exchange).  The number of steps grows with the logarithm of
    a component's diameter.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _size(edges)
    while seen[0]:
        edges = stored(_small(_large(edges)).filter("u <> v").distinct())
        now = _size(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
