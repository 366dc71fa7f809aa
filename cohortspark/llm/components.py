"""Connected components of a stored edge table by alternating stars.

A large-star step links every larger neighbour of a node to the smallest node it knows, a small-star step links a node
and its smaller neighbours to the smallest of them. Only minima per node are gathered, so a node with a third of all
edges costs its shuffle one partial row per task, and joins back are split by adaptive execution. Every step is written
to the shared folder. It ends when a step changes nothing, after a number of steps that grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.common import written as kept


def _sizes(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node. ``written`` stores steps."""
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = written(
        edges.select(pair(F.col("a"), F.col("b")).alias("e")).select("e.a", "e.b").where("a > b").distinct(), "edges")
    before = None
    while (now := _sizes(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.where("a > b"), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "small-star")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
