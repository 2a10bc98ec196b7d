"""Connected components by alternating large and small stars, one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the smallest node of its component.

    Each star takes a minimum per node, combined before the shuffle, and joins it back, so a node
    with very many links is an aggregation and a join Spark can split. The rounds needed grow with the
    logarithm of the longest path. Links of a node to itself and repeated links change nothing.
    """
    edges = store(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = store(large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                      .unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "small")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
