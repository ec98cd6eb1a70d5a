"""Connected components of a link table, by alternating large-star and small-star steps over written tables.

Every step joins two written tables on a node, so a node with very many links is dealt over several tasks by the adaptive
skew join, and minima are pre-aggregated. Nothing but a count and a checksum reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b (long), either order. Returns node, component (its least node) for all nodes that have links."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        # large star: the larger neighbours of a node go to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        forget(edges)
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
