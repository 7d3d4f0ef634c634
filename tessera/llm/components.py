"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """node, root (the smallest node reachable) of every node of ``links`` (a, b: long).

    After ``most`` rounds roots may still be several in a component, but never one of two components.

    Minima are written before they are joined, so that a hub's edges can be split between tasks.
    """
    edges = shared.settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, rounds = _mark(edges), 0
    while mark[0]:
        rounds += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = shared.settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = shared.settle(both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = shared.settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, shared.settle(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        shared.discard(before, first, large, least)
        if rounds == most:
            every = edges.unionByName(edges.select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("node"))
            return every.agg(F.min("b").alias("root"))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
