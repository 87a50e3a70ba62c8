"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller and equal) neighbours are linked with its least neighbour instead."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.where("b > a") if large else both.where("b < a")
    linked = near.join(least, "a").select(F.col("b").alias("x"), "m")
    if not large:
        linked = linked.unionByName(least.select(F.col("a").alias("x"), "m"))
    return linked.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for every node of edges (a, b: long). Nulls and loops are left out.

    Every step is a shuffle over links, aggregated map-side; each is written to the shared folder. It ends when the links
    form stars around their least nodes, after a number of steps that grows with the logarithm of the longest chain.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            break
        state, last = sums, now
        now = written(_star(_star(now, True), False), "links")
        discard(last)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
