"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """vid, comp: for each end of the edges (a, b) the smallest vertex that it reaches.

    Each turn is a few aggregates and equi-joins of two-column rows, written durably; turns grow with the
    logarithm of the longest path. Loops and repeated edges are allowed; vertices without an edge don't appear.
    """
    now, before = durable(edges.filter("a != b").select("a", "b").distinct()), None
    while True:
        now = durable(_small_star(_large_star(now)).filter("a != b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 32)))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("vid"), F.col("b").alias("comp")).distinct()
    return durable(now.select(F.col("a").alias("vid"), F.col("b").alias("comp")).union(roots))
