"""Pairs of similar sets and rating vectors: exact Jaccard, MinHash with banding, Pearson."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .meeting import PRIME, WHOLE, Meetings, multipliers

MOST_BANDS = 128  # of one row each, that are told along with the meetings


def sized(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """The distinct rows of key and item, with n: how many there are of the key."""
    one = pairs.select(key, item).repartition(key).distinct()
    return one.withColumn("n", F.count("*").over(W.partitionBy(key)))


def overlaps(pairs: DataFrame, key: str, item: str, at_least: int = 1) -> DataFrame:
    """a, b (a < b), common: keys that share at_least items. Only co-occurring pairs arise; those of hot items are dealt out too."""
    met = Meetings(pairs.select(key, item).distinct(), key, item).pairs(lambda row: row["n"] >= at_least)
    return met.select("a", "b", F.col("n").alias("common"))


def jaccard(pairs: DataFrame, key: str, item: str, at_least: float) -> DataFrame:
    """a, b, sim of all pairs of keys with sim >= at_least. The sizes of both sets come along with their items."""
    met = Meetings(sized(pairs, key, item), key, item, "n").pairs(lambda row: row["n"] / (row["x"] + row["y"] - row["n"]) >= at_least)
    return met.select("a", "b", F.expr("cast(n as double) / (x + y - n)").alias("sim"))


def minhashes(n: int, item: Column, p: int = PRIME) -> list[Column]:
    """n aggregates: the smallest of (a_i * h + b_i) mod p over a set's items, h a hash of the item below p."""
    h = F.pmod(F.xxhash64(item), F.lit(p))
    return [F.min(F.pmod(h * a + b, F.lit(p))).alias(f"h{i}") for i, (a, b) in enumerate(multipliers(n, p))]


def lsh_candidates(pairs: DataFrame, key: str, item: str, bands: int = 40, rows_per_band: int = 2, matches: int = 1) -> DataFrame:
    """a, b (a < b): keys that agree in all rows of at least `matches` bands of their MinHash signature."""
    signature = pairs.groupBy(key).agg(*minhashes(bands * rows_per_band, F.col(item)))
    band = [F.xxhash64(F.lit(i), *(f"h{i * rows_per_band + r}" for r in range(rows_per_band))) for i in range(bands)]
    buckets = signature.select(F.col(key).alias("key"), F.explode(F.array(*band)).alias("bucket"))
    return Meetings(buckets, "key", "bucket").pairs(lambda row: row["n"] >= matches).select("a", "b")


def with_common(pairs: DataFrame, candidates: DataFrame, key: str, item: str) -> DataFrame:
    """candidates (a, b) with na, nb, common: the sizes of both sets of items and of what they share. Sets meet whole, a row for each key."""
    sets = durable(pairs.groupBy(key).agg(F.collect_set(item).alias("items")))
    side = lambda c: sets.select(F.col(key).alias(c), F.col("items").alias(f"i{c}"))
    met = candidates.join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", F.size("ia").alias("na"), F.size("ib").alias("nb"), F.size(F.array_intersect("ia", "ib")).alias("common"))


def lsh_jaccard(pairs: DataFrame, key: str, item: str, at_least: float, bands: int = 40, rows_per_band: int = 2, matches: int = 1) -> DataFrame:
    """LSH candidates confirmed by their exact Jaccard similarity: a subset of `jaccard`."""
    sim = F.expr("common / (na + nb - common)").alias("sim")
    if rows_per_band > 1 or bands > MOST_BANDS:
        return with_common(pairs, lsh_candidates(pairs, key, item, bands, rows_per_band, matches), key, item).select("a", "b", sim).filter(F.col("sim") >= at_least)
    one = Meetings(pairs, key, item, bands=bands, unique=True)

    def near(row):
        large = (row["x"] > WHOLE) | (row["y"] > WHOLE)
        return (row["met"] >= matches) & (large | (row["n"] / (row["x"] + row["y"] - row["n"]) >= at_least))

    met = one.pairs(near).select("a", "b", F.col("x").cast("int").alias("na"), F.col("y").cast("int").alias("nb"), F.col("n").alias("common"))
    if one.left_out:
        large = (F.col("na") > WHOLE) | (F.col("nb") > WHOLE)
        met = met.filter(~large).unionByName(with_common(pairs, met.filter(large).select("a", "b"), key, item))
    return met.select("a", "b", sim).filter(F.col("sim") >= at_least)


def lsh_pearson(ratings: DataFrame, key: str, by: str, min_common: int, default: float | None, bands: int, rows_per_band: int, matches: int) -> DataFrame:
    """`pearson` of the pairs that LSH finds and that share min_common raters: a subset of its rows. MinHash and sums come from the same meetings."""
    confirmed = lambda met: with_common(ratings, met, key, by).filter(F.col("common") >= min_common).select("a", "b")
    if rows_per_band > 1 or bands > MOST_BANDS:
        return pearson(ratings, key, by, min_common, default, candidates=confirmed(lsh_candidates(ratings, key, by, bands, rows_per_band, matches)))
    one = Meetings(ratings, key, by, "stars", bands=bands)
    least = 0 if one.left_out else min_common
    found = one.pairs(lambda row: (row["met"] >= matches) & (row["n"] >= least), sums=True)
    if not one.left_out:
        return _correlated(found, default)
    large = ratings.filter(F.col(by).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > WHOLE).select(key)
    whole = found.join(large.withColumnRenamed(key, "a"), "a", "left_anti").join(large.withColumnRenamed(key, "b"), "b", "left_anti")
    rest = found.join(whole, ["a", "b"], "left_anti").select("a", "b")
    return _correlated(whole.filter(F.col("n") >= min_common), default).unionByName(pearson(ratings, key, by, min_common, default, candidates=confirmed(rest)))


def pearson(ratings: DataFrame, key: str, by: str, min_common: int = 3, default: float | None = 1.0, rated: str = "stars", candidates: DataFrame | None = None) -> DataFrame:
    """a, b, n, sim: Pearson correlation over the common raters of two keys; `default` where variance or covariance is zero.

    All sums come from the meetings of the keys at their raters. With `candidates` (a, b), as `lsh_candidates` gives them,
    only those pairs meet, so that a rater of very many keys makes no more work than they ask for.
    """
    if candidates is None:
        given = ratings.withColumn("_given", F.col(rated).isNotNull().cast("bigint"))
        s = Meetings(given, key, by, rated, ("_given",)).pairs(lambda row: row["n"] >= min_common, sums=True)
        return _correlated(s.withColumn("sxy", F.when(F.col("met") > 0, F.col("sxy"))), default)
    left = ratings.select(F.col(by).alias("by"), F.col(key).alias("a"), F.col(rated).alias("x"))
    right = left.select("by", F.col("a").alias("b"), F.col("x").alias("y"))
    s = left.join(candidates, "a").join(right, ["b", "by"]).groupBy("a", "b").agg(
        F.count("*").alias("n"), *(F.sum(e).alias(c) for c, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxy", F.col("x") * F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y"))))
    )
    return _correlated(s.filter(F.col("n") >= min_common), default)


def _correlated(s: DataFrame, default: float | None) -> DataFrame:
    """a, b, n, sim of the sums over each pair's common raters."""
    top = F.expr("n * sxy - sx * sy")
    low = F.expr("sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)")
    sim = F.when((low > 0) & (top != 0), top / F.nullif(low, F.lit(0.0)))
    return s.select("a", "b", "n", (F.coalesce(sim, F.lit(float(default))) if default is not None else sim).alias("sim"))


def neighbours(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """node, neighbour, sim, rank: of pairs (a, b, sim) the others that each side has, most alike first, then by name; the first n, if given."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "sim").union(pairs.select("b", "a", "sim"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "neighbour")))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)
