"""Clustering by summaries: assignment to centres, Lloyd's loop, and BFR over chunks.

A cluster is (id, n, sums, sums of squares); clusters are few, so their summaries live on the driver, while points
stay in DataFrames. Every pass over points is one projection and at most one aggregate with a row per cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable


@dataclass
class Cluster:
    id: int
    n: int
    sums: list[float]
    squares: list[float]

    @property
    def centre(self) -> list[float]:
        return [s / self.n for s in self.sums]

    @property
    def deviations(self) -> list[float]:
        return [max(q / self.n - (s / self.n) ** 2, 0.0) ** 0.5 for s, q in zip(self.sums, self.squares, strict=True)]

    def merged(self, other: Cluster) -> Cluster:
        add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
        return Cluster(self.id, self.n + other.n, add(self.sums, other.sums), add(self.squares, other.squares))


def distance(x: Column, centre: Column, scale: Column) -> Column:
    """Distance with each difference divided by its scale: Euclidean for scales of 1, else diagonal Mahalanobis."""
    terms = F.zip_with(F.zip_with(x, centre, lambda a, b: a - b), scale, lambda a, b: a / b)
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t * t))


def nearest(points: DataFrame, centres: list[tuple[int, list[float], list[float]]]) -> DataFrame:
    """points with near (d, cluster), that of the nearest centre (id, place, scale); ties go to the smallest id. A scale of 0 counts as 1.

    The centres come as one row of one small array, so that the plan's code is the same in each turn of a loop.
    """
    rows = [(i, [float(v) for v in c], [float(v) or 1.0 for v in s]) for i, c, s in centres]
    one = points.sparkSession.createDataFrame([(rows,)], "centres array<struct<id:int,place:array<double>,scale:array<double>>>")
    near = F.array_min(F.transform("centres", lambda c: F.struct(distance(F.col("x"), c["place"], c["scale"]).alias("d"), c["id"].alias("cluster"))))
    return points.join(F.broadcast(one), F.lit(True)).withColumn("near", near).drop("centres")


def assign(points: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """points with cluster, d: the nearest centre and its distance."""
    return nearest(points, [(i, c, [1.0] * len(c)) for i, c in centres]).select(*points.columns, "near.cluster", "near.d")


def assign_within(points: DataFrame, clusters: list[Cluster], dims: int, factor: float = 3.0) -> DataFrame:
    """points with cluster: the nearest by Mahalanobis distance if under factor * sqrt(dims), else -1."""
    if not clusters:
        return points.withColumn("cluster", F.lit(-1))
    near = nearest(points, [(c.id, c.centre, c.deviations) for c in clusters])
    return near.withColumn("cluster", F.when(F.col("near.d") < factor * dims**0.5, F.col("near.cluster")).otherwise(-1)).drop("near")


def summaries(assigned: DataFrame, dims: int) -> list[Cluster]:
    """One aggregate: n, sums and sums of squares for each cluster id from 0."""
    x = [F.col("x")[i] for i in range(dims)]
    rows = assigned.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("s"), F.array(*(F.sum(v * v) for v in x)).alias("q")).collect()
    return sorted((Cluster(r["cluster"], r["n"], list(r["s"]), list(r["q"])) for r in rows), key=lambda c: c.id)


def summary_rows(assigned: DataFrame, dims: int) -> DataFrame:
    """cluster, pos, n, s, q: the same as a DataFrame."""
    each = assigned.select("cluster", F.posexplode("x").alias("pos", "v")).filter(F.col("pos") < dims)
    return each.groupBy("cluster", "pos").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("s"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("q"))


def first_points(points: DataFrame, k: int, seed: int = 7) -> list[tuple[int, list[float]]]:
    """k points by a seeded hash of their id, as first centres."""
    rows = points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(k).collect()
    return [(i, list(r["x"])) for i, r in enumerate(rows)]


def kmeans(points: DataFrame, centres: list[tuple[int, list[float]]], dims: int, tolerance: float = 1e-4, turns: int = 100) -> list[Cluster]:
    """Lloyd's loop from given centres until their squared shifts sum to the tolerance at most; empty clusters go."""
    found: list[Cluster] = []
    for _ in range(turns):
        if not centres:
            return []
        found = summaries(assign(points, centres), dims)
        old = dict(centres)
        shift = sum((a - b) ** 2 for c in found for a, b in zip(c.centre, old[c.id], strict=True))
        centres = [(c.id, c.centre) for c in found]
        if shift <= tolerance:
            break
    return found


@dataclass
class BFR:
    """Discard, compression and retained sets over chunks of points (point_id, x). Call `update` for each chunk, then `result`."""

    k: int
    dims: int
    factor: float = 3.0
    share: float = 0.2  # of the first chunk: the points that found the discard set, the first by `place` or else by a hash of the id
    ds: list[Cluster] = field(default_factory=list)
    cs: list[Cluster] = field(default_factory=list)
    rs: DataFrame | None = None
    parts: list[DataFrame] = field(default_factory=list)  # point_id, store, cluster
    metrics: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    fresh: int = 0

    def _cluster(self, points: DataFrame, k: int) -> None:
        """Cluster points into new compression clusters; singletons become the retained set."""
        found = kmeans(points, first_points(points, k), self.dims)
        if not found:
            self.rs = points
            return
        placed = durable(assign(points, [(c.id, c.centre) for c in found]).select("point_id", "x", "cluster"))
        found = summaries(placed, self.dims)
        groups, alone = [c for c in found if c.n > 1], [c.id for c in found if c.n == 1]
        moved = placed.filter(~F.col("cluster").isin(alone)) if alone else placed
        if groups:
            self.parts.append(moved.select("point_id", F.lit("cs").alias("store"), (F.col("cluster") + self.fresh).alias("cluster")))
        self.cs += [Cluster(c.id + self.fresh, c.n, c.sums, c.squares) for c in groups]
        self.fresh += k
        self.rs = placed.filter(F.col("cluster").isin(alone) if alone else F.lit(False)).select("point_id", "x")

    def _absorb(self, points: DataFrame, store: str) -> DataFrame:
        """Points near a cluster of a store join it; the others are returned."""
        have = self.ds if store == "ds" else self.cs
        placed = durable(assign_within(points, have, self.dims, self.factor).select("point_id", "x", "cluster"))
        more = {c.id: c for c in summaries(placed, self.dims)}
        now = [c.merged(more[c.id]) if c.id in more else c for c in have]
        if store == "ds":
            self.ds = now
        else:
            self.cs = now
        self.parts.append(placed.filter("cluster >= 0").select("point_id", F.lit(store).alias("store"), "cluster"))
        return placed.filter("cluster < 0").select("point_id", "x")

    def update(self, chunk: DataFrame) -> None:
        """Take in a chunk of points (point_id, x); with a column `place` (from 0) the first share of the first chunk is told by it."""
        placed_by = "place" in chunk.columns
        chunk = durable(chunk.select("point_id", "x", *(["place"] if placed_by else [])))
        if not self.ds:
            part = F.col("place") < math.ceil(self.share * chunk.count()) if placed_by else F.pmod(F.xxhash64("point_id", F.lit(13)), F.lit(1000)) < int(1000 * self.share)
            base = chunk.filter(part).select("point_id", "x")
            found = kmeans(base, first_points(base, self.k), self.dims)
            placed = durable(assign(base, [(c.id, c.centre) for c in found]).select("point_id", "x", "cluster")) if found else None
            if placed is None:
                return
            self.ds = summaries(placed, self.dims)
            self.parts.append(placed.select("point_id", F.lit("ds").alias("store"), "cluster"))
            rest = chunk.filter(~part).select("point_id", "x")
        else:
            rest = self._absorb(self._absorb(chunk.select("point_id", "x"), "ds"), "cs")
            rest = durable(rest.unionByName(self.rs) if self.rs is not None else rest)
        self._cluster(rest, 2 * self.k)
        count = lambda s: sum(c.n for c in s)
        self.metrics.append((len(self.metrics) + 1, len(self.ds), count(self.ds), len(self.cs), count(self.cs), self.rs.count() if self.rs is not None else 0))

    def result(self) -> DataFrame:
        """point_id, cluster: compression clusters near a discard cluster join it; what is left gets -1."""
        target = {}
        for c in self.cs:
            gap = lambda d, c=c: sum(((a - b) / (s or 1.0)) ** 2 for a, b, s in zip(c.centre, d.centre, d.deviations, strict=True)) ** 0.5
            best = min(self.ds, key=lambda d: (gap(d), d.id))
            if gap(best) < self.factor * self.dims**0.5:
                target[c.id] = best.id
                self.ds = [d.merged(c) if d.id == best.id else d for d in self.ds]
        final = F.lit(-1)
        for c, d in target.items():
            final = F.when((F.col("store") == "cs") & (F.col("cluster") == c), F.lit(d)).otherwise(final)
        out = self.parts[0]
        for x in self.parts[1:]:
            out = out.unionByName(x)
        out = out.select("point_id", F.when(F.col("store") == "ds", F.col("cluster")).otherwise(final).alias("cluster"))
        return out.unionByName(self.rs.select("point_id", F.lit(-1).alias("cluster"))) if self.rs is not None else out

    def metric_rows(self, spark: SparkSession) -> DataFrame:
        """The sizes of the three sets after each chunk."""
        return spark.createDataFrame(self.metrics, "round int, ds_clusters int, ds_points bigint, cs_clusters int, cs_points bigint, rs_points bigint")
