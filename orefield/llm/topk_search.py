"""Exact top-k search: every pair of a query block and a shard of candidates as a matrix product, the best so far kept in each task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, durable, trimmed

BYTES = 1 << 20  # of a matrix in a row at most (a vector at least)
STRIP = 256  # queries that are multiplied at a time
PARTS = 32  # partitions of the queries, and of the candidates, at most: a task is a pair of them


def finite(vector: str = "embedding") -> Column:
    """The vector as doubles; null if it is null, or any component is null or not finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~bad, x)


def _packed(vectors: DataFrame, size: int, into: str, scale: int) -> DataFrame:
    """Rows of up to `size` vectors of one dimension: dim, wide, ids, matrix (row-major).

    A matrix holds floor(scale * x) in 16 bits if that fits all components of its vectors, else (wide) x in doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                same = np.flatnonzero(dims == d)
                most = max(1, min(size, BYTES // max(1, 2 * int(d))))
                for at in range(0, len(same), most):
                    rows = same[at : at + most]
                    m = flat[(starts[rows][:, None] + np.arange(d)[None, :]).ravel()].reshape(len(rows), d)
                    with np.errstate(over="ignore"):
                        whole = np.floor(scale * m)
                    wide = np.abs(whole).max(axis=1, initial=0) >= 2**15 if scale & (scale - 1) == 0 else np.ones(len(rows), bool)
                    for is_wide, matrix in ((False, whole), (True, m)):
                        if (part := wide == is_wide).any():
                            cells = matrix[part].astype(np.float64 if is_wide else np.int16).tobytes()
                            yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([is_wide]), pa.array([ids[rows[part]].tobytes()], pa.binary()), pa.array([cells], pa.binary())], names=["dim", f"{into}_wide", f"{into}_ids", f"{into}_m"])
        trimmed()

    return vectors.mapInArrow(run, f"dim int, {into}_wide boolean, {into}_ids binary, {into}_m binary")


def integer(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return math.floor(Fraction(x) * scale)


def products(q: np.ndarray, c: np.ndarray, scale: int = 1) -> np.ndarray:
    """Exact inner products of floor(scale * x) of all rows of q with those of c.

    In double precision where no partial sum can pass 2^53 (doubles hold all numbers on the way exactly), else in Python's whole numbers.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.floor(scale * q), np.floor(scale * c)
        size = q.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if size < 2**53 and scale & (scale - 1) == 0:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[integer(v, scale) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(q) @ whole(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)


def ordered(v: int) -> bytes:
    """Bytes that sort as whole numbers do, of any size."""
    n = abs(v).to_bytes((abs(v).bit_length() + 7) // 8, "big")
    up = b"\x80" + len(n).to_bytes(4, "big") + n
    return up if v >= 0 else bytes(255 - x for x in up)


def _longest(m: np.ndarray) -> int:
    """The largest squared length of a row of 16-bit numbers."""
    return int(np.einsum("ij,ij->i", m, m, dtype=np.int64).max(initial=0))


class _Best:
    """The k best candidates so far of each row of a query block: highest score, then smallest id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)  # of those that have k: the worst score and its id

    def add(self, at: int, s: np.ndarray, c_ids: np.ndarray) -> None:
        """Take in the scores of the rows from `at` on with the candidates c_ids; those of a row's own id don't count."""
        if s.dtype == object:
            r, c = np.nonzero(np.ones(s.shape, bool))
        else:
            least = self.least[at : at + len(s)]
            if np.isneginf(least).any():  # at first: the best of this tile, with room for own ids
                j = s.shape[1] - self.k - int(np.unique(c_ids, return_counts=True)[1].max())
                least = np.maximum(least, np.partition(s, j, axis=1)[:, j]) if j >= 0 else least
            some = np.flatnonzero(s.max(axis=1) >= least)
            r, c = np.nonzero(s[some] >= least[some][:, None])
            r = some[r]
        others = c_ids[c] != self.ids[r + at]
        r, c = r[others], c[others]
        new = s[r, c]
        if new.dtype != object:  # of many copies only those of a smaller id
            new, worst = new.astype(np.int64), self.least[r + at]
            better = (new > worst) | ((new == worst) & (c_ids[c] < self.last[r + at]))
            r, c, new = r[better], c[better], new[better]
        if not len(r):
            return
        fresh = np.zeros(len(self.ids), bool)
        fresh[r + at] = True
        old = fresh[self.rows]
        rows, found, scores = (np.concatenate([x[old], y]) for x, y in ((self.rows, r + at), (self.found, c_ids[c]), (self.scores, new)))
        if scores.dtype == object:
            by = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], found[i])), int)
        else:
            by = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[by], found[by], scores[by]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        last = place == self.k - 1
        self.last[rows[last]] = found[last]
        self.least[rows[last]] = [float(max(min(v, 2**62), -(2**62))) for v in scores[last].tolist()]
        keep = place < self.k
        self.rows, self.found, self.scores = (np.concatenate([x[~old], y[keep]]) for x, y in ((self.rows, rows), (self.found, found), (self.scores, scores)))

    def batches(self, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), most):
            part = slice(at, at + most)
            whole = [int(v) for v in self.scores[part]]
            score = [max(min(v, 2**63 - 1), -(2**63)) for v in whole]
            exact = [ordered(v) if not -(2**63) < v < 2**63 - 1 else None for v in whole]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.rows[part]]), pa.array(self.found[part]), pa.array(score, pa.int64()), pa.array(exact, pa.binary())], names=["query_id", "vec_id", "score", "exact"])


def _tiles(k: int, scale: int):
    def matrix(x: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(x[f"{side}_ids"], np.int64)
        return ids, np.frombuffer(x[f"{side}_m"], np.float64 if x[f"{side}_wide"] else np.int16).reshape(len(ids), x["dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):  # a row is a tile
                x = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                (q_ids, q), (c_ids, c) = matrix(x, "q"), matrix(x, "c")
                if x["q_no"] not in best:
                    best[x["q_no"]] = _Best(q_ids, k)
                top = best[x["q_no"]]
                if x["q_wide"] or x["c_wide"]:
                    raw = [m if m.dtype == np.float64 else m / scale for m in (q, c)]  # exact, as 16 bits come with powers of two only
                    for at in range(0, len(q_ids), STRIP):
                        top.add(at, products(raw[0][at : at + STRIP], raw[1], scale), c_ids)
                else:  # by Cauchy and Schwarz no partial sum passes the product of the lengths
                    kind = np.float32 if _longest(q) * _longest(c) < 2**48 else np.float64
                    left, right = q.astype(kind), c.astype(kind).T
                    out = np.empty((min(STRIP, len(q)), len(c)), kind)
                    for at in range(0, len(q_ids), STRIP):
                        part = left[at : at + STRIP]
                        top.add(at, np.matmul(part, right, out=out[: len(part)]), c_ids)
        for top in best.values():
            yield from top.batches()
        trimmed()

    return run


def topk_search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, block: int = ROWS, shard: int = ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query by exact inner product.

    `queries` marks the query rows of `vectors` (vec_id, embedding). Ties go to the smaller vec_id. Rows
    that share a query's vec_id are its own and no candidates; a repeated candidate row can fill several
    ranks; repeated query rows are asked once. Vectors that are null, hold a null or non-finite component or have a null
    vec_id take no part; vectors of another dimension than the query's are no candidates of it; an empty
    vector scores 0 against other empty ones. Scores beyond 64 bits are computed and ranked exactly, then shown as the
    nearest 64-bit number. Fewer than k candidates give fewer ranks, an empty table none. Extra columns
    are ignored.

    The stated query set meets all rows in blocks: queries are packed into matrices of up to `block` rows, candidates into
    matrices of up to `shard`, and both are written once, as 16-bit numbers where these do. A task takes a partition of each
    and reads both from there, so no matrix is shuffled or sent to the driver. It keeps the k best for each of its queries, which
    are all that leaves it: at most PARTS x k rows a query are merged in the end.
    """
    v = vectors.select("vec_id", finite("embedding").alias("v"), queries.alias("is_query")).filter("vec_id is not null and v is not null")
    candidates = durable(_packed(v.select("vec_id", "v"), shard, "c", scale)).coalesce(PARTS)
    asked = v.filter("is_query").select("vec_id", "v").distinct().coalesce(PARTS)
    blocks = durable(_packed(asked, block, "q", scale).withColumn("q_no", F.monotonically_increasing_id()))
    tiles = candidates.join(blocks.hint("shuffle_replicate_nl"), "dim").select("dim", "q_no", "q_wide", "q_ids", "q_m", "c_wide", "c_ids", "c_m")
    lists = tiles.mapInArrow(_tiles(k, scale), "query_id bigint, vec_id bigint, score bigint, exact binary")
    order = [F.desc("score"), F.desc("exact"), F.asc("vec_id")]  # exact is null but at the ends of 64 bits
    return lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
