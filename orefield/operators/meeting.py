"""Keys that meet at values they share: all pairs, counted in bounded memory and without a row for each meeting.

The values' keys are packed into jobs of at most JOB pairs (a value of very many keys gives many jobs, one for each two
chunks of its keys), dealt out evenly. A job's pairs travel as compressed columns, some five bytes a pair, to buckets by a
hash of the pair, where they are sorted and summed. So tasks hold a few million pairs at a time however large the input is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, import_path, written
from .keyed import positions

JOB = 1 << 20  # pairs of a job
CHUNK = 1 << 10  # keys of a chunk of a value's keys
FLUSH = 1 << 21  # pairs that are sent together
BUCKET = 1 << 20  # pairs of a bucket, while there are no more than BUCKETS
BUCKETS = 1 << 10
PASS = 1 << 22  # pairs that are summed at a time
PRIME = (1 << 31) - 1  # of MinHash
WHOLE = 1 << 12  # rows of a key up to which all come along with MinHash
_ROWS = 1 << 16  # rows that are packed at a time

Keep = Callable[[dict[str, np.ndarray]], np.ndarray]


def encoded(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers, each as the bytes that its range needs, byte by byte, compressed."""
    parts = []
    for x in arrays:
        lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        width = max(1, ((hi - lo).bit_length() + 7) // 8)
        parts.append(np.array([len(x), lo, width], np.int64).tobytes())
        low = x.astype(np.int64, copy=False).view(np.uint64) - np.int64(lo).view(np.uint64)
        parts.append(low.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = b"".join(parts)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def decoded(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, lo, width = (int(v) for v in np.frombuffer(raw, np.int64, 3, at))
        at += 24
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append((wide.view(np.uint64).reshape(n) + np.int64(lo).view(np.uint64)).view(np.int64))
        at += n * width
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coded(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and what they stand for, if few; else the bits themselves and nothing."""
    words, codes = np.unique(bits, return_inverse=True)
    return (codes.astype(np.uint8), words) if len(words) <= 256 else (bits, words[:0])


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = _ROWS) -> Iterator[pa.Table]:
    """Tables of about `least` rows that hold all rows of each value of the first column; the rows come in its order."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        last = batch.column(0)[-1].as_py()
        if last == held[0].column(0)[0].as_py():
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(table.column(0).to_numpy(), last))
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (by, key, bits, m0, m1) in the order of by and key to rows (work, groups, blob)."""
    for table in whole_groups(batches):
        by = table.column("by").to_numpy()
        starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        groups = len(starts)  # with those of null keys alone
        named = np.asarray(table.column("key").is_valid())
        table = table.filter(pa.array(named)).combine_chunks()
        sizes = np.add.reduceat(named.astype(np.int64), starts)
        keys, bits, *masks = (table.column(c).to_numpy() for c in ("key", "bits", "m0", "m1"))
        ends = np.cumsum(sizes)
        work = sizes * (sizes - 1) // 2
        out: list[tuple[int, int, bytes]] = []

        def add(kind: int, counts: np.ndarray, rows: np.ndarray, work: int, keys=keys, bits=bits, masks=masks, out=out) -> None:
            few, words = _coded(bits[rows])
            out.append((work, 0, encoded([np.array([kind]), counts, keys[rows], few, words, masks[0][rows], masks[1][rows]])))

        for g in np.flatnonzero(work > JOB):
            at = [np.arange(i, min(i + CHUNK, ends[g])) for i in range(int(ends[g] - sizes[g]), int(ends[g]), CHUNK)]
            for i, one in enumerate(at):
                add(0, np.array([len(one)]), one, len(one) * (len(one) - 1) // 2)
                for two in at[i + 1 :]:
                    add(1, np.array([len(one), len(two)]), np.r_[one, two], len(one) * len(two))
                    if len(out) >= 64:
                        yield _job_rows(out)
                        out.clear()
        small = np.flatnonzero((work > 0) & (work <= JOB))
        of = np.cumsum(work[small]) // JOB
        for part in np.split(small, np.flatnonzero(np.diff(of)) + 1) if len(small) else []:
            first = ends[part] - sizes[part]
            rows = np.repeat(first - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(sizes[part].sum())
            add(0, sizes[part], rows, int(work[part].sum()))
        yield _job_rows([*out, (0, groups, b"")])


def multipliers(n: int, p: int = PRIME) -> list[tuple[int, int]]:
    """a, b of the hashes (a h + b) mod p: of all sizes, from a multiplicative generator; small ones, near each other, would pick the same items."""
    out, a = [], 20_011
    for _ in range(n):
        a, b = a * 48_271 % p, a
        out.append((a, b))
    return out


def _marked(batches: Iterator[pa.RecordBatch], bands: int, unique: bool, left_out) -> Iterator[pa.RecordBatch]:
    """Rows (key, by, bits, h) in the order of key and by, with bits of the hashes under which `by` has its key's smallest value.

    With `unique`, repeated rows go and bits become the size of the key's set. Of keys of more than WHOLE rows those without a bit are left out.
    """
    for table in whole_groups(batches):
        key, by, bits, h = (table.column(c).to_numpy() for c in ("key", "by", "bits", "h"))
        new = np.r_[True, key[1:] != key[:-1]]
        first = new | np.r_[True, by[1:] != by[:-1]]
        if unique:
            key, by, h, new = key[first], by[first], h[first], new[first]
            first = np.ones(len(key), bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(key)])
        of = np.repeat(np.arange(len(starts)), sizes)
        m, h = [np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)], h.astype(np.uint64)
        p, low = np.uint64(PRIME), np.uint64(31)
        for i, (a, b) in enumerate(multipliers(bands)):
            x = h * np.uint64(a) + np.uint64(b)
            x = (x & p) + (x >> low)
            x = (x & p) + (x >> low)
            x[x >= p] -= p
            m[i // 64] |= (x == np.minimum.reduceat(x, starts)[of]).astype(np.uint64) << np.uint64(i % 64)
        large = (sizes > WHOLE)[of]
        keep = np.ones(len(key), bool)
        if large.any():
            left_out.add(1)
            keep = ~large | ((m[0] | m[1]) != 0)
        cols = {"key": key, "by": by, "bits": sizes[of].astype(np.float64) if unique else bits, **{f"m{i}": np.where(first, v, np.uint64(0)).view(np.int64) for i, v in enumerate(m)}}
        yield pa.RecordBatch.from_pydict({c: pa.array(v[keep]) for c, v in cols.items()})


def _job_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    work, groups, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(work, pa.int64()), pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["work", "groups", "blob"])


def _flushed(jobs: list[list[np.ndarray]], buckets: int, raw: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of some jobs as rows (bucket, pairs, blob)."""
    off, froms, untils = 0, [], []
    for (kind,), sizes, keys, *_ in jobs:
        at = off + np.arange(len(keys))
        if kind:
            froms.append(np.full(len(keys), off + sizes[0]))
            untils.append(np.where(at < off + sizes[0], off + len(keys), off + sizes[0]))
        else:
            froms.append(at + 1)
            untils.append(off + np.repeat(np.cumsum(sizes), sizes))
        off += len(keys)
    first, counts = np.concatenate(froms), np.concatenate(untils) - np.concatenate(froms)
    left = np.repeat(np.arange(off, dtype=np.int32), counts)
    right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts - first, counts)
    names, code = np.unique(np.concatenate([j[2] for j in jobs]), return_inverse=True)
    code = code.astype(np.uint64)
    bits = np.uint64(max(1, len(names).bit_length()))
    a, b = code[left], code[right]
    if (a == b).any():  # a key that has a value twice
        left, right = left[a != b], right[a != b]
        a, b = code[left], code[right]
    mixed = _mixed(names.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    where = _mixed(mixed[a] * np.uint64(3) + mixed[b])
    order = ((((where >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << (bits + bits)) | (a << bits) | b
    del a, b, where
    to = np.argsort(order)
    order, left, right = order[to], left[to], right[to]
    del to
    few, words = _coded(np.concatenate([j[4][j[3]] if len(j[4]) else j[3] for j in jobs]))
    m0, m1 = (np.concatenate([j[i] for j in jobs]).view(np.uint64) for i in (5, 6))
    met = np.bitwise_count(m0[left] & m0[right]).astype(np.int64) if m0.any() else np.zeros(len(left), np.int64)
    if m1.any():
        met += np.bitwise_count(m1[left] & m1[right])
    n = np.zeros(0, np.int64)
    if not raw:
        starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, np.int64)
        n = np.diff(np.r_[starts, len(order)])
        met = np.add.reduceat(met, starts) if len(starts) else met
        order, left, right = order[starts], left[starts], right[starts]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    a, b, x, y = names[(order >> bits) & mask], names[order & mask], few[left], few[right]
    cuts = np.searchsorted(order >> (bits + bits), np.arange(buckets + 1, dtype=np.uint64))
    out: list[tuple[int, int, bytes]] = []
    for k in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[k], cuts[k + 1])
        out.append((int(k), int(cuts[k + 1] - cuts[k]), encoded([np.diff(a[s], prepend=0)[1:], a[s][:1], b[s], n[s], x[s], y[s], words, met[s]])))
    for i in range(0, len(out), 256):
        k, size, blobs = zip(*out[i : i + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "pairs", "blob"])


def _sent(batches: Iterator[pa.RecordBatch], buckets: int, raw: bool) -> Iterator[pa.RecordBatch]:
    jobs: list[list[np.ndarray]] = []
    work = 0
    for batch in batches:
        for w, blob in zip(batch.column("work").to_pylist(), batch.column("blob"), strict=True):
            jobs.append(decoded(blob.as_py()))
            work += w
            if work >= FLUSH:
                yield from _flushed(jobs, buckets, raw)
                jobs, work = [], 0
    if jobs:
        yield from _flushed(jobs, buckets, raw)


def _summed(table: pa.Table, raw: bool, keep: Keep | None) -> pa.Table:
    """The pairs of a bucket: a, b, n, met and either x and y or their sums."""
    names = ["a", "b", "n", "met", *(["sx", "sy", "sxy", "sxx", "syy"] if raw else ["x", "y"])]
    types = [pa.int64()] * 4 + [pa.float64()] * (len(names) - 4)
    passes = -(-sum(table.column("pairs").to_pylist()) // PASS)
    out = []
    for turn in range(passes):
        parts = []
        for blob in table.column("blob"):
            step, first, b, n, x, y, words, met = decoded(blob.as_py())
            a = np.cumsum(np.r_[first, step])
            x, y = (words[c] if len(words) else c for c in (x, y))
            part = [a, b, n if len(n) else np.ones(len(a), np.int64), met, x.view(np.float64), y.view(np.float64)]
            if passes > 1:
                mine = _mixed(_mixed(a.view(np.uint64)) + b.view(np.uint64)) % np.uint64(passes) == turn
                part = [v[mine] for v in part]
            parts.append(part)
        a, b, n, met, x, y = map(np.concatenate, zip(*parts, strict=True))
        del parts
        if not len(a):
            continue
        wide = int(b.max()) - int(b.min()) + 1
        if (int(a.max()) - int(a.min()) + 1) * wide < 1 << 63:
            to = np.argsort((a - a.min()) * wide + (b - b.min()))
        else:
            to = np.lexsort((b, a))
        a, b, n, met, x, y = (v[to] for v in (a, b, n, met, x, y))
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        total = lambda v, starts=starts: np.add.reduceat(v, starts)
        rest = [total(x), total(y), total(x * y), total(x * x), total(y * y)] if raw else [x[starts], y[starts]]
        row = dict(zip(names, [a[starts], b[starts], total(n), total(met), *rest], strict=True))
        if keep is not None:
            kept = keep(row)
            row = {c: v[kept] for c, v in row.items()}
        out += pa.table(row).to_batches(max_chunksize=1 << 16)
    return pa.Table.from_batches(out, pa.schema(list(zip(names, types, strict=True))))


_WHOLE = ("tinyint", "smallint", "int", "bigint")


class Meetings:
    """The meetings of `key`s at the values of `by`: each two keys, once for each value that both have (for each two rows, if rows are repeated).

    `value` (double) is carried along with a row, `masks` are up to two bigint columns of bits. Null values of `by` and null keys meet nothing.
    With `bands` (128 at most) the bits are those of as many MinHashes, so that `met` is the number on which two keys agree. Then keys of more
    than WHOLE rows come only to the values that some hash picks, and `left_out` is true: n and the sums of their pairs are too small.
    """

    def __init__(self, rows: DataFrame, key: str, by: str, value: str | None = None, masks: tuple[str, ...] = (), bands: int = 0, unique: bool = False) -> None:
        spark = rows.sparkSession
        import_path(spark)
        kinds = dict(rows.dtypes)
        self.kind, self.names = kinds[key], None
        cols = {"bits": F.col(value) if value else F.lit(0.0), "m0": F.lit(0), "m1": F.lit(0), "h": F.pmod(F.xxhash64(F.col(by)), F.lit(PRIME)) if bands else F.lit(0), **{f"m{i}": F.col(m) for i, m in enumerate(masks)}}
        flat = rows.select(F.col(by).alias("by"), F.col(key).alias("key"), F.coalesce(cols["bits"].cast("double"), F.lit(0.0)).alias("bits"), *(cols[c].cast("bigint").alias(c) for c in ("m0", "m1", "h"))).filter("by is not null")
        if kinds[by] not in _WHOLE or self.kind not in _WHOLE:
            flat = written(flat)
        if kinds[by] not in _WHOLE:
            flat = flat.join(positions(flat, "by").withColumnRenamed("position", "by_no"), "by").drop("by").withColumnRenamed("by_no", "by")
        if self.kind not in _WHOLE:
            self.names = written(positions(flat.filter("key is not null"), "key"))
            flat = flat.join(self.names, "key", "left").drop("key").withColumnRenamed("position", "key")
        flat = flat.select(F.col("by").cast("bigint").alias("by"), F.col("key").cast("bigint").alias("key"), "bits", "m0", "m1", "h")
        left_out = spark.sparkContext.accumulator(0)
        if bands:
            marked = partial(_marked, bands=bands, unique=unique, left_out=left_out)
            flat = flat.select("key", "by", "bits", "h").filter("key is not null").repartition("key").sortWithinPartitions("key", "by").mapInArrow(marked, "key bigint, by bigint, bits double, m0 bigint, m1 bigint")
        flat = flat.select("by", "key", "bits", "m0", "m1")
        self.jobs = written(flat.repartition("by").sortWithinPartitions("by", "key").mapInArrow(_bits_of, "work bigint, groups bigint, blob binary"))
        self.work, self.groups = self.jobs.agg(F.coalesce(F.sum("work"), F.lit(0)), F.coalesce(F.sum("groups"), F.lit(0))).first()
        self.left_out = left_out.value > 0

    def pairs(self, keep: Keep | None = None, sums: bool = False) -> DataFrame:
        """a, b (a < b), n: the meetings of each pair; met: the bits that both masks have, summed over them; x, y: the values of a and of b,
        if each key has one alone, or with `sums` sx, sy, sxy, sxx, syy over all meetings. `keep` says which of these columns' rows to keep."""
        spark = self.jobs.sparkSession
        buckets = min(BUCKETS, -(-int(self.work) // BUCKET) or 1)
        parts = max(spark.sparkContext.defaultParallelism, min(int(self.work) // (4 * FLUSH), 1 << 14))
        sent = self.jobs.filter("work > 0").select("work", "blob").repartition(parts).mapInArrow(partial(_sent, buckets=buckets, raw=sums), "bucket int, pairs bigint, blob binary")

        def summed(table: pa.Table) -> pa.Table:
            return _summed(table, sums, keep)

        last = "sx double, sy double, sxy double, sxx double, syy double" if sums else "x double, y double"
        with batches_of(spark, 16):
            found = written(sent.groupBy("bucket").applyInArrow(summed, f"a bigint, b bigint, n bigint, met bigint, {last}"))
        for c in ("a", "b"):
            if self.names is not None:
                side = self.names.withColumnsRenamed({"key": f"_{c}", "position": c})
                found = found.join(side, c).drop(c).withColumnRenamed(f"_{c}", c)
            else:
                found = found.withColumn(c, F.col(c).cast(self.kind))
        return found.select("a", "b", *(x for x in found.columns if x not in ("a", "b")))


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plain() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["bits"] = pa.array(cols["bits"].to_numpy(zero_copy_only=False).view(np.int64))
            yield pa.RecordBatch.from_pydict(cols)

    return _jobs(plain())
