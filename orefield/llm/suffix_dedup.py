"""Repeated passages by a sparse suffix array.

Suffixes are kept at content-selected places only: word k-mers whose hash is smallest in some window of w
k-mers, so that equal passages of k + w - 1 words or more keep equal suffixes wherever they stand. Of a run
of one word the first and last do, and its inside is met by itself. Suffixes
whose first k words start in one document alone go. Of those with the same words around them, as far as a window of
`min_words` that holds the k-mer reaches, the one of the smallest document stands for all: the others meet it alone.
These are sorted (by hashes of their first 12, next
4, next 4, .. words: any order of blocks serves, as neighbours share the longest beginnings), and once more
by the words to their left. Each suffix and the nearest ones of a smaller document on either side (nothing
further away shares more in that direction) seed matches, which are extended left and right word by word on the two
texts; matches of `min_words` or more that lie in no longer one of the document are returned.

A document further away may share less in either direction but more in both together. The blocks shared with the
nearest bound what any smaller document shares on either side; the windows of `min_words` words within these bounds
that no match covers are met by their hashes with those of smaller documents, and the pairs extended likewise.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, joined, mixed, slices, trimmed, window_hashes, word_hashes, words

K, WINDOW, MIN_WORDS = 12, 32, 50
STEPS = (4, 4, 8, 16, 32)  # words in the blocks after the first k (and before the suffix)
_SORTED = 500_000  # suffixes in a sorted partition


def _window_min(h: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over h[i : i + w] for each i with a full window; w is a power of two."""
    m, s = h, 1
    while s < w:
        m = pick(m[:-s], m[s:])
        s *= 2
    return m


def minimisers(h: np.ndarray, of: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Places whose hash is smallest in a window of w places of one document; of a run of equal hashes the first and the last.

    So the words in a window alone decide, unless it lies within a run.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _window_min(h, w, np.minimum)
    low = np.where(of[: len(low)] == of[w - 1 :], low, np.uint64(0))
    around = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high = _window_min(around, w, np.maximum)  # over the windows that hold each place
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    inner = np.concatenate([[False], again]) & np.concatenate([again, [False]])
    return np.flatnonzero((high == h) & (h > 0) & ~inner)


def repeats(h: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of `least` or more equal hashes of one document."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
    n = np.diff(np.append(start, len(h)))
    return start[n >= least], n[n >= least]


def _sampled(k: int, w: int, min_words: int):
    """Of each document: the kept grams and their places, runs of one word that fill a window of min_words, the text squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches, "text"):
            raw, off = joined(batch.column("text"))
            start, end, first = words(raw, off)
            g = window_hashes(word_hashes(raw, start, end), k)
            of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            inside = np.flatnonzero(of[: len(g)] == of[k - 1 :]) if len(g) else np.zeros(0, np.int64)
            at = inside[minimisers(g[inside], of[inside], w)]
            same, n = repeats(g[inside], of[inside], min_words - k + 1)
            same = inside[same]
            data = raw.tobytes()
            z = [codec.compress(data[a:b], asbytes=True) if b > a else b"" for a, b in zip(off[:-1], off[1:], strict=True)]
            lists = lambda at, x, t: pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(x.astype(t)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(x for a in (at, same) for x in (lists(a, g[a].view(np.int64), np.int64), lists(a, a - first[of[a]], np.int32))), lists(same, n + k - 1, np.int32), pa.array(np.diff(off)), pa.array(z, pa.binary())],
                names=["doc_id", "grams", "places", "run_grams", "run_places", "run_words", "size", "z"],
            )

    return run


def _hashes(z: bytes, size: int, codec: pa.Codec) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = codec.decompress(z, size, asbytes=True) if size else b""
    raw = np.frombuffer(data, np.uint8)
    start, end, _ = words(raw, np.array([0, len(raw)]))
    return data, word_hashes(raw, start, end), start, end


def _blocks(k: int, min_words: int):
    """For each kept suffix the hashes of the blocks of words after its first k, of those before it (outermost last), and of all windows that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        names = ["row", "doc_id", "place", "gram", *(f"r{i}" for i in range(len(STEPS))), *(f"l{i}" for i in range(len(STEPS))), "around"]
        for batch in batches:
            for row, doc, z, size, kept in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "z", "size", "kept")), strict=True):
                _, h, _, _ = _hashes(z, size, codec)
                p = np.array([x["place"] for x in kept], np.int64)
                sums, back = _prefixes(h)
                out = [np.full(len(p), row, np.int64), np.full(len(p), doc, np.int64), p.astype(np.int32), np.array([x["gram"] for x in kept], np.int64)]
                for sign, at0 in ((1, p + k), (-1, p)):
                    at = at0
                    for n in STEPS:
                        a, b = (at, np.minimum(at + n, len(h))) if sign > 0 else (np.maximum(at - n, 0), at)
                        out.append(_ranged(sums, back, a, b).view(np.int64))
                        at = b if sign > 0 else a
                a, b = np.maximum(p + k - min_words, 0), np.minimum(p + min_words, len(h))
                out.append(mixed(_ranged(sums, back, a, b) + (p - a).astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return run


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _prefixes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of h[i] * base^i modulo 2^64 before each place, and base^-i: with them the hash of any range takes one step."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)]), _powers(_INVERSE, len(h) + 1)


def _ranged(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words a to b - 1, in order, and their number; the same wherever they stand."""
    return mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def nearest_smaller(doc: list[int], gram: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the nearest one before and after it of the same gram and a smaller document; -1 if none."""
    n, stack = len(doc), []
    left, right, again = [-1] * n, [-1] * n, []
    for i in range(n):
        if i and gram[i] != gram[i - 1]:
            stack = []
        d = doc[i]
        while stack and doc[stack[-1]] >= d:
            j = stack.pop()
            if doc[j] > d:
                right[j] = i
            else:
                again.append((j, i))  # of the same document: what comes after i holds for j too
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    for j, i in reversed(again):
        right[j] = right[i]
    return left, right


def _borders(doc: np.ndarray, gram: np.ndarray, key: np.ndarray) -> list[tuple[int, int]]:
    """(kind, place) of the suffixes that may have partners in other partitions, in order.

    Kind 1: of the first gram, those with no smaller document before them; 2: of the last gram, those with none
    after them. Of suffixes with equal words throughout, those of the first, the smallest, document stand for all.
    """
    first, last = np.flatnonzero(gram == gram[0]), np.flatnonzero(gram == gram[-1])
    before = first[doc[first] == np.minimum.accumulate(doc[first])]
    after = last[doc[last] == np.minimum.accumulate(doc[last][::-1])[::-1]]
    run = np.concatenate([[True], key[after][1:] != key[after][:-1]])
    after = after[doc[after] == doc[after][run][np.cumsum(run) - 1]]
    return [(1, int(i)) for i in before] + [(2, int(i)) for i in after]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: each suffix (a) with the nearest of a smaller document (b) on either side, and its borders (b is null)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    kept = ["row", "doc_id", "place", "gram"]
    doc, gram, key = (t.column(c).to_numpy() for c in ("doc_id", "gram", "key"))
    left, right = (np.array(x) for x in nearest_smaller(doc.tolist(), gram.tolist()))
    blocks = [t.column(f"b{i}").to_numpy() for i in range(len(STEPS))]
    names = [f"{c}_a" for c in kept] + [f"{c}_b" for c in kept] + ["kind", "seq", "alone", "shared"]
    for other in (left, right):
        mine = np.flatnonzero(other >= 0)
        for at in range(0, len(mine), 100_000):
            i = mine[at : at + 100_000]
            x, y = t.take(pa.array(i)), t.take(pa.array(other[i]))
            cols = [c.combine_chunks() for c in (*(x.column(c) for c in kept), *(y.column(c) for c in kept))]
            shared = np.cumprod([b[i] == b[other[i]] for b in blocks], axis=0, dtype=np.int32).sum(axis=0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.zeros(len(i), np.int32)), pa.array(np.zeros(len(i), np.int32)), pa.nulls(len(i), pa.bool_()), pa.array(shared)], names=names)
    ends = _borders(doc, gram, key)
    x, n = t.take(pa.array([i for _, i in ends])), len(ends)
    cols = [x.column(c).combine_chunks() for c in kept] + [pa.nulls(n, ty) for ty in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([k for k, _ in ends], pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array([bool(gram[0] == gram[-1])] * n), pa.nulls(n, pa.int32())], names=names)


def across(partitions: list[tuple[list, list, bool]]) -> list[tuple]:
    """Pairs (suffix, nearest of a smaller document) over the borders of partitions (first, last, alone); suffixes are (row, doc, place, gram).

    `first` and `last` are the borders of `_borders`; alone says that the partition holds one gram only.
    """
    out: list[tuple] = []
    for way in (1, -1):
        near: list[tuple] = []  # what a suffix meets on its way, nearest first
        for first, last, alone in partitions[::way]:
            mine, further = (first, last[::-1]) if way > 0 else (last, first)
            same = bool(near) and near[0][3] == mine[0][3]
            if same:
                for x in mine:
                    if y := next((y for y in near if y[1] < x[1]), None):
                        out.append((x, y))
            low = min(y[1] for y in further)
            near = further + ([y for y in near if y[1] < low] if same and alone else [])
    return out


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """How many first numbers of x and y agree, in time that follows the answer."""
    at, step, n = 0, 256, min(len(x), len(y))
    while at < n:
        other = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if other.any():
            return at + int(other.argmax())
        at, step = at + len(other), 2 * step
    return n


def match(ha: np.ndarray, hb: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Start in b and length of the longest run around place j of b that agrees with that around place i of a."""
    left, right = _run(ha[:i][::-1], hb[:j][::-1]), _run(ha[i:], hb[j:])
    return j - left, left + right


class Longest:
    """Runs (start, n, source, source start) of which none lies in another, in order; of equal ones the first is kept."""

    def __init__(self):
        self.runs: list[tuple[int, int, int, int]] = []

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.runs, start, key=lambda x: x[0]) - 1
        return i >= 0 and self.runs[i][0] + self.runs[i][1] >= end

    def add(self, run: tuple[int, int, int, int]) -> None:
        end = run[0] + run[1]
        if self.holds(run[0], end):
            return
        i = j = bisect_left(self.runs, run[0], key=lambda x: x[0])
        while j < len(self.runs) and self.runs[j][0] + self.runs[j][1] <= end:
            j += 1
        self.runs[i:j] = [run]


def _extended(k: int, min_words: int):
    """Matches of at least min_words through seeds (d, p): place p of b and p - d of a; rows of one b in a run. Compared word for word.

    A seed goes if all windows that hold it lie in a match already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        last, doc, b_side, found, out = None, None, None, Longest(), []

        def flushed() -> pa.RecordBatch:
            cols = [np.array([x[c] for x in out], t) for c, t in enumerate((np.int64, np.int32, np.int32, np.int64, np.int32, np.int64))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "start", "n_words", "source_id", "source_start", "row"])

        for batch in batches:
            for a, b, row_b, za, na, zb, nb, seeds in zip(*(batch.column(c).to_pylist() for c in ("doc_a", "doc_b", "row_b", "z_a", "size_a", "z_b", "size_b", "seeds")), strict=True):
                if row_b != last:
                    out += [(doc, *x, last) for x in found.runs]
                    last, doc, b_side, found = row_b, b, _hashes(zb, nb, codec), Longest()
                (db, hb, sb, eb), a_side = b_side, None
                for p, d in sorted((x["p"], x["d"]) for x in seeds):
                    if found.holds(max(0, p + k - min_words), min(len(hb), p + min_words)):
                        continue
                    da, ha, sa, ea = a_side = a_side or _hashes(za, na, codec)
                    start, n = match(ha, hb, p - d, p)
                    if n < min_words or found.holds(start, start + n):
                        continue
                    same = [da[sa[i - d] : ea[i - d]] == db[sb[i] : eb[i]] for i in range(start, start + n)]
                    turns = np.flatnonzero(np.diff([0, *same, 0])).reshape(-1, 2)  # one run, unless the hashes of two words meet
                    for x, y in turns.tolist():
                        if y - x >= min_words:
                            found.add((start + x, y - x, a, start + x - d))
            if len(out) > 10_000:
                yield flushed()
        out += [(doc, *x, last) for x in found.runs]
        yield flushed()
        trimmed()

    return run


def _left_open(min_words: int):
    """The suffixes with the starts of windows (lo to hi words before the suffix) that lie in no passage (start, end) of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, doc, suffixes, spans in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "suffixes", "spans")), strict=True):
                met: list[list[int]] = []  # starts of windows in passages, as disjoint ranges
                for a, b in sorted((x["start"], x["start"] + x["n_words"] - min_words) for x in spans or ()):
                    if met and a <= met[-1][1] + 1:
                        met[-1][1] = max(met[-1][1], b)
                    else:
                        met.append([a, b])
                firsts = [a for a, _ in met]
                for x in suffixes:
                    a, b = max(0, x["place"] - x["hi"]), x["place"] - x["lo"]
                    if (i := bisect_right(firsts, a) - 1) >= 0 and met[i][1] >= a:
                        a = met[i][1] + 1
                    if (i := bisect_right(firsts, b) - 1) >= 0 and met[i][1] >= b:
                        b = met[i][0] - 1
                    if a <= b:
                        for o, v in zip(out, (row, doc, x["place"], x["gram"], x["place"] - b, x["place"] - a), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["row", "doc_id", "place", "gram", "lo", "hi"])

    return run


def _windows(min_words: int):
    """Hashes of the windows that start lo to hi words before suffixes; mine says that the window is open in its own document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for row, doc, z, size, suffixes in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "z", "size", "suffixes")), strict=True):
                _, h, _, _ = _hashes(z, size, codec)
                n = len(h) - min_words + 1
                if n <= 0:
                    continue
                marks = []
                for lo, hi in (("lo", "hi"), ("own_lo", "own_hi")):
                    mark = np.zeros(n + 1, np.int64)
                    for x in suffixes:
                        if x[lo] is not None:
                            a, b = max(0, x["place"] - x[hi]), min(n - 1, x["place"] - x[lo])
                            if a <= b:
                                mark[a] += 1
                                mark[b + 1] -= 1
                    marks.append(np.cumsum(mark)[:n] > 0)
                at = np.flatnonzero(marks[0])
                key = _ranged(*_prefixes(h), at, at + min_words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.full(len(at), row, np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32), marks[1][at])], names=["h", "row", "doc_id", "start", "mine"])

    return run


def _seeded(seeds: DataFrame) -> DataFrame:
    """row_a, doc_a, row_b, doc_b, seeds: the seeds (d, p) of each pair of rows."""
    return durable(seeds.groupBy("row_a", "doc_a", "row_b", "doc_b").agg(F.collect_set(F.struct("d", "p")).alias("seeds")))


def _open_seeds(rows: DataFrame, suffixes: DataFrame, pairs: DataFrame, found: DataFrame, min_words: int, k: int) -> DataFrame | None:
    """Pairs of rows with seeds for the windows that no passage of found covers; None if there are none."""
    # Nothing of a smaller document shares more words than these in one direction: one less than the next block would need.
    most = F.array(*(F.lit(int(n) - 1) for n in np.cumsum(STEPS)), F.lit(1 << 20))
    span = min_words - k
    upto = lambda c: F.get(most, F.coalesce(F.max(c), F.lit(len(STEPS))))
    bounds = pairs.groupBy(F.col("row_a").alias("row"), F.col("place_a").alias("place")).agg(F.max("doc_id_a").alias("doc_id"), F.max("gram_a").alias("gram"), upto("right").alias("r"), upto("left").alias("l"))
    near = bounds.select("row", "doc_id", "place", "gram", F.greatest(F.lit(0), span - F.col("r")).alias("lo"), F.least(F.lit(span), "l").alias("hi")).filter("lo <= hi")
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    each = near.groupBy("row", "doc_id").agg(F.collect_list(F.struct("place", "gram", "lo", "hi")).alias("suffixes")).join(spans, "row", "left")
    opens = durable(each.mapInArrow(_left_open(min_words), "row bigint, doc_id bigint, place int, gram bigint, lo int, hi int"))
    if opens.isEmpty():
        return None
    freed(rows.sparkSession)
    # Written, so that the joins with them can split a key.
    grams = durable(opens.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("doc_id").alias("top")))
    own = opens.select("row", "place", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    asked = suffixes.select("row", "doc_id", "place", "gram").join(grams, "gram").filter("doc_id <= top").join(own, ["row", "place"], "left")
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("place", "lo", "hi", "own_lo", "own_hi")).alias("suffixes"))
    windows = durable(rows.select("row", "doc_id", "z", "size").join(asked, "row").mapInArrow(_windows(min_words), "h bigint, row bigint, doc_id bigint, start int, mine boolean"))
    freed(rows.sparkSession)
    first = durable(windows.groupBy("h").agg(F.min(F.struct("doc_id", "row", "start")).alias("a"), F.max(F.when(F.col("mine"), F.col("doc_id"))).alias("b")).filter("b > a.doc_id").select("h", "a"))
    met = windows.filter("mine").join(first, "h").filter("doc_id > a.doc_id")
    seeds = met.select(F.col("a.row").alias("row_a"), F.col("a.doc_id").alias("doc_a"), F.col("row").alias("row_b"), F.col("doc_id").alias("doc_b"), (F.col("start") - F.col("a.start")).alias("d"), F.col("start").alias("p"))
    return _seeded(seeds)


_PAIRS = "row_a bigint, doc_id_a bigint, place_a int, gram_a bigint, row_b bigint, doc_id_b bigint, place_b int, gram_b bigint, kind int, seq int, alone boolean, shared int"


def _kept_suffixes(rows: DataFrame) -> DataFrame:
    """row, kept (place, gram): suffixes whose first words start in two documents at least."""
    each = rows.select("row", "doc_id", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("row", "doc_id", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    # Written, so that the join with it can split a gram that very many documents share.
    shared = durable(each.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("gram"))
    return durable(each.join(shared, "gram").groupBy("row").agg(F.collect_list(F.struct("place", "gram")).alias("kept")))


def _run_seeds(rows: DataFrame, min_words: int) -> DataFrame:
    """Seeds for runs of one word: every window in a run stands in any other of the word, so each meets that of the smallest document, piece by piece."""
    each = rows.select("row", "doc_id", F.explode(F.arrays_zip("run_grams", "run_places", "run_words")).alias("x")).select("row", "doc_id", "x.*")
    first = durable(each.groupBy("run_grams").agg(F.min(F.struct("doc_id", "row", "run_places")).alias("a")))
    met = each.join(first, "run_grams").filter("doc_id > a.doc_id")
    end = F.col("run_places") + F.col("run_words") - min_words
    places = F.array_distinct(F.array_append(F.sequence("run_places", end, F.lit(min_words)), end))
    return met.select(F.col("a.row").alias("row_a"), F.col("a.doc_id").alias("doc_a"), F.col("row").alias("row_b"), F.col("doc_id").alias("doc_b"), F.col("a.run_places").alias("p0"), F.explode(places).alias("p")).select("row_a", "doc_a", "row_b", "doc_b", (F.col("p") - F.col("p0")).alias("d"), "p")


def _sorted_pairs(suffixes: DataFrame, order: list[str]) -> DataFrame:
    parts = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // _SORTED)  # a task holds a partition
    keys = ["gram", *order, "doc_id", "row", "place"]
    # The row and place at the end of the key let a suffix that stands in very many documents be cut anywhere.
    dealt = suffixes.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    found = durable(dealt.select("row", "doc_id", "place", "gram", F.xxhash64(*order).alias("key"), *(F.col(c).alias(f"b{i}") for i, c in enumerate(order[: len(STEPS)]))).mapInArrow(_neighbours, _PAIRS).withColumn("part", F.spark_partition_id()))
    # A few rows a partition: the borders are running minima of document ids in the order of hashes of words, which
    # number the logarithm of the partition's rows; equal words stand once.
    borders: dict[int, tuple[list, list, bool]] = {}
    for x in found.filter("kind > 0").orderBy("part", "seq").collect():
        borders.setdefault(x["part"], ([], [], x["alone"]))[x["kind"] - 1].append(tuple(x[:4]))
    met = [(*x, *y, 0, 0, None, None, 0) for x, y in across([borders[p] for p in sorted(borders)])]
    inner = found.filter("kind = 0")
    return inner.unionByName(suffixes.sparkSession.createDataFrame(met, found.schema)) if met else inner


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, start, n_words, source_id, source_start: passages of min_words words or more that a smaller doc_id has too.

    Words are runs of other characters than ASCII white space, places count words from 0. A passage that
    stands in many documents gives each of them but the first a row or a few, none of which lies in another of the same
    search, not a row for every other document. Rows that share a doc_id are one document here and not compared;
    null ids, null and short texts give no rows, nor does an empty table. min_words must be k + window - 1 at
    least, else ValueError. Further columns are ignored.
    """
    if min_words < k + window - 1:
        raise ValueError(f"min_words must be at least {k + window - 1}")
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = durable(source.mapInArrow(_sampled(k, window, min_words), "doc_id bigint, grams array<bigint>, places array<int>, run_grams array<bigint>, run_places array<int>, run_words array<int>, size bigint, z binary").withColumn("row", F.monotonically_increasing_id()))
    # From here on only texts that may share something.
    kept = _kept_suffixes(rows)
    freed(docs.sparkSession)
    rows = durable(rows.join(kept, "row", "left").filter("kept is not null or size(run_grams) > 0").drop("grams", "places"))
    del kept
    freed(docs.sparkSession)
    blocks = [*(f"r{i}" for i in range(len(STEPS))), *(f"l{i}" for i in range(len(STEPS)))]
    schema = "row bigint, doc_id bigint, place int, gram bigint, " + ", ".join(f"{b} bigint" for b in [*blocks, "around"])
    every = durable(rows.filter("kept is not null").select("row", "doc_id", "z", "size", "kept").mapInArrow(_blocks(k, min_words), schema))
    first = durable(every.groupBy("gram", "around").agg(F.min(F.struct("doc_id", "row", "place")).alias("x")))
    met = durable(every.join(first, ["gram", "around"]).select("row", "doc_id", "place", "gram", *blocks, "x"))
    copies = met.filter("doc_id > x.doc_id").select(F.col("x.row").alias("row_a"), F.col("x.doc_id").alias("doc_a"), F.col("row").alias("row_b"), F.col("doc_id").alias("doc_b"), (F.col("place") - F.col("x.place")).alias("d"), F.col("place").alias("p"))
    suffixes = met.filter("doc_id = x.doc_id").drop("x")
    del every, first
    freed(docs.sparkSession)
    # Across borders the blocks shared are not known and count as all.
    ways = [_sorted_pairs(suffixes, order).withColumn(c, F.coalesce("shared", F.lit(len(STEPS)))) for c, order in (("right", blocks), ("left", blocks[len(STEPS) :] + blocks[: len(STEPS)]))]
    pairs = ways[0].unionByName(ways[1], allowMissingColumns=True)
    near = pairs.select(F.col("row_b").alias("row_a"), F.col("doc_id_b").alias("doc_a"), F.col("row_a").alias("row_b"), F.col("doc_id_a").alias("doc_b"), (F.col("place_a") - F.col("place_b")).alias("d"), F.col("place_a").alias("p"))
    seeds = _seeded(copies.unionByName(near).unionByName(_run_seeds(rows, min_words)))
    freed(docs.sparkSession)
    side = lambda s: rows.select(F.col("row").alias(f"row_{s}"), F.col("size").alias(f"size_{s}"), F.col("z").alias(f"z_{s}"))
    passage = "doc_id bigint, start int, n_words int, source_id bigint, source_start int, row bigint"
    extended = lambda x: x.join(side("a"), "row_a").join(side("b"), "row_b").sortWithinPartitions("row_b", "doc_a").mapInArrow(_extended(k, min_words), passage)
    found = durable(extended(seeds))
    freed(docs.sparkSession)
    more = _open_seeds(rows, suffixes, pairs, found, min_words, k)
    return (found if more is None else found.unionByName(extended(more))).drop("row").distinct()


def passages_removed(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: docs without the words on the given passages.

    A row for each row of docs with an id; words are joined by one space where something goes, other texts stay
    as they are. Null texts count as empty.
    """
    spans = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, gone_n, out = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                have = text.encode().split()
                gone = np.zeros(len(have), bool)
                for s in own or ():
                    gone[s["start"] : s["start"] + s["n_words"]] = True
                n.append(len(have))
                gone_n.append(int(gone.sum()))
                out.append(b" ".join([w for w, g in zip(have, gone.tolist(), strict=True) if not g]).decode() if gone.any() else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return texts.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
