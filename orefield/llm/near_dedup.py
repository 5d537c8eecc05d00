"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, as 64-bit hashes. Each of several independent trees sends a
document from node to node: a node's own hash function picks the document's smallest shingle, and node and
shingle name the child. Similar sets choose the same child with the probability of their Jaccard
similarity. A node with few documents is a leaf; larger ones branch again, and what is still large at the
last level (documents that are alike) is handled in blocks. Documents of a leaf are compared exhaustively:
sizes and sketches tell which members have any hope, and full sets decide, by one product of incidence
matrices for a block.

Only connections matter, so a block gives the edges of a spanning forest, fewer than it has members, and never
all its pairs. A few trees go first and connect most groups; in all other leaves only members of different
components are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, folded, freed, joined, mixed, slices, trimmed, whole, window_hashes, word_hashes, words
from .components import components

SHINGLE, PERCENT = 5, 80
DEPTH, LEAF, BINS = 4, 200, 256
BYTES = 128 << 20  # of text that a task holds of a block; a leaf with more is dealt into blocks like one with many members
FIRST = 2  # trees whose leaves are compared first, so that the other trees meet groups of copies already connected
BITS = 15  # a bitmap has 2^BITS bits
BITMAPS = 64 << 20  # bytes of bitmaps that are broadcast at most
NODES = 1 << 20  # large nodes that are broadcast at most


_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def trees_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Trees so that a pair of this similarity shares a leaf in one of them with this probability, even at full depth."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))) if similarity < 1 else 1


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each string, A-Z lower-cased; fewer than k words are one shingle."""
    raw = folded(raw)
    start, end, first = words(raw, off)
    h = word_hashes(raw, start, end)
    w = window_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        elif b > a:
            out.append(mixed(window_hashes(h[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _profiles(k: int, trees: int, depth: int):
    """Of each document: set size, a 128-bit digest of its words in order, the nodes on its path in each tree, a sketch, the text squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches, "text"):
            raw, off = joined(batch.column("text"))
            sets = shingle_sets(raw, off, k)
            sizes = np.array([len(x) for x in sets])
            n, m = batch.num_rows, int((sizes > 0).sum())
            full = sizes[sizes > 0]
            x = np.concatenate(sets) if m else np.zeros(0, np.uint64)
            starts = np.concatenate([[0], np.cumsum(full)])[:-1].astype(np.int64)
            path = np.zeros((n, trees * depth), np.uint64)
            sketch = np.zeros((n, BINS), np.uint8)
            if m:
                rows = np.flatnonzero(sizes > 0)
                for t in range(trees):
                    node = mixed(np.full(m, t + 1, np.uint64))
                    for level in range(depth):
                        choose = np.repeat(mixed(node) | np.uint64(1), full)
                        node = mixed(node ^ np.minimum.reduceat(x * choose, starts)) + np.uint64(level + 1)
                        path[rows, t * depth + level] = node
                at = np.repeat(rows, full) * BINS + (x >> np.uint64(57)).astype(np.int64)
                head = np.ones(len(at), bool)
                head[1:] = at[1:] != at[:-1]
                sketch.ravel()[at[head]] = (mixed(x[head]) % np.uint64(255)).astype(np.uint8) + 1
            data = raw.tobytes()
            texts = [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            z = [codec.compress(t, asbytes=True) if t else b"" for t in texts]
            sig = np.frombuffer(b"".join(blake2b(b" ".join(t.translate(_LOW).split()), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
            flat = pa.array(path.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees * depth), flat), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(np.diff(off).astype(np.int64)), pa.array(z, pa.binary())],
                names=["key", "doc_id", "n", "s1", "s2", "path", "sketch", "size", "z"],
            )

    return run


def _large(leaf: int) -> Column:
    return (F.col("count") > leaf) | (F.col("bytes") > BYTES)


def _blocks_of(count: Column, size: Column, leaf: int) -> Column:
    """How many blocks so many members of so many bytes need."""
    return F.greatest(F.ceil(count / leaf), F.ceil(size / BYTES))


def _leaves(sets: DataFrame, trees: int, depth: int, leaf: int) -> DataFrame:
    """tree, node, vid, size, count, bytes: the members of the leaves with two members at least, with their texts' sizes and both sums."""
    paths = sets.select("vid", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("path", t * depth + 1, depth))).alias("tree", "p"))
    out, big, few = [], None, False
    for level in range(depth):
        rows = paths.select("tree", "vid", "size", F.col("p")[level].alias("node"), *([F.col("p")[level - 1].alias("up")] if level else []))
        if big is not None:
            up = big.select(F.col("node").alias("up"))
            rows = rows.join(F.broadcast(up) if few else up, "up", "left_semi").drop("up")
        counts = durable(rows.groupBy("node").agg(F.count("*").alias("count"), F.sum("size").alias("bytes")).filter("count > 1"))
        big = counts.filter(_large(leaf))
        out.append(rows.join(counts if level == depth - 1 else counts.filter(~_large(leaf)), "node").select("tree", "node", "vid", "size", "count", "bytes"))
        if level == depth - 1 or not (many := big.count()):
            break
        few = many <= NODES  # then rows of other nodes are not shuffled
    members = out[0]
    for x in out[1:]:
        members = members.unionByName(x)
    return durable(members)


def _among(df: DataFrame, vids: DataFrame, most: int = BITMAPS) -> DataFrame:
    """The rows of df whose vid is one of `vids`, without a shuffle of df: vids become exact bitmaps, which are broadcast. If those have more than `most` bytes, a join."""
    place = lambda c: F.shiftright(c, BITS)
    bits = vids.select("vid", place("vid").alias("place")).repartition("place").groupBy("place").agg(F.bitmap_construct_agg(F.col("vid").bitwiseAND((1 << BITS) - 1)).alias("bits"))
    bits = durable(bits)
    if bits.count() << BITS - 3 > most:
        return df.join(vids.select("vid").distinct(), "vid", "left_semi")
    at = F.col("vid").bitwiseAND((1 << BITS) - 1)
    byte = F.conv(F.hex(F.col("bits").substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(bits), (place("vid") == F.col("place")) & (F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1), "left_semi")


def _alike(n: np.ndarray, sketch: np.ndarray, n1: int, sketch1: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may be similar enough to one: by size, and by the share of equal bins (4.5 standard deviations of leeway)."""
    ok = (100 * np.minimum(n, n1) >= percent * np.maximum(n, n1)) & (n > 0)
    at = np.flatnonzero(ok)
    s = sketch[at]
    both = (s != 0) & (sketch1 != 0)
    shared, equal = both.sum(1), ((s == sketch1) & both).sum(1)
    p = percent / 100
    ok[at] = equal >= shared * p - 4.5 * np.sqrt(np.maximum(shared, 1) * p * (1 - p))
    return ok


class _Groups:
    """Runs of rows with equal keys in a stream of sorted record batches."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: list[str]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in self.keys]
            cut = np.zeros(batch.num_rows, bool)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            bounds = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)
        trimmed()


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)


_BLOCK = ["node", "kind", "i", "j"]


def _hopeful(percent: int):
    """Of each block: the members that may be alike to a member of another component, by size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _Groups(batches, _BLOCK):
            comp = t.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            n, s = t.column("n").to_numpy(), _sketches(t)
            some = np.zeros(len(n), bool)
            for p in range(len(n) - 1):
                rest = p + 1 + np.flatnonzero(comp[p + 1 :] != comp[p])
                mates = rest[_alike(n[rest], s[rest], n[p], s[p], percent)] if len(rest) else rest
                some[mates] = True
                some[p] |= len(mates) > 0
            if some.any():
                yield from t.select([*_BLOCK, "vid"]).filter(pa.array(some)).combine_chunks().to_batches()

    return run


def shared_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """|A & B| of all pairs of different sets, by products of incidence matrices over the elements that two sets have at least.

    Elements are taken by ranges of their hash, so that memory stays bounded for very large sets.
    """
    out = np.zeros((len(sets), len(sets)), np.int64)
    x, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(a) for a in sets])
    ranges = -(-len(x) // (1 << 21))
    part = (x >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)
    for r in range(ranges):
        here = np.flatnonzero(part == r) if ranges > 1 else slice(None)
        _, at, count = np.unique(x[here], return_inverse=True, return_counts=True)
        place = np.full(len(count), -1)
        place[count > 1] = np.arange((count > 1).sum())
        at, row = place[at], of[here]
        row, at = row[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for low in range(0, int((count > 1).sum()), columns):
            a, b = np.searchsorted(at, [low, low + columns])
            m = np.zeros((len(sets), columns), np.float32)
            m[row[a:b], at[a:b] - low] = 1
            out += (m @ m.T).astype(np.int64)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph, given as a symmetric matrix."""
    out, fresh = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(linked[at] & fresh).tolist()
            fresh[found] = False
            out += [(at, f) for f in found]
            queue += found
    return out


def _joined(z: list[bytes], sizes: list[int], k: int, percent: int, most: int = BYTES // 4) -> list[tuple[int, int]]:
    """Edges that connect what links connect among squeezed texts; all of them at once, or two groups of at most `most` bytes (a text at least) at a time."""
    codec = pa.Codec("zstd")

    def found(at: list[int]) -> list[tuple[int, int]]:
        texts = (codec.decompress(z[i], sizes[i], asbytes=True) for i in at)
        sets = [shingle_sets(np.frombuffer(x, np.uint8), np.array([0, len(x)]), k)[0] for x in texts]
        n, shared = np.array([len(x) for x in sets]), shared_counts(sets)
        return [(at[i], at[j]) for i, j in forest(100 * shared >= percent * (n[:, None] + n[None, :] - shared))]

    groups: list[list[int]] = [[]]
    held = 0
    for i, n in enumerate(sizes):
        if groups[-1] and held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(i)
        held += n
    if len(groups) <= 2:
        return found([*range(len(z))])
    return [e for x, y in combinations(groups, 2) for e in found(x + y)]


def _exact(k: int, percent: int):
    """Links of each block that connect all its members which links connect, from the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in _Groups(batches, _BLOCK):
            vid = t.column("vid").to_pylist()
            for i, j in _joined(t.column("z").to_pylist(), t.column("size").to_pylist(), k, percent):
                a.append(vid[i])
                b.append(vid[j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _linked(blocks: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what links connect within each block (node, kind, i, j) of members (vid, comp).

    Sketches go to all blocks of several components; full texts only to blocks, and for members, with some hope. Texts of others stay where they are.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "vid")
    schema = "node bigint, kind string, i bigint, j bigint, vid bigint"
    some = durable(dealt(blocks.select(*_BLOCK, "vid", "comp").join(sets.select("vid", "n", "sketch"), "vid")).mapInArrow(_hopeful(percent), schema))
    freed(sets.sparkSession)
    return durable(dealt(some.join(_among(sets.select("vid", "size", "z"), some), "vid")).mapInArrow(_exact(k, percent), "a bigint, b bigint"))


def _first_blocks(members: DataFrame, leaf: int) -> DataFrame:
    """Each leaf as a block; a large one dealt at random into several."""
    i = F.pmod(F.xxhash64("vid", "node"), _blocks_of(F.col("count"), F.col("bytes"), leaf))
    return members.select("node", F.lit("s").alias("kind"), i.alias("i"), F.lit(0).cast("bigint").alias("j"), "vid", F.col("vid").alias("comp"))


def _open_blocks(members: DataFrame, comps: DataFrame, leaf: int) -> DataFrame:
    """Blocks in which all members of a leaf meet that no link connects yet.

    A leaf of up to `leaf` members and BYTES of text is one block. In a larger one the members outside its largest component meet
    each other and all others, block by block; members of the largest component don't meet each other.
    """
    rows = durable(members.join(comps, "vid", "left").select("node", "vid", "size", "count", "bytes", F.coalesce("comp", "vid").alias("comp")))
    zero = F.lit(0).cast("bigint")
    small = rows.filter(~_large(leaf))
    open_ = small.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("node")
    small = small.join(open_, "node").select("node", F.lit("s").alias("kind"), zero.alias("i"), zero.alias("j"), "vid", "comp")
    large = rows.filter(_large(leaf))
    sizes = large.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    # Written, so that the join with it can split a node.
    main = sizes.groupBy("node").agg(F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    outer = _blocks_of(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s"), leaf)
    main = durable(main.select("node", F.col("m.comp").alias("main"), _blocks_of(F.col("m.c"), F.col("m.s"), leaf).alias("inner"), outer.alias("outer")).filter("outer > 0"))
    dealt = large.join(main, "node").withColumn("out", F.col("comp") != F.col("main"))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("vid"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))))
    upto = lambda n: F.sequence(zero, n - 1)
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))
    places = F.when(
        F.col("out"),
        F.concat(F.transform(upto(F.col("inner")), lambda j: block("g", F.col("sub"), j)), F.transform(upto(F.col("outer")), lambda j: block("o", F.least("sub", j), F.greatest("sub", j)))),
    ).otherwise(F.transform(upto(F.col("outer")), lambda i: block("g", i, F.col("sub"))))
    large = dealt.select("node", "vid", "comp", F.explode(places).alias("b")).select("node", "b.kind", "b.i", "b.j", "vid", "comp")
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, recall: float = 0.999, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs, of the classes of `near_classes`.

    component_id is the smallest doc_id of the class, and kept says that it is the row's own. A row with a null doc_id
    links others, but is never a component's name; without any other it has component_id null and is kept.
    """
    found = near_classes(docs, shingle, percent, recall, depth, leaf)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def near_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, recall: float = 0.999, depth: int = DEPTH, leaf: int = LEAF, key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id (its smallest doc_id): a row for each row of docs; with `key` its value too.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a document's set holds its
    distinct shingles of `shingle` words (fewer words: the whole sequence as one). Rows are linked if
    100 * |intersection| >= percent * |union|, and rows that links connect are a class. Null and blank texts have an
    empty set, no links and no class. Rows of equal words in equal order are one vertex. An empty table gives no rows; further columns are ignored.

    `recall` is the probability that a pair at the threshold meets in a leaf; closer pairs meet more surely. Before
    full sets are compared, sketches leave out pairs that look 4.5 standard deviations too far apart, which a pair
    at the threshold does with probability 3.4e-6. Full sets hold 64-bit hashes of the shingles.
    """
    trees = trees_for(percent / 100, recall, depth)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"), (F.lit(None).cast("int") if key is None else key).alias("key"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, doc_id bigint, n bigint, s1 bigint, s2 bigint, path array<bigint>, sketch binary, size bigint, z binary"
    rows = durable(source.mapInArrow(_profiles(shingle, trees, depth), schema).withColumn("row", F.monotonically_increasing_id()))
    same = ["n", "s1", "s2"]
    known = rows.filter("n > 0")
    # Equal texts are one vertex: the row with the smallest number stands for them. Equal sets of other texts meet in every tree.
    vertex = durable(known.groupBy(*same).agg(F.min("row").alias("vid"), F.min("doc_id").alias("low")))
    sets = known.withColumnRenamed("row", "vid")
    members = _leaves(_among(sets, vertex), trees, depth, leaf)
    comps = components(_linked(_first_blocks(members.filter(F.col("tree") < FIRST), leaf), sets, shingle, percent))
    freed(docs.sparkSession)
    more = _linked(_open_blocks(members, comps, leaf), sets, shingle, percent)
    comps = components(comps.select(F.col("vid").alias("a"), F.col("comp").alias("b")).unionByName(more))
    named = vertex.join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    names = durable(named.groupBy("comp").agg(F.min("low").alias("component_id")))  # so that the join with it can split a component
    classes = named.join(names, "comp").select(*same, F.col("comp").alias("class_id"), "component_id")
    met = rows.select("doc_id", *same, "key").join(classes, same, "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", *(["key"] if key is not None else []))
