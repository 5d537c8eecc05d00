"""Substring deduplication on a compacted De Bruijn graph.

Nodes are (k-1)-grams of words, edges are k-grams (windows). Each edge is named by a source coordinate: a
place in a document of smaller id where the same window starts. A path of repeated edges does not branch
as long as each edge's source follows the source of the edge before it; such paths are compacted into one
row (document, start, edges, source document, source start). Equal paths of all documents are brought
together by a Spark aggregate, joined with the texts at both coordinates, and only those whose words agree
are removed.

Windows travel as 64-bit hashes in packed arrays, about nine bytes each, one row for each block of
documents and bucket. A window that a block holds in several documents leaves the block once, so a
passage that stands in a third of all documents costs a row per block, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, freed, joined, mixed, slices, trimmed, whole, window_hashes, word_hashes, words

K = 13
BLOCK = 8 << 20
PART = 96 << 20  # bytes of text whose windows a task holds
SORTED = 4 << 20  # windows that it sorts at a time

_FOUND = "target bigint, data binary"
_PATHS = "doc_id bigint, tag bigint, start int, n int, src_id bigint, src_tag bigint, src_start int"


def small_numbers(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers as bytes: 255 for each 255 in a number, then its rest."""
    q = x // 255
    ends = np.cumsum(q + 1)
    out = np.full(int(ends[-1]) if len(x) else 0, 255, np.uint8)
    out[ends - 1] = x % 255
    return out


def from_small_numbers(b: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(b != 255)
    return np.diff(np.concatenate([[0], np.cumsum(b.astype(np.int64))[ends]]))


def squeezed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueezed(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype) if b else np.zeros(0, dtype)


def _spread(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a key that hash partitioning deals to it."""
    have: dict[int, int] = {}
    for x in spark.range(n * 40).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect():
        have[x["p"]] = x["id"]
    return [have.get(p, p) for p in range(n)]


def _bundles(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, src: np.ndarray, src_tag: np.ndarray, src_pos: np.ndarray, keys: list[int]) -> pa.RecordBatch:
    """Found windows and their sources as one row for each partition of documents, however many documents it has."""
    to = (mixed(doc.view(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
    order = np.lexsort((pos, tag, doc, to))
    bounds = np.searchsorted(to[order], np.arange(len(keys) + 1))
    targets, data = [], []
    for key, a, b in zip(keys, bounds[:-1], bounds[1:], strict=True):
        if a < b:
            x = order[a:b]
            targets.append(key)
            data.append(squeezed(np.stack([np.diff(doc[x], prepend=0), tag[x], pos[x], src[x], src_tag[x], src_pos[x] - pos[x]]).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(targets, pa.int64()), pa.array(data, pa.binary())], names=["target", "data"])


def _sent(k: int, keys: list[int], seed: int):
    """Windows of each block: those met in a smaller document of the block are found; the others go to their buckets."""
    buckets = len(keys)
    names = ["bucket", "target", "data", "ids", "tags", "counts", "gaps", "high", "low"]
    binary = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            raw, off = joined(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
            start, end, first = words(raw, off)
            h = window_hashes(word_hashes(raw, start, end, seed), k)
            if not len(h):
                continue
            of = np.repeat(np.arange(len(ids)), np.diff(first))
            at = np.flatnonzero(of[: len(h)] == of[k - 1 :])
            h, of = h[at], of[at]
            pos = at - first[of]
            by_id = np.empty(len(ids), np.int64)
            by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            order = np.lexsort((by_id[of], h)) if (np.diff(by_id) < 0).any() else np.argsort(h, kind="stable")
            s = h[order]
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            head_of = order[np.flatnonzero(head)][np.cumsum(head) - 1]  # the group's first entry, for each entry in order
            later = ids[of[order]] > ids[of[head_of]]
            mine, theirs = order[later], head_of[later]
            found = _bundles(ids[of[mine]], tags[of[mine]], pos[mine], ids[of[theirs]], tags[of[theirs]], pos[theirs], keys)
            rest = np.ones(len(h), bool)
            rest[mine] = False
            h, of, pos = h[rest], of[rest], pos[rest]
            bucket = (h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            bounds = np.searchsorted(bucket[by], np.arange(buckets + 1).astype(np.uint64))
            rows: list[list] = [[] for _ in range(7)]
            for b in range(buckets):
                part = by[bounds[b] : bounds[b + 1]]
                if not len(part):
                    continue
                d, p = of[part], pos[part]
                new = np.ones(len(d), bool)
                new[1:] = np.diff(d) != 0
                heads = np.flatnonzero(new)
                gap = p.copy()
                gap[1:] -= np.where(new[1:], 0, p[:-1])
                docs_here = d[heads]
                hashes = h[part]
                for row, v in zip(rows, (keys[b], squeezed(np.diff(ids[docs_here], prepend=0)), squeezed(tags[docs_here]) if tags.any() else b"", squeezed(np.diff(np.append(heads, len(d))).astype(np.int32)), squeezed(small_numbers(gap)), (hashes >> np.uint64(32)).astype(np.uint32).tobytes(), hashes.astype(np.uint32).tobytes()), strict=True):
                    row.append(v)
            n, m = len(rows[0]), found.num_rows
            none = lambda n, t: pa.nulls(n, t)
            if m:
                spread = pa.array(np.asarray(keys, np.int64)[np.arange(m) % buckets], pa.int64())
                yield pa.RecordBatch.from_arrays([spread, *found.columns, *(none(m, binary) for _ in range(6))], names=names)
            for a in range(0, n, 16):
                part = [r[a : a + 16] for r in rows]
                c = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), none(c, pa.int64()), none(c, binary), *(pa.array(x, binary) for x in part[1:])], names=names)

    return run


_SENT = f"bucket bigint, {_FOUND}, ids binary, tags binary, counts binary, gaps binary, high binary, low binary"


def _met(keys: list[int], most: int):
    """Of each bucket: windows whose hash a smaller document also has, with that document's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            b = batch.column("bucket").to_numpy(zero_copy_only=False)
            plain = batch.column("low").is_null().to_numpy(zero_copy_only=False)
            if plain.any():
                yield batch.filter(pa.array(plain)).select(["target", "data"])
            for i in np.flatnonzero(~plain):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                counts = unsqueezed(get("counts"), np.int32)
                ids = np.cumsum(unsqueezed(get("ids"), np.int64))
                tags = unsqueezed(get("tags"), np.int64) if get("tags") else np.zeros(len(ids), np.int64)
                gap = from_small_numbers(unsqueezed(get("gaps"), np.uint8))
                total = np.cumsum(gap)
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                base = total[starts] - gap[starts]
                pos = (total - np.repeat(base, counts)).astype(np.int32)
                h = np.frombuffer(get("high"), np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(get("low"), np.uint32)
                held.setdefault(int(b[i]), []).append((h, np.repeat(ids, counts), np.repeat(tags, counts), pos))
        for key in list(held):
            pieces = held.pop(key)
            turns = -(-sum(len(x[0]) for x in pieces) // most)
            # By ranges of the hash within the bucket, so that what is sorted and looked up stays small.
            of = [(mixed(x[0]) >> np.uint64(40)) * np.uint64(turns) >> np.uint64(24) for x in pieces] if turns > 1 else []
            for turn in range(turns):
                at = [o == turn for o in of] if turns > 1 else [slice(None)] * len(pieces)
                h, ids, tags, pos = (np.concatenate(x) for x in zip(*(tuple(c[i] for c in x) for x, i in zip(pieces, at, strict=True)), strict=True))
                order = np.argsort(h, kind="stable")
                s = h[order]
                head = np.ones(len(s), bool)
                head[1:] = s[1:] != s[:-1]
                alone = head & np.append(head[1:], True)
                order, head = order[~alone], head[~alone]
                if not len(order):
                    continue
                group = np.cumsum(head) - 1
                order = order[np.lexsort((ids[order], group))]
                lead = order[np.flatnonzero(head)][group]
                later = ids[order] > ids[lead]
                mine, theirs = order[later], lead[later]
                yield _bundles(ids[mine], tags[mine], pos[mine], ids[theirs], tags[theirs], pos[theirs], keys)
        trimmed()

    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compact the found windows of a partition's documents: neighbours whose sources are neighbours too."""
    parts = [unsqueezed(x, np.int64).reshape(6, -1) for batch in batches for x in batch.column("data").to_pylist()]
    if not parts:
        return
    doc, tag, p, s, t, d = np.concatenate([np.vstack([np.cumsum(x[0]), x[1:]]) for x in parts], axis=1)
    o = np.lexsort((p, tag, doc))
    doc, tag, p, s, t, d = (x[o] for x in (doc, tag, p, s, t, d))
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 0) | (np.diff(tag) != 0) | (np.diff(doc) != 0)
    doc, tag, p, s, t, d = (x[new] for x in (doc, tag, p, s, t, d))
    cut = np.ones(len(p), bool)
    cut[1:] = (np.diff(p) != 1) | (np.diff(d) != 0) | (np.diff(s) != 0) | (np.diff(t) != 0) | (np.diff(tag) != 0) | (np.diff(doc) != 0)
    at = np.flatnonzero(cut)
    n = np.diff(np.append(at, len(p)))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    out = pa.RecordBatch.from_arrays([pa.array(x, ty, safe=True) for x, ty in zip((doc[at], tag[at], p[at], n, s[at], t[at], (p + d)[at]), types, strict=True)], names=["doc_id", "tag", "start", "n", "src_id", "src_tag", "src_start"])
    for i in range(0, out.num_rows, 50_000):
        yield out.slice(i, 50_000)


def repeated_paths(texts: DataFrame, k: int, seed: int) -> DataFrame:
    """Compacted paths of windows that a smaller document seems to have too (by hash), for texts (doc_id, tag, text)."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    keys = _spread(spark, n)
    sent = texts.mapInArrow(_sent(k, keys, seed), _SENT).repartition(n, "bucket")
    found = sent.mapInArrow(_met(keys, SORTED), _FOUND).repartition(n, "target")
    return durable(found.mapInArrow(_paths, _PATHS))


def _judged(k: int):
    """Of each document: its own result if all its paths hold, and the digest of the words on each asked-for path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, off = joined(batch.column("text"))
            data = raw.tobytes()
            out: list[list] = [[] for _ in range(10)]
            need = batch.column("need").to_pylist()
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            for i in range(batch.num_rows):
                have = data[off[i] : off[i + 1]].split()
                gone = np.zeros(len(have), bool)
                for x in need[i] or ():
                    a, n = x["start"], x["n"]
                    if x["own"]:
                        gone[a : a + n + k - 1] = True
                    digest = hashlib.blake2b(b" ".join(have[a : a + n + k - 1]), digest_size=16).digest()
                    for o, v in zip(out, (ids[i], tags[i], x["own"], n, x["src_id"], x["src_tag"], x["src_start"], digest, None, a), strict=True):
                        o.append(v)
                kept = b" ".join([w for w, g in zip(have, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(have)
                for o, v in zip(out, (ids[i], tags[i], None, len(have), None, None, int(gone.sum()), None, hashlib.sha256(kept).hexdigest(), None), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int32()), strict=True)], names=["doc_id", "tag", "own", "n", "src_id", "src_tag", "m", "digest", "kept_sha256", "start"])

    return run


_JUDGED = "doc_id bigint, tag bigint, own boolean, n int, src_id bigint, src_tag bigint, m int, digest binary, kept_sha256 string, start int"


def _judge(texts: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """Results and digests of all documents with the given paths, in one pass over the texts."""
    source = [F.col("src_id"), F.col("src_tag"), F.col("src_start")]
    own = paths.select("doc_id", "tag", F.struct(F.lit(True).alias("own"), "start", "n", *source).alias("x"))
    asked = paths.select(*source, "n").distinct().select(F.col("src_id").alias("doc_id"), F.col("src_tag").alias("tag"), F.struct(F.lit(False).alias("own"), F.col("src_start").alias("start"), "n", *source).alias("x"))
    need = own.unionByName(asked).groupBy("doc_id", "tag").agg(F.collect_list("x").alias("need"))
    need = need.withColumnRenamed("doc_id", "n_id").withColumnRenamed("tag", "n_tag")
    met = texts.join(need, (F.col("doc_id") == F.col("n_id")) & (F.col("tag") == F.col("n_tag")), "left").select("doc_id", "tag", "text", "need")
    return durable(met.mapInArrow(_judged(k), _JUDGED))


def substring_dedup(docs: DataFrame, k: int = K, turns: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of docs, with the words on repeated windows removed.

    Words are maximal runs of other characters than ASCII white space. A window is k consecutive words of one
    document; its words go if the same window also starts in a document of smaller doc_id, judged on the
    input. A null or blank text has no words and the hash of the empty text. A row with a null doc_id is
    neither smaller nor larger than another and stays whole. Rows that share a doc_id are not compared with
    each other. An empty table gives no rows; further columns are ignored.

    Should two different windows share a hash, the words at the two coordinates differ; such a path is not
    removed, and everything runs again under another hash seed (up to `turns` times), which finds what the
    collision hid. Removals of all turns, each verified, are united.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    known = rows.filter("doc_id is not null")
    tag = F.xxhash64("text")
    clash = known.select("doc_id", tag.alias("t")).groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a != b")
    texts = known.withColumn("tag", F.lit(0).cast("bigint") if clash.isEmpty() else tag).select("doc_id", "tag", "text")
    good = None
    for turn in range(turns):
        paths = repeated_paths(texts, k, turn)
        freed(paths.sparkSession)
        if good is not None:
            paths = paths.unionByName(good).distinct()
        judged = _judge(texts, paths, k)
        key = ["src_id", "src_tag", "src_start", "n"]
        digests = judged.filter("own is not null").withColumn("src_start", F.col("m"))
        odd = durable(digests.groupBy(*key).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high").select(*key))
        if odd.isEmpty():
            break
        # Keep the paths whose own digest agrees with their source's.
        source = digests.filter("not own").select(*key, F.col("digest").alias("source_digest")).distinct()
        good = durable(digests.filter("own").join(source, key).filter("digest = source_digest").select("doc_id", "tag", "start", "n", "src_id", "src_tag", "src_start"))
        judged = None
    if judged is None:
        judged = _judge(texts, good, k)
    result = judged.filter("own is null").select("doc_id", F.col("n").cast("bigint").alias("n_words"), F.col("m").cast("bigint").alias("n_removed"), "kept_sha256")
    blank = rows.filter("doc_id is null").withColumn("tag", F.lit(0).cast("bigint")).withColumn("need", F.lit(None).cast("array<struct<own:boolean,start:int,n:int,src_id:bigint,src_tag:bigint,src_start:int>>"))
    alone = blank.select("doc_id", "tag", "text", "need").mapInArrow(_judged(k), _JUDGED).select("doc_id", F.col("n").cast("bigint").alias("n_words"), F.col("m").cast("bigint").alias("n_removed"), "kept_sha256")
    return result.unionByName(alone)
