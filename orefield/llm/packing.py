"""Best-fit packing with certified bounds.

Pieces are dealt into partitions of bounded size and packed there by best-fit decreasing. Dual-feasible
functions give a lower bound on the bins a partition needs; where the packing meets it, the partition is
certified. Partitions with gaps exchange documents: their worst-filled bins (and each partition's last,
worst-filled one) travel whole to new partitions, where best-fit decreasing runs again over documents of
several origins; the new packing replaces the old one wherever it needs fewer bins.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, joined, slices

CAPACITY = 4096
END_ID = 1
CACHE = 700_000
PART = 50_000


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + i for i, b in enumerate(others)}


class _Ids(dict):
    """Token ids (little-endian unsigned 32-bit) of lower-case chunks between white space; bounded.

    The tokenizer splits a chunk into runs of letters, single digits and runs of other signs. A chunk that
    ends in punctuation is put together from its two parts, and a word of Latin letters goes straight to the
    tokenizer's model, in its byte-level alphabet; everything else takes the tokenizer's whole way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.latin = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

    def __missing__(self, chunk: bytes) -> bytes:
        base = chunk.rstrip(b".,;:!?")
        if base and len(base) < len(chunk) and b"'" not in chunk and base[-4:].decode("utf-8", "ignore")[-1:].lower().isalnum():
            ids = self[base] + self[chunk[len(base) :]]
        else:
            text = chunk.decode("utf-8", "replace")
            if self.latin(text):
                found = [t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(self.letters))]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = array("I", found).tobytes()
        if len(chunk) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


_LOADED: dict[str, _Ids] = {}


def token_bytes(raw: bytes, ids: _Ids) -> bytes:
    """Ids of a whole text. The tokenizer drops white space, so no token spans two chunks, and ignores case except in special tokens."""
    return b"".join(map(ids.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the columns in `carry`): a row for each piece of each row of docs.

    A document is its token ids and then end_id; null text counts as empty, so an empty document is one
    piece of length 1. Only documents over `capacity` are cut, at multiples of it. `tokenizer` is the path of
    a tokenizer that drops ASCII white space; the executors read it there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = _Ids(tokenizer)
        ids, end, step = _LOADED[tokenizer], np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches, "text"):
            raw, off = joined(batch.column("text"))
            data, out = raw.tobytes(), ([], [], [], [], [])
            for i in range(batch.num_rows):
                x = token_bytes(data[off[i] : off[i + 1]], ids) + end
                for piece, at in enumerate(range(0, len(x), step)):
                    part = x[at : at + step]
                    for o, v in zip(out, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        o.append(v)
            rows = pa.array(out[0], pa.int64())
            kept = [batch.column(c).take(rows) for c in ("doc_id", *carry)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out[1], pa.int32()), *(pa.array(o, pa.int64()) for o in out[2:])], names=["doc_id", *carry, "piece", "start", "length", "ids_crc32"])

    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *carry))
    return docs.select("doc_id", *carry, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{types}piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can go below: the best bound of two families of dual-feasible functions.

    f_a counts sizes over capacity - a as a whole bin, drops those below a and keeps the rest; combined with
    the sizes over one half, which exclude each other, it gives the bound L2. u_k rounds (k+1)x down to a
    multiple of 1/k, unless (k+1)x is whole.
    """
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return 0
    c, count = capacity, np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    value = np.arange(c + 1)
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * value)])
    a = np.arange(0, c // 2 + 1)
    top, half = c - a + 1, c // 2 + 1  # first size over c - a; first size over one half
    n1, n2, s2 = n[-1] - n[top], n[top] - n[half], s[top] - s[half]
    s3 = s[half] - s[a]
    best = int((n1 + n2 + np.maximum(0, -(-(s3 - (n2 * c - s2)) // c))).max())
    for k in range(2, 21):
        whole = (k + 1) * value % c == 0
        # over the common denominator k * c
        total = int((count * np.where(whole, k * value, c * ((k + 1) * value // c))).sum())
        best = max(best, -(-total // (k * c)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each size. Open bins lie in stacks by free space; a bit set of the stacks finds the tightest fit."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, made = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free ^= 1 << room
        else:
            b, room = made, capacity
            made += 1
        bins[i] = b
        room -= size
        if room:
            stacks[room].append(b)
            free |= 1 << room
    return bins


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack a partition; keep the bins that came with it if the new ones are no fewer. Marks the bins to exchange."""
    sizes = pdf["length"].to_numpy(np.int64)
    old, bins = pdf["bin"].to_numpy(np.int64), best_fit_decreasing(sizes, capacity)
    if (old >= 0).all():
        codes, inverse = np.unique(old, return_inverse=True)
        if len(codes) <= bins.max() + 1:
            bins = inverse
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    leave = np.zeros(len(fill), bool)
    if len(fill) > lower_bound(sizes, capacity):
        leave = fill < fill.mean()
    if fill.min() < capacity:
        leave[fill.argmin()] = True
    order = np.lexsort((pdf["piece"].to_numpy(), pdf["doc_id"].fillna(-1).to_numpy(), bins))
    ends = np.cumsum(sizes[order])
    first = np.concatenate([[0], np.cumsum(fill)])[:-1]
    offset = np.empty(len(sizes), np.int64)
    offset[order] = ends - sizes[order] - first[bins[order]]
    part = int(pdf["part"].iloc[0])
    return pdf.assign(bin=part * (1 << 24) + bins, offset=offset, leave=leave[bins])


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = 3, window: str | None = None) -> DataFrame:
    """The rows of `pieces` (doc_id, piece, length from 1 to capacity, and others) with sequence_id and offset.

    Pieces of full length are sequences of their own, so that at most one piece of a document is packed, however
    long it is. The others are dealt into partitions of about `part` rows by a hash of the row or, if `window` names
    a column of numbers, by stretches of `part` of these, so that a sequence holds neighbours; no number should
    stand for more than one document. Rows that are equal throughout are packed one by one. No row is lost; an
    empty table stays empty. A column named sequence_id, offset, part, bin or leave is replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "part", "bin", "leave")
    full = pieces.filter(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("bigint")).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    short = pieces.filter(F.col("length") != capacity)
    if window:
        key = F.floor(F.col(window) / part).cast("bigint")
        ends = short.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
        lowest, fresh = ends["a"] or 0, (ends["b"] or 0) + 1
    else:
        lowest, fresh = 0, max(1, -(-short.count() // part))
        key = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(fresh))
    state = short.withColumn("part", key - F.lit(lowest)).withColumn("bin", F.lit(-1).cast("bigint"))
    schema = T.StructType([*state.schema.fields, T.StructField("offset", T.LongType()), T.StructField("leave", T.BooleanType())])
    run = lambda pdf: _pack(pdf, capacity)
    state = durable(state.groupBy("part").applyInPandas(run, schema))
    fresh -= lowest  # the first number that no partition has
    done = state.filter(~F.col("leave"))
    pool = state.filter("leave")
    for turn in range(rounds):
        bins = pool.agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("n")).first()
        if bins["bins"] <= 1:
            break
        # Whole bins are dealt anew, by another hash in each round.
        wide = max(1, -(-bins["n"] // part))
        dealt = pool.drop("offset", "leave").withColumn("part", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(wide)) + F.lit(fresh))
        fresh += wide
        again = durable(dealt.groupBy("part").applyInPandas(run, schema))
        left = again.agg(F.count_distinct("bin").alias("bins")).first()["bins"]
        if left >= bins["bins"] and wide == 1:
            pool = again
            break
        done = done.unionByName(again.filter(~F.col("leave")))
        pool = again.filter("leave")
    packed = done.unionByName(pool).withColumnRenamed("bin", "sequence_id").drop("part", "leave")
    return packed.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, part: int = PART, rounds: int = 3) -> DataFrame:
    """Tokenise all documents and pack their pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty; repeated rows are packed as often as they stand there; a null doc_id is kept;
    an empty table gives no rows; further columns of docs are ignored.
    """
    return pack(durable(tokenised_pieces(docs, tokenizer, capacity, end_id)), capacity, part, rounds)
