"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. Each chunk has two polynomial hashes (sum of byte * B^(n-1-i)
modulo a prime below 2^31), and hashes of neighbouring chunks combine as h(ab) = h(a) * B^|b| + h(b), so
the chunks of a huge document are hashed in parallel and put together by length-shifted arithmetic.
Texts of equal fingerprint and length are then compared byte for byte, chunk by chunk: the smallest and
the largest chunk at each place of a group are kept by a streaming aggregate, and the group's texts are
equal exactly if the two agree at every place. Groups that fail (hash collisions) are regrouped by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, joined, slices, whole

PRIMES = (2147483629, 2147483587)
BASES = (1000003771, 1618033999)
CHUNK = 1 << 16
HUGE = 1 << 24


def _powers(chunk: int) -> list[np.ndarray]:
    """B^(chunk-1) .. B^0 for both primes."""
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        have = np.ones(1, np.uint64)
        step = b
        while len(have) < chunk:
            have = np.concatenate([have, have * np.uint64(step) % np.uint64(p)])
            step = step * step % p
        out.append(have[:chunk][::-1].copy())
    return out


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (h1, h2, bytes) of the text whose halves have the fingerprints a and b."""
    return tuple((a[i] * pow(BASES[i], b[2], PRIMES[i]) + b[i]) % PRIMES[i] for i in (0, 1)) + (a[2] + b[2],)


def fingerprint(data: bytes | np.ndarray, powers: list[np.ndarray] | None = None) -> tuple[int, int, int]:
    """(h1, h2, bytes) of one text, hashed by chunks. At most 2^16 products below 2^39 are summed at once."""
    powers = powers or _powers(CHUNK)
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    size, out = len(powers[0]), (0, 0, 0)
    for at in range(0, len(raw), size):
        part = raw[at : at + size].astype(np.uint64) + np.uint64(1)
        n = len(part)
        out = combine(out, tuple(int(np.dot(part, w[size - n :]) % np.uint64(p)) for w, p in zip(powers, PRIMES, strict=True)) + (n,))
    return out


def _hashed(column: str, digest: bool, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK)
        for batch in slices(batches, column):
            raw, off = joined(batch.column(column))
            prints = [fingerprint(raw[a:b], powers) for a, b in zip(off[:-1], off[1:], strict=True)]
            cols = {c: batch.column(c) for c in carry}
            if digest:
                cols["text_sha256"] = pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)], pa.string())
            for i, c in enumerate(("h1", "h2", "n_bytes")):
                cols[c] = pa.array([x[i] for x in prints], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _shift(base: int, prime: int, n: Column) -> Column:
    """base^n modulo prime by the bits of n, in SQL: values stay below 2^62."""
    squares, b = [], base
    for _ in range(40):
        squares.append(b)
        b = b * b % prime
    out = F.lit(1).cast("bigint")
    for i, s in enumerate(squares):
        out = out * F.when(F.getbit(n, F.lit(i)) == 1, F.lit(s)).otherwise(F.lit(1)) % F.lit(prime)
    return out


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """doc_id, row_key, text_sha256, h1, h2, n_bytes for every row of docs.

    Texts over `huge` bytes go by chunks: each chunk is a row, dealt out by document and place, hashed
    alone, and the chunks' hashes are combined in order by one small aggregate for each document.
    """
    rows = docs.select("doc_id", whole().alias("text")).withColumn("row_key", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = rows.filter(F.octet_length("text") <= huge).mapInArrow(
        _hashed("text", True, ("doc_id", "row_key")), f"doc_id {kind}, row_key bigint, text_sha256 string, h1 bigint, h2 bigint, n_bytes bigint"
    )
    step = CHUNK * 64
    pieces = (
        rows.filter(F.octet_length("text") > huge)
        .select("doc_id", "row_key", F.sha2("text", 256).alias("text_sha256"), F.col("text").cast("binary").alias("data"))
        .select("doc_id", "row_key", "text_sha256", "data", F.explode(F.sequence(F.lit(0), F.floor((F.length("data") - 1) / step).cast("int"))).alias("place"))
        .select("doc_id", "row_key", "text_sha256", "place", F.substring("data", F.col("place") * step + 1, F.lit(step)).alias("data"))
        .repartition("row_key", "place")
        .mapInArrow(_hashed("data", False, ("doc_id", "row_key", "text_sha256", "place")), f"doc_id {kind}, row_key bigint, text_sha256 string, place int, h1 bigint, h2 bigint, n_bytes bigint")
    )
    parts = F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "n_bytes")))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("h1", "h2", "n_bytes")))
    fold = lambda a, x: F.struct(
        *(((a[f"h{i + 1}"] * _shift(BASES[i], PRIMES[i], x["n_bytes"]) + x[f"h{i + 1}"]) % PRIMES[i]).alias(f"h{i + 1}") for i in (0, 1)), (a["n_bytes"] + x["n_bytes"]).alias("n_bytes")
    )
    large = pieces.groupBy("doc_id", "row_key", "text_sha256").agg(F.aggregate(parts, zero, fold).alias("f")).select("doc_id", "row_key", "text_sha256", "f.*")
    return small.unionByName(large)


def exact_dedup(docs: DataFrame, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty and equals other
    empty ones; a null doc_id loses to any other; of rows that also share the doc_id exactly one has
    kept = true. An empty table gives no rows; further columns of docs are ignored.
    """
    prints = durable(fingerprints(docs, huge))
    key = ["h1", "h2", "n_bytes"]
    best = F.max(F.struct("doc_id", "row_key")).alias("best")
    groups = durable(prints.groupBy(*key).agg(best, F.count("*").alias("group_size")))  # so that the joins with it can split a group
    shape = lambda df: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_key") == F.col("best.row_key")).alias("kept"), "text_sha256")

    repeated = prints.join(groups.filter("group_size > 1").select(*key), key).select("doc_id", "text_sha256", *key).distinct()
    texts = docs.select(F.col("doc_id"), whole().alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    r = repeated.withColumnRenamed("doc_id", "r_id").withColumnRenamed("text_sha256", "r_sha")
    both = texts.join(r, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_sha256") == F.col("r_sha")))
    chunks = both.filter("n_bytes > 0").select(*key, F.col("text").cast("binary").alias("data")).select(
        *key, "data", F.explode(F.sequence(F.lit(0), F.floor((F.length("data") - 1) / chunk).cast("int"))).alias("place")
    ).select(*key, "place", F.substring("data", F.col("place") * chunk + 1, F.lit(chunk)).alias("part"))
    unequal = chunks.groupBy(*key, "place").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select(*key).distinct()
    unequal = durable(unequal)
    if unequal.isEmpty():
        return shape(prints.join(groups, key))
    # Collisions: these groups' texts are grouped by the text itself.
    good = shape(prints.join(groups, key).join(unequal, key, "left_anti"))
    odd = prints.join(unequal, key).withColumnRenamed("doc_id", "r_id").withColumnRenamed("text_sha256", "r_sha")
    true = texts.distinct().join(odd, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_sha256") == F.col("r_sha"))).select("doc_id", "row_key", "text_sha256", "text")
    true_groups = true.groupBy("text").agg(best, F.count("*").alias("group_size"))
    return good.unionByName(shape(true.join(true_groups, "text")))
