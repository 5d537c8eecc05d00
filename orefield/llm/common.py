"""What the operators share: durable intermediate tables, word hashes over Arrow buffers, input columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers of a local session may start in another folder; a cluster has the package installed.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: the session's own, or, only in a local session that names none, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orefield-"))
    return sc.getCheckpointDir()


ROWS = 2000  # whole texts that travel to Python workers at a time while a table is written
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder. Lost executors re-read it instead of re-running what lies upstream.

    While it is planned and written, Arrow batches have at most ROWS rows: buffers of ten thousand whole texts would stay
    in the native memory of executors.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(ROWS, int(before)) if int(before) > 0 else ROWS)
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_BATCH, before)


def packed(df: DataFrame, *without: str) -> Column:
    """All columns of df but some as one struct, so that no name among them can meet a name of the operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without))


def whole(text: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def trimmed() -> None:
    """Give memory that is free back to the system: a worker is used again and again, and would keep the peak of every task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` has about `most` bytes in each (a row more at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum([0, *lengths(batch.column(column))])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto
    trimmed()


def lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each string; null counts 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings in one buffer, and n + 1 offsets into it; null counts as empty."""
    array = array.cast(pa.large_string()) if pa.types.is_string(array.type) else array
    if array.null_count:
        array = array.fill_null("" if pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the strings: start byte, end byte (both into raw), and each string's first word.

    The third array has n + 1 entries: string i has the words first[i] to first[i + 1] - 1. A word never
    spans two strings. With fold, raw is lower-cased in A-Z by the caller through `folded`.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = _BLANK[raw]
    start = ~blank
    end = start.copy()
    start[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = ~blank[cuts]
    end[cuts - 1] = ~blank[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def folded(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _FOLD[raw]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    The bytes are taken eight at a time as a little-endian number (zero-padded), mixed in with the
    length, so the cost follows the bytes. Words of equal bytes have equal hashes wherever they stand.
    """
    size = end - start
    h = mixed((size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)))
    if not len(size):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    every = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    live = np.arange(len(size))
    at = 0
    while len(live):
        left = size[live] - at
        piece = np.ascontiguousarray(every[start[live] + at]).view("<u8").ravel()
        short = left < 8
        if short.any():
            piece[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mixed(h[live] ^ piece) + np.uint64(0x9E3779B97F4A7C15)
        live = live[left > 8]
        at += 8
    return h


#: Odd multipliers, one for each place in a window of words.
_ODD = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive word hashes (len(h) - k + 1 of them; none if fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * _ODD[i]
    return mixed(out)


def freed(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more, before the next large shuffle is written. Its cleaner works beside us, so it gets a moment."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
