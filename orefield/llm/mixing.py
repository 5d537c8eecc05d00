"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of equal size. A fluid schedule serves all sources at once at rates in
proportion to their weights, those left going faster when one runs out. A block's release time is the floor
of the time at which the fluid schedule starts it, its deadline the ceiling of the time at which it ends (for
the j-th block of weight w, while all sources last, floor((j-1)/w) and ceil(j/w)); at each time the released
block with the earliest deadline is next. The fluid schedule fits in these windows, so the blocks do, and any
prefix of the mix differs from the fluid one by less than one block of each source. All in exact whole numbers.

The schedule follows from the sources' sizes, a step of some microseconds for each block of documents. One task makes
it as a stream, of which it holds a stretch for each source, and writes it to the shared folder, 8 bytes a block. It is
broadcast if it has at most SMALL blocks, else joined.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, packed

BLOCK = 64
MAX_SOURCES: int | None = None  # a caller may set a bound; there is none otherwise
SMALL = 4_000_000  # blocks of a schedule, or sources, whose table is broadcast: 32 MB
_BUCKET = 4096
_STRETCH = 512  # blocks of a source whose times are one row


def rates(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights as they are written in decimals; 0 for those below 0."""
    exact = [max(Fraction(repr(float(w))), Fraction(0)) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    return [int(w * scale) for w in exact]


class Fluid:
    """When the fluid schedule has served each source j blocks: sum of min(rate * v, blocks) at v = j / rate."""

    def __init__(self, blocks: list[int], rate: list[int]):
        ends: dict[Fraction, list[int]] = {}  # where sources run out: their blocks and rates
        for n, r in zip(blocks, rate, strict=True):
            x = ends.setdefault(Fraction(n, r), [0, 0])
            x[0] += n
            x[1] += r
        self.rate, self.ends = rate, sorted(ends)
        self.near = [float(v) for v in self.ends]
        done, left = 0, sum(rate)
        self.lines = [(done, left)]
        for v in self.ends:
            done, left = done + ends[v][0], left - ends[v][1]
            self.lines.append((done, left))

    def time(self, i: int, j: int) -> tuple[int, int]:
        """Floor and ceiling of the time."""
        r = self.rate[i]
        k = bisect_right(self.near, j / r)
        while k and j * self.ends[k - 1].denominator < self.ends[k - 1].numerator * r:
            k -= 1
        while k < len(self.ends) and j * self.ends[k].denominator > self.ends[k].numerator * r:
            k += 1
        done, left = self.lines[k]
        return done + left * j // r, done - (-left * j // r)


def order(blocks: list[int], rate: list[int]) -> Iterator[int]:
    """The source of the block at each time; blocks and rates are positive."""
    fluid = Fluid(blocks, rate)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    waiting = []  # release, deadline, source, block
    for i in range(len(blocks)):
        waiting.append((0, fluid.time(i, 1)[1], i, 1))
    heapq.heapify(waiting)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, i, j = heapq.heappop(ready)
        yield i
        if j < blocks[i]:
            heapq.heappush(waiting, (fluid.time(i, j)[0], fluid.time(i, j + 1)[1], i, j + 1))


def phases(blocks: list[int], rate: list[int]) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(source, first block, blocks, base, length, times after base) of all blocks, as they are scheduled: first of the sources with a rate, then of the others at equal rates."""
    base = 0
    for mine in ([i for i, r in enumerate(rate) if r], [i for i, r in enumerate(rate) if not r]):
        mine = [i for i in mine if blocks[i]]
        size = sum(blocks[i] for i in mine)
        held: dict[int, tuple[int, array]] = {}
        for t, k in enumerate(order([blocks[i] for i in mine], [rate[i] or 1 for i in mine])):
            first, own = held.setdefault(k, (0, array("q")))
            own.append(t)
            if len(own) == _STRETCH:
                yield mine[k], first, len(own), base, size, np.array(own)
                held[k] = (first + _STRETCH, array("q"))
        for k, (first, own) in held.items():
            if own:
                yield mine[k], first, len(own), base, size, np.array(own)
        base += size


def schedule(spark: SparkSession, names: list[str], blocks: list[int], rate: list[int]) -> DataFrame:
    """t (a source's name), stretch, times: when each block of a source has its turn, _STRETCH of them a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        for i, first, _, base, _, own in phases(blocks, rate):
            yield pa.RecordBatch.from_arrays([pa.array([names[i]]), pa.array([first // _STRETCH]), pa.array([base + own], pa.list_(pa.int64()))], names=["t", "stretch", "times"])

    return durable(spark.range(0, 1, 1, 1).mapInArrow(run, "t string, stretch bigint, times array<bigint>"))


def _beside(df: DataFrame, n: int) -> DataFrame:
    """A table of n numbers or short texts to join with: broadcast if it is small, whatever Spark knows of it."""
    return F.broadcast(df) if n <= SMALL else df


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block: int = BLOCK) -> DataFrame:
    """The rows of docs with mix_block (the block's time) and mix_place (0, 1, 2, .. but for short last blocks).

    Every row stays; the mix is the order of mix_place. `weights` gives target weights by source; sources
    without one get the smallest given weight. Without weights a source's weight is its number of rows to the
    power `temperature`. Sources of weight 0 or less come after all others. A null source is a source of its own, named like the empty string. Within a source the order is by a hash of
    doc_id; ties (repeated rows, null ids) in any order. A source has few documents in its last block, so
    places have gaps there. Any number of sources is allowed. An empty table stays empty; columns named mix_block or mix_place are replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(packed(docs, "mix_block", "mix_place").alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"), F.xxhash64("doc_id", F.lit("mix")).alias("order"))
    counts = rows.groupBy("s").count().orderBy("s").collect()
    if MAX_SOURCES is not None and len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names, sizes = [r["s"] for r in counts], [r["count"] for r in counts]
    if weights:
        least = min(weights.values())
        target = [weights.get(s, least) for s in names]
    else:
        target = [n**temperature for n in sizes]
    blocks = [-(-n // block) for n in sizes]
    times = schedule(spark, names, blocks, rates(target))
    # Number the documents of each source without bringing a source together: rows are numbered within
    # buckets of bounded size, and buckets are offset by the rows in those before.
    buckets = spark.createDataFrame(pa.table({"s": pa.array(names, pa.string()), "buckets": pa.array([max(1, -(-n // _BUCKET)) for n in sizes], pa.int64())}))
    dealt = rows.join(_beside(buckets, len(names)), "s").withColumn("bucket", F.pmod("order", "buckets")).drop("buckets")
    before = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = durable(dealt.groupBy("s", "bucket").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"))
    numbered = dealt.withColumn("no", F.row_number().over(W.partitionBy("s", "bucket").orderBy("order", "doc.doc_id"))).join(starts, ["s", "bucket"])
    numbered = numbered.withColumn("no", F.col("no") - 1 + F.col("start")).withColumn("j", F.floor(F.col("no") / block))
    met = numbered.join(_beside(times, sum(blocks)), (F.col("s") == F.col("t")) & (F.floor(F.col("j") / _STRETCH) == F.col("stretch")))
    time = F.get("times", (F.col("j") % _STRETCH).cast("int"))
    return met.select("doc", "no", time.alias("mix_block")).select("doc.*", "mix_block", (F.col("mix_block") * block + F.col("no") % block).alias("mix_place"))
