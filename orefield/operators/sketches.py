"""Sketches and samples: Flajolet-Martin, Bloom filter, bottom-k sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FM_HASHES, FM_PRIME, FM_RANGE, modular_hash, next_prime, trailing_zeros

BLOOM_PRIME = (1 << 31) - 1
BLOOM_BLOCK = 1 << 28  # bits of a block: larger filters have several, one of which a value's first hash chooses


def fm_aggregates(x: Column, modulus: int = FM_RANGE) -> list[Column]:
    """Nine aggregates r0..r8: the most trailing zeros of each hash of x."""
    return [F.max(trailing_zeros(modular_hash(x, a, b, FM_PRIME, modulus))).alias(f"r{i}") for i, (a, b) in enumerate(FM_HASHES)]


def fm_estimate(group: int = 3) -> Column:
    """The median over groups of the mean of 2^r within each group."""
    n = len(FM_HASHES) // group
    means = F.sort_array(F.array(*(sum((F.pow(F.lit(2.0), F.col(f"r{g * group + i}")) for i in range(group)), F.lit(0.0)) / group for g in range(n))))
    return F.element_at(means, n // 2 + 1) if n % 2 else (F.element_at(means, n // 2) + F.element_at(means, n // 2 + 1)) / 2


def fm_distinct(df: DataFrame, key: list[str], x: str, modulus: int = FM_RANGE) -> DataFrame:
    """Estimated and exact distinct values of x for each key."""
    return df.groupBy(*key).agg(*fm_aggregates(F.col(x), modulus), F.count_distinct(x).alias("n_exact")).select(*key, "n_exact", F.round(fm_estimate(), 6).alias("n_estimate"))


def bloom_size(n: int, fpp: float) -> tuple[int, int]:
    """Bits and hashes for n values at a false-positive probability."""
    m = max(8, math.ceil(-n * math.log(fpp) / math.log(2) ** 2))
    return m, max(1, round(-math.log2(fpp)))


def bloom_hashes(k: int) -> list[tuple[int, int]]:
    """k multipliers and offsets: primes some thousands apart."""
    return [(next_prime(10_007 * (i + 1)), 7919 * (i + 1)) for i in range(k)]


def bloom_positions(x: Column, m: int, k: int) -> Column:
    """k positions below m: y^2 + a y + b modulo a prime, y a multiple of x modulo the prime, within the block that x modulo another prime gives."""
    p = F.lit(BLOOM_PRIME).cast("bigint")
    y = F.pmod(F.pmod(x.cast("bigint"), p) * 48_271 + 11, p)
    blocks = -(-m // BLOOM_BLOCK)
    size = -(-m // blocks)
    at = [F.pmod(F.pmod(y * y + y * a + b, p), F.lit(size).cast("bigint")) for a, b in bloom_hashes(k)]
    return F.array(*(v if blocks == 1 else modular_hash(x, 8191, 131, FM_PRIME, blocks) * size + v for v in at))


def bloom_bits(df: DataFrame, x: str, m: int, k: int) -> DataFrame:
    """bit: the set positions, at most m rows however many values there are."""
    return df.filter(F.col(x).isNotNull()).select(F.explode(bloom_positions(F.col(x), m, k)).alias("bit")).distinct()


def bloom_probe(df: DataFrame, x: str, bits: DataFrame, m: int, k: int, keep: list[str]) -> DataFrame:
    """keep, flag: 1 if all positions of x are set, else 0; null and missing values get 0.

    Distinct values are probed and flags joined back, so a value that a third of all rows hold is probed once.
    """
    values = df.select(x).filter(F.col(x).isNotNull()).distinct()
    hits = values.select(x, F.explode(F.array_distinct(bloom_positions(F.col(x), m, k))).alias("bit")).join(bits.withColumn("hit", F.lit(1)), "bit", "left")
    flags = hits.groupBy(x).agg(F.min(F.coalesce("hit", F.lit(0))).alias("flag"))
    return df.select(*keep, x).join(flags, x, "left").select(*keep, F.coalesce("flag", F.lit(0)).alias("flag"))


def bloom_flags(df: DataFrame, x: str, seq: str, bits: DataFrame, m: int, k: int, insert_on_probe: bool = False) -> DataFrame:
    """seq, flag; with insert_on_probe a value also counts from its second probe on."""
    probed = bloom_probe(df, x, bits, m, k, [seq])
    if not insert_on_probe:
        return probed
    first = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.min(seq).alias("first"))
    again = df.join(first, x, "left").select(seq, F.coalesce(F.col(seq) > F.col("first"), F.lit(False)).alias("again"))
    return probed.join(again, seq).select(seq, F.when(F.col("again"), 1).otherwise(F.col("flag")).alias("flag"))


def seen_exact(df: DataFrame, x: str, base: DataFrame, keep: list[str]) -> DataFrame:
    """keep, flag: 1 if x is among base's values."""
    known = base.select(F.col(x)).distinct().withColumn("flag", F.lit(1))
    return df.select(*keep, x).join(known, x, "left").select(*keep, F.coalesce("flag", F.lit(0)).alias("flag"))


def bottom_k(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """A uniform sample of k rows: those with the smallest hash of key and seed. Samples of parts merge into that of the whole."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))).orderBy("_h", key).limit(k).drop("_h")


def top_tags(sample: DataFrame, n: int = 3) -> DataFrame:
    return sample.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)
