"""Modular hashes of numbers and strings, trailing zeros, and the primes that they need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed multipliers and offsets of the nine hashes of distinct counting; a prime that all share, and a range below it: no table fills it.
FM_PRIME = (1 << 47) - 115
FM_RANGE = 1 << 46
FM_HASHES = [(421, 149), (1117, 859), (2221, 1433), (3361, 2113), (4127, 3019), (5003, 3559), (6133, 4421), (7211, 5303), (8269, 6131)]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    n += 1
    while not is_prime(n):
        n += 1
    return n


def modular_hash(x: Column, a: int, b: int, p: int, m: int) -> Column:
    """((a x + b) mod p) mod m; x is taken modulo p first, so nothing overflows."""
    return F.pmod(F.pmod(F.pmod(x.cast("bigint"), F.lit(p).cast("bigint")) * a + b, F.lit(p).cast("bigint")), F.lit(m).cast("bigint"))


def string_number(x: Column, p: int) -> Column:
    """The UTF-8 bytes of a string as one big-endian number, modulo p, by Horner's rule; the empty string is 0."""
    digits = F.hex(F.encode(x, "UTF-8"))
    at = F.sequence(F.lit(0), F.octet_length(x) - 1)
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    return F.when(F.octet_length(x) > 0, F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, i: F.pmod(acc * 256 + byte(i), F.lit(p).cast("bigint")))).otherwise(F.when(x.isNotNull(), F.lit(0).cast("bigint")))


def trailing_zeros(h: Column) -> Column:
    """Zeros at the end of the binary form; 0 itself counts 1."""
    return F.when(h == 0, F.lit(1)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")
