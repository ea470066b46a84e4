"""Seeded orders in integer arithmetic, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arithmetic_rank(key: Column, seed: int = 0) -> Column:
    """(key * 2654435761 + seed) mod 2**32, for any 64-bit key: it is reduced and multiplied in halves of 16 bits, so no product overflows."""
    factor, half, whole = F.lit(2654435761), F.lit(65536), F.lit(4294967296)
    rest = F.pmod(key.cast("bigint"), whole)
    high, low = F.shiftright(rest, 16), F.pmod(rest, half)
    return F.pmod(F.pmod(high * factor, half) * half + low * factor + F.pmod(F.lit(seed), whole), whole)


#: A prime below 2^31 and a multiplier, so that products and squares stay exact in 64 bits.
PRIME, FACTOR = 2147483647, 48271


def hashed(key: Column, seed: int = 0) -> Column:
    """A number of 0 .. PRIME - 1 from a whole number, by two rounds of squaring; for seeded draws."""
    prime = F.lit(PRIME)
    x = F.pmod(key.cast("bigint") + F.lit((seed * 7_919 + 12_345) % PRIME), prime)
    for turn in (1, 2):
        x = F.pmod(F.pmod(x * x, prime) * F.lit(FACTOR) + x + F.lit(turn * 1_000_003), prime)
    return x
