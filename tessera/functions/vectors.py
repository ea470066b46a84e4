"""Bit hashes and dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(v: Column) -> Column:
    n = F.size(v)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2 + 1).cast("int")
    return F.get(F.transform(F.array(F.sort_array(v)), lambda s: (F.element_at(s, low) + F.element_at(s, high)) / 2), F.lit(0))


def sign_words(v: Column, bits: int) -> Column:
    """Bits v[i] > median(v), packed into 64-bit words, first bit highest; the median is worked out once a vector, not once a bit."""

    def packed(m: Column) -> Column:
        def word(start: int) -> Column:
            return F.aggregate(F.slice(v, start + 1, 64), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x.cast("double") > m, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))

        return F.array(*(word(s) for s in range(0, bits, 64)))

    return F.get(F.transform(F.array(median(F.transform(v, lambda x: x.cast("double")))), packed), F.lit(0))


def hamming(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))


def bands(words: Column, bits: int, count: int) -> Column:
    """The bits in ``count`` disjoint runs: hashes within distance count - 1 agree on at least one of them."""
    size, extra = divmod(bits, count)
    text = F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), 64, "0")), "")
    out, at = [], 0
    for k in range(count):
        width = size + (k >= count - extra)
        out.append(F.substring(text, at + 1, width))
        at += width
    return F.array(*out)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(inner_product(d, d))
    return F.transform(d, lambda x: F.try_divide(x, norm))
