"""Vector, hash, time and probability expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null when either vector has no length."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    n = l2_norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; compared in halves to stay inside bigint."""

    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b, null unless both exist."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6
