"""Size checks behind every broadcast, and joins that spread hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 16


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has no more than `rows` rows; reads at most rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Inner equi join that splits every key of `big` over `salts` tasks.

    Rows of `big` pick a salt from their `spread` columns; rows of `small` are repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], is_small: bool) -> DataFrame:
    """Inner equi join: broadcast `small` when the caller has checked its size, else a salted shuffle join."""
    if is_small:
        return big.join(F.broadcast(small), list(keys))
    return salted_join(big, small, keys, spread)
