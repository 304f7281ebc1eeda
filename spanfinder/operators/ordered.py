"""Ordered computations inside groups of any size.

A plain window puts a whole group into one task. Here each group is cut into blocks by a
deterministic block expression over the order key; a block is processed by one task and only one
summary row per block is ordered across the group. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000


def _struct(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: str,
    how: str,
    out: str,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running `sum`, `max` or `last` (ignoring nulls) of `value` per group in `order`.

    `block` must be non-decreasing in `order`. `reverse` runs from the end; `exclusive` leaves the
    current row out (sum only).
    """
    keys = list(by)
    marked = df.withColumn("_blk", block)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, "_blk").orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    blk_dir = F.col("_blk").desc() if reverse else F.col("_blk").asc()
    before = Window.partitionBy(*keys).orderBy(blk_dir).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    if how == "sum":
        local, total, carry = F.sum(v).over(inside), F.sum(v), F.sum("_tot").over(before)
        joined = F.coalesce(F.col("_carry"), F.lit(0)) + F.col("_loc")
        if exclusive:
            joined = joined - v
    elif how == "max":
        local, total, carry = F.max(v).over(inside), F.max(v), F.max("_tot").over(before)
        joined = F.greatest("_carry", "_loc")
    elif how == "last":
        pick = F.min_by if reverse else F.max_by
        local = F.last(v, ignorenulls=True).over(inside)
        total = pick(v, F.when(v.isNotNull(), _struct(order)))
        carry = F.last("_tot", ignorenulls=True).over(before)
        joined = F.coalesce("_loc", "_carry")
    else:
        raise ValueError(f"unknown running aggregate {how!r}")
    carries = (
        marked.groupBy(*keys, "_blk").agg(total.alias("_tot")).select(*keys, "_blk", carry.alias("_carry"))
    )
    return null_safe_join(marked.withColumn("_loc", local), carries, [*keys, "_blk"]).withColumn(out, joined).drop("_blk", "_loc", "_carry")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet null keys, as they do in a window; the keys of `left` stay."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, out: str = "pos") -> DataFrame:
    """0-based position of every row in its group."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running(ones, by, order, block, "_one", "sum", out, exclusive=True).drop("_one")


def halo_blocks(df: DataFrame, pos: str, left: int, right: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut rows into blocks of `rows` positions and repeat edge rows into the neighbour block.

    Adds `_blk` and `_core`; a window over (group, _blk) ordered by position then sees `left` rows
    before and `right` rows after every core row.
    """
    at = F.pmod(F.col(pos), F.lit(rows))
    own = F.floor(F.col(pos) / rows)
    copies = F.array_compact(
        F.array(
            own,
            F.when(at < right, own - 1),  # visible to rows that look ahead
            F.when(at >= rows - left, own + 1),  # visible to rows that look back
        )
    )
    return df.withColumn("_own", own).withColumn("_blk", F.explode(copies)).withColumn("_core", F.col("_blk") == F.col("_own")).drop("_own")


def neighbours(df: DataFrame, by: Sequence[str], pos: str, exprs: dict[str, tuple[str, int]], rows: int = BLOCK_ROWS) -> DataFrame:
    """Values of rows at a distance: name -> (column, offset); offset -1 is the previous row."""
    left = max([0] + [-o for _, o in exprs.values()])
    right = max([0] + [o for _, o in exprs.values()])
    w = Window.partitionBy(*by, "_blk").orderBy(pos)
    d = halo_blocks(df, pos, left, right, rows)
    for name, (col, offset) in exprs.items():
        d = d.withColumn(name, F.lag(col, -offset).over(w) if offset < 0 else F.lead(col, offset).over(w))
    return d.filter("_core").drop("_blk", "_core")


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, k: int, pos: str = "pos") -> DataFrame:
    """Every row of groups of at most k rows, else the rows at positions int(i * n / k), i < k."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    wanted = counts.select(
        *by,
        F.explode(
            F.array_distinct(
                F.when(F.col("_n") <= k, F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).otherwise(
                    F.transform(
                        F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                        lambda i: F.floor(i * (F.col("_n") / F.lit(k))),
                    )
                )
            )
        ).alias(pos),
    )
    return positions(df, by, order, block, pos).join(wanted, [*by, pos], "left_semi")


def spaced_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, k: int, pos: str = "pos") -> DataFrame:
    """As `even_sample`, but at rounded positions i * (n - 1) / (k - 1) so that both ends are kept."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    if k > 1:
        spread = F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("bigint")
        )
    else:
        spread = F.array(F.floor(n / 2))
    wanted = counts.select(
        *by,
        F.explode(
            F.array_distinct(F.when(n <= k, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(spread))
        ).alias(pos),
    )
    return positions(df, by, order, block, pos).join(wanted, [*by, pos], "left_semi")


def latest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Newest n rows: a distributed top-n, no full sort."""
    return df.orderBy(*order).limit(n)


def seeded_key(seed: int, col: Column) -> Column:
    """Engine-independent pseudo-random order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def seeded_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Rows of `n` distinct keys drawn by a seeded hash; every row of a chosen key comes along."""
    chosen = df.select(key).distinct().orderBy(seeded_key(seed, F.col(key)), key).limit(n)
    return df.join(chosen, key, "left_semi")
