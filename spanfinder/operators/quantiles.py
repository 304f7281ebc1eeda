"""Exact nearest-rank percentiles, histograms and the bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import let
from ..session import cut_lineage
from .ordered import null_safe_join, positions
from .sizing import at_most

BINS, BIN_ROWS = 128, 1 << 16
MOST_DELTAS = 1 << 20


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, p: dict[str, float], digits: int | None = 1, rows: int = BIN_ROWS) -> DataFrame:
    """sorted[min(n - 1, int(n * p))] per group for every named p, with the row count `n`.

    Rows are counted per distinct value; `wanted_bins` narrows every wanted rank down to a bin of at most `rows` distinct values,
    and only these bins are sorted. NaN counts as the greatest value.
    """
    keys = list(by)
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = cut_lineage(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    bins = wanted_bins(counted, keys, p, rows)
    inside = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        _join_by(counted, bins, keys)
        .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        .withColumn("_upto", F.sum("_c").over(inside) + F.col("_before"))
        .filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
    )
    out = F.round("_v", digits) if digits is not None else F.col("_v")
    cols = [F.max(F.when(F.col("_name") == name, out)).alias(name) for name in p]
    grouped = found.groupBy(*keys) if keys else found.groupBy()
    return grouped.agg(*cols, F.max("n").alias("n"))


def wanted_bins(counted: DataFrame, keys: list[str], p: dict[str, float], rows: int = BIN_ROWS) -> DataFrame:
    """(keys, _name, _rank, _lo, _hi, _before, _m, n): the range of values that holds every wanted rank, with the number of rows
    before it and of distinct values in it, which is `rows` at most.

    counted: (keys, _v, _c). A round cuts the ranges that are still too wide at BINS marks, approximate percentiles of their
    distinct values, and counts the parts exactly. Parts hold about as many values each, however far apart these lie.
    """
    spread = lambda d: d.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_m"), F.sum("_c").alias("_bc"))
    whole = spread(counted.groupBy(*keys)).withColumnRenamed("_bc", "n")
    ranks = F.array(*[F.struct(F.lit(name).alias("_name"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))).alias("_rank")) for name, q in p.items()])
    shape = [*keys, "_name", "_rank", "_lo", "_hi", "_before", "_m", "n"]
    bins = cut_lineage(whole.withColumn("_w", F.explode(ranks)).select("*", "_w.*").withColumn("_before", F.lit(0).cast("long")).select(*shape))
    wide = (F.col("_m") > rows) & (F.col("_lo") < F.col("_hi"))
    while not bins.filter(wide).isEmpty():
        todo = bins.filter(wide)
        named = todo.select(*keys, "_name", "_rank", "_lo", "_hi", "_before", "n")
        inside = _join_by(counted, named, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        marks = inside.groupBy(*keys, "_name").agg(F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], 10 * BINS).alias("_marks"))
        cut = null_safe_join(inside, marks, [*keys, "_name"])
        cut = cut.withColumn("_bin", F.size(F.filter("_marks", lambda m: m < F.col("_v")))).drop("_marks")
        sums = spread(cut.groupBy(*keys, "_name", "_rank", "_before", "n", "_bin"))
        upto = Window.partitionBy(*keys, "_name").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
        sums = sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_bc").over(upto), F.lit(0)))
        hit = sums.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bc")))
        bins = cut_lineage(bins.filter(~wide).select(*shape).unionByName(hit.select(*shape)))
    return bins


def _join_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join on `keys`; without keys the right side is the single row of a global aggregate."""
    if keys:
        return null_safe_join(left, right, keys)
    one = F.lit(1)
    return left.withColumn("_one", one).join(F.broadcast(right.withColumn("_one", one)), "_one").drop("_one")


def histogram(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound (le), the last bound being infinity (le = null)."""
    steps = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    grouped = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(*steps, F.count(F.lit(1)).alias("b_inf"))
    pairs = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit(None).cast("double").alias("le"), F.col("b_inf").alias("n")),
    )
    return grouped.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", F.col("p.n").alias("cumulative"))


def quantile_of_bins(bounds: Sequence[float], cumulative: Column, q: float) -> Column:
    """Quantile by linear interpolation inside the bucket that holds rank q * total.

    cumulative: array of counts, one per bound and one for infinity. A rank beyond the last bound
    gives the last bound.
    """
    last = float(bounds[-1])
    edges = [0.0, *[float(b) for b in bounds]]

    def value(counts: Column) -> Column:
        total = F.element_at(counts, -1)
        rank = F.lit(q) * total
        # from the last bound down, so that the first bound holding the rank decides
        out = F.lit(last)
        for i in reversed(range(len(bounds))):
            below = F.get(counts, F.lit(i - 1)) if i else F.lit(0)
            here = F.get(counts, F.lit(i)) - below
            inside = edges[i] + (edges[i + 1] - edges[i]) * F.when(here > 0, (rank - below) / here).otherwise(0.0)
            out = F.when(F.get(counts, F.lit(i)) >= rank, inside).otherwise(out)
        return F.when(total > 0, out)

    return let(cumulative, value)


def histogram_quantile(hist: DataFrame, by: Sequence[str], bounds: Sequence[float], q: float, out: str = "quantile") -> DataFrame:
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), "cumulative"))),
        lambda s: s["cumulative"],
    )
    return hist.groupBy(*by).agg(listed.alias("_c")).select(*by, quantile_of_bins(bounds, F.col("_c"), q).alias(out))


def paired_bootstrap(deltas: DataFrame, by: Sequence[str], key: str, delta: str = "delta", n: int = 1000, seed: int = 0) -> DataFrame:
    """Mean of the deltas with the 95 % percentile interval of n resampled means, per group.

    Draw i of replicate r takes element md5(seed:r:i) mod m of the deltas in md5(key) order. Up to MOST_DELTAS the deltas go
    to all tasks, each of which sends n partial sums per group; beyond, draws are joined to them.
    """
    keys = list(by)
    data = deltas.filter(F.col(delta).isNotNull()).select(
        *keys, F.col(delta).alias("_d"), F.md5(F.col(key).cast("string")).alias("_h"), F.col(key).alias("_k")
    )
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    if keys:
        numbered = positions(data, keys, ["_h", "_k"], bucket, "_i")
    else:
        numbered = positions(data.withColumn("_g", F.lit(0)), ["_g"], ["_h", "_k"], bucket, "_i")
    numbered = numbered.select(*keys, "_d", "_i")
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.avg("_d").alias("mean"))
    means = _drawn_here(numbered, sizes, keys, n, seed) if at_most(numbered, MOST_DELTAS) else _drawn_by_join(numbered, sizes, keys, n, seed)
    listed = means.groupBy(*keys).agg(F.array_sort(F.collect_list("_mean")).alias("_means"))
    lo = F.get("_means", F.lit(int(0.025 * (n - 1))))
    hi = F.get("_means", F.lit(int(0.975 * (n - 1))))
    out = _join_by(sizes, listed, keys).select(*keys, "m", "mean", lo.alias("lo"), hi.alias("hi"))
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def _drawn_here(numbered: DataFrame, sizes: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """(keys, _rep, _mean): a task draws for its slots and adds up, so no row exists per draw."""
    spark = numbered.sparkSession
    rows = numbered.orderBy(*keys, "_i").collect()  # MOST_DELTAS at the utmost
    deltas: dict[tuple, list[float]] = {}
    for r in rows:
        deltas.setdefault(tuple(r[k] for k in keys), []).append(r["_d"])
    shared = spark.sparkContext.broadcast({k: np.array(v, np.float64) for k, v in deltas.items()})
    out = T.StructType([numbered.schema[k] for k in keys] + [T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch[[*keys, "_i"]].itertuples(index=False):
                group, slot = tuple(row[:-1]), row[-1]
                d = shared.value[group]
                picks = [int(hashlib.md5(f"{seed}:{rep}:{slot}".encode()).hexdigest()[:8], 16) % len(d) for rep in range(n)]
                if group not in sums:
                    sums[group] = np.zeros(n)
                sums[group] += d[picks]
        if sums:
            yield pd.DataFrame([[*group, total.tolist()] for group, total in sums.items()], columns=[*keys, "_sums"])

    spread = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_i")
    parts = spread.mapInPandas(run, out).select(*keys, F.posexplode("_sums").alias("_rep", "_s"))
    total = parts.groupBy(*keys, "_rep").agg(F.sum("_s").alias("_s"))
    return _join_by(total, sizes.drop("mean"), keys).select(*keys, "_rep", (F.col("_s") / F.col("m")).alias("_mean"))


def _drawn_by_join(numbered: DataFrame, sizes: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """(keys, _rep, _mean) for more deltas than a task may hold."""
    draws = _join_by(numbered.select(*keys, F.col("_i").alias("_slot")), sizes, keys).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_slot").cast("string"))
    pick = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.col("m"))
    drawn = draws.select(*keys, "_rep", pick.alias("_i"))
    return null_safe_join(drawn, numbered, [*keys, "_i"]).groupBy(*keys, "_rep").agg(F.avg("_d").alias("_mean"))
