"""Interval, point and as-of joins without cross products.

Intervals are cut into time bins; rows meet by (group, bin) and the exact predicate decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running

BIN_S = 60.0


def _bins(lo: Column, hi: Column, width: float) -> Column:
    a, b = F.floor(lo / width), F.floor(hi / width)
    return F.sequence(a, F.greatest(a, b))


def point_in_interval(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str = "start_s", end: str = "end_s", width: float = BIN_S, how: str = "inner"
) -> DataFrame:
    """Points joined to the intervals with start <= t < end of their group."""
    binned = intervals.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
    placed = points.withColumn("_bin", F.floor(F.col(t) / width))
    keys = [*by, "_bin"]
    right = binned.select(*[F.col(c).alias(f"_r_{c}") for c in binned.columns])
    cond = [placed[k] == right[f"_r_{k}"] for k in keys]
    cond += [placed[t] >= right[f"_r_{start}"], placed[t] < right[f"_r_{end}"]]
    joined = placed.join(right, cond, how)
    return joined.select(
        *[placed[c] for c in points.columns], *[F.col(f"_r_{c}").alias(c) for c in intervals.columns if c not in points.columns]
    )


def overlap_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], start: str = "start_s", end: str = "end_s", pad_s: float = 0.0, width: float = BIN_S
) -> DataFrame:
    """Pairs of intervals of one group that overlap, the right ones widened by `pad_s`.

    Columns of the right side that exist on both sides are prefixed with r_. A pair is produced in its
    first shared bin only.
    """
    lo, hi = F.col(start) - pad_s, F.col(end) + pad_s
    lb = left.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
    rb = right.withColumn("_bin", F.explode(_bins(lo, hi, width))).withColumn("_lo", lo).withColumn("_hi", hi)
    named = {c: (f"r_{c}" if c in left.columns and c not in by else c) for c in right.columns}
    rb = rb.select(*[F.col(c).alias(named[c]) for c in right.columns], "_bin", "_lo", "_hi")
    first = F.greatest(F.floor(F.col(start) / width), F.floor(F.col("_lo") / width))
    return (
        lb.join(rb, [*by, "_bin"])
        .filter((F.col(start) < F.col("_hi")) & (F.col(end) > F.col("_lo")) & (F.col("_bin") == first))
        .drop("_bin", "_lo", "_hi")
    )


def assign_to_intervals(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, point_key: str, interval_key: str, width: float = BIN_S
) -> DataFrame:
    """(point, interval) with start <= t < end, else the interval whose centre is nearest.

    `by` is the unit of planning (video and chunk), so the nearest search stays inside a bounded group.
    """
    bounds = intervals.select(*by, F.col(interval_key).alias("_id"), F.col("start_s").alias("_a"), F.col("end_s").alias("_b"))
    listed = bounds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_a", "_b", "_id"))).alias("_ivs"))
    inside = F.get(F.filter("_ivs", lambda i: (i["_a"] <= F.col(t)) & (F.col(t) < i["_b"])), F.lit(0))
    nearest = F.array_min(
        F.transform("_ivs", lambda i: F.struct(F.abs((i["_a"] + i["_b"]) / 2 - F.col(t)).alias("d"), i["_a"].alias("a"), i["_id"].alias("id")))
    )
    return points.join(listed, list(by), "left").withColumn(
        interval_key, F.coalesce(inside["_id"], nearest["id"])
    ).drop("_ivs")


def frames_of_segments(frames: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Frames with start <= t < end per segment; a segment without any takes the frame nearest its centre.

    `by` names the chunk, whose frames are a bounded list. Returns (by..., segment_id, frames array in
    time order).
    """
    listed = frames.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("t_s", *[c for c in frames.columns if c not in by and c != "t_s"]))).alias("_fs")
    )
    inside = F.filter("_fs", lambda f: (f["t_s"] >= F.col("start_s")) & (f["t_s"] < F.col("end_s")))
    centre = (F.col("start_s") + F.col("end_s")) / 2
    near = F.array_min(F.transform("_fs", lambda f, i: F.struct(F.abs(f["t_s"] - centre).alias("d"), i.alias("i"))))
    chosen = F.when(F.size("_inside") > 0, F.col("_inside")).otherwise(F.array(F.get("_fs", near["i"])))
    return (
        segments.join(listed, list(by), "left")
        .withColumn("_inside", inside)
        .withColumn("frames", F.when(F.col("_fs").isNotNull(), chosen))
        .drop("_fs", "_inside")
    )


def asof_join(
    points: DataFrame,
    rows: DataFrame,
    by: Sequence[str],
    t: str,
    row_t: str,
    values: Sequence[str],
    width: float = 86_400.0,
) -> DataFrame:
    """Every point with the values of the last row at or before it in its group (null when none).

    One union ordered by (time, rows before points) and a blocked fill; group size does not matter.
    """
    keys = list(by)
    cols = [c for c in points.columns if c not in keys]
    kind = F.lit(1)
    left = points.select(*keys, F.col(t).alias("_t"), kind.alias("_kind"), F.struct(*cols).alias("_p"), F.lit(None).alias("_v"))
    right = rows.select(
        *keys, F.col(row_t).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).alias("_p"), F.struct(*values).alias("_v")
    )
    both = right.unionByName(left)
    # ties in time between rows: the greatest value wins, whatever the input order
    both = both.withColumn("_tie", F.to_json("_v"))
    filled = running(both, keys, ["_t", "_kind", "_tie"], F.floor(F.col("_t") / width), "_v", "last", "_last")
    return filled.filter("_kind = 1").select(
        *keys, *[F.col(f"_p.{c}").alias(c) for c in cols], *[F.col(f"_last.{v}").alias(v) for v in values]
    )
