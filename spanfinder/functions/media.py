"""Expressions that cut media time: chunks, segments, sampling windows, keyframes.

Each fold runs over one bounded unit (a 60 s chunk, the frames of a segment).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import hamming, let


def plan_chunks(duration: Column, chunk_s: float = 60.0, min_tail_s: float = 15.0) -> Column:
    """Array of (index, start_s, end_s): fixed windows, a short tail is merged into the last chunk."""
    whole = F.greatest(F.lit(1), F.floor(duration / chunk_s).cast("int"))
    n = whole + F.when(duration - whole * chunk_s >= min_tail_s, 1).otherwise(0)
    chunks = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("index"),
            F.round(i * F.lit(chunk_s), 3).alias("start_s"),
            F.round(F.when(i == n - 1, duration).otherwise((i + 1) * F.lit(chunk_s)), 3).alias("end_s"),
        ),
    )
    return F.when(duration > 0, chunks)


def plan_scan_windows(
    duration: Column,
    window_s: float = 60.0,
    stride_s: float = 240.0,
    at_least: int = 4,
    at_most: int = 10,
    margin: float = 0.05,
) -> Column:
    """Evenly spaced windows over the middle of a video, dropped when shorter than 15 s."""
    n = F.greatest(F.lit(at_least), F.least(F.lit(at_most), F.bround(duration / stride_s).cast("int")))
    lo, hi = duration * margin, duration * (1 - margin)
    step = F.greatest(F.lit(window_s), (hi - lo) / n)
    spans = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("index"),
            (lo + i * step).alias("a"),
            F.least(lo + i * step + window_s, duration - 1).alias("b"),
        ),
    )
    return F.transform(
        F.filter(spans, lambda s: s["b"] - s["a"] >= 15),
        lambda s: F.struct(
            s["index"].alias("index"), F.round(s["a"], 2).alias("start_s"), F.round(s["b"], 2).alias("end_s")
        ),
    )


def plan_segments(
    chunk_start: Column,
    chunk_end: Column,
    utterance_ends: Column,
    target_s: float = 10.0,
    min_s: float = 6.0,
    max_s: float = 15.0,
) -> Column:
    """Contiguous (index, start_s, end_s) windows snapped to the utterance end nearest the target."""
    ends = F.array_distinct(F.transform(utterance_ends, lambda b: F.round(b, 3)))
    return let(ends, lambda bounds: _cut_at(bounds, chunk_start, chunk_end, target_s, min_s, max_s))


def _cut_at(bounds: Column, chunk_start: Column, chunk_end: Column, target_s: float, min_s: float, max_s: float) -> Column:
    one = F.struct(F.lit(0).alias("index"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"))
    start = F.struct(chunk_start.cast("double").alias("cur"), F.filter(F.array(one), lambda _: F.lit(False)).alias("segs"))
    # a window is never shorter than min_s except the last, so this many steps always reach the end
    most = F.greatest(F.lit(1), F.ceil((chunk_end - chunk_start) / min_s).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        cur = acc["cur"]
        inside = F.filter(bounds, lambda b: (b >= cur + min_s) & (b <= cur + max_s))
        best = F.array_min(
            F.transform(inside, lambda b: F.struct(F.abs(b - (cur + target_s)).alias("d"), b.alias("b")))
        )["b"]
        last = lambda e: F.when(chunk_end - e < min_s, chunk_end).otherwise(e).cast("double")
        end = let(F.least(F.coalesce(best, cur + target_s), chunk_end), last)

        def grown(end: Column) -> Column:
            seg = F.struct(
                F.size(acc["segs"]).alias("index"), F.round(cur, 3).alias("start_s"), F.round(end, 3).alias("end_s")
            )
            return F.struct(end.alias("cur"), F.array_append(acc["segs"], seg).alias("segs"))

        return F.when(cur < chunk_end - 0.5, let(end, grown)).otherwise(acc)

    segs = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["segs"])
    whole = F.array(
        F.struct(
            F.lit(0).alias("index"),
            chunk_start.cast("double").alias("start_s"),
            chunk_end.cast("double").alias("end_s"),
        )
    )
    return let(segs, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def sample_windows(
    frame_times: Column, window_s: float = 8.0, stride_s: float = 4.0, n_frames: int = 8
) -> Column:
    """Sliding (start_s, end_s, frames) windows with exactly n frame indexes each."""

    def windows_of(times: Column) -> Column:
        t0, last = F.get(times, F.lit(0)), F.element_at(times, -1) + 1.0
        # the window that reaches the end closes the list
        count = F.greatest(F.lit(0), F.ceil((last - t0 - window_s) / stride_s).cast("int"))

        def window(i: Column) -> Column:
            a = t0 + i * F.lit(stride_s)
            b = F.least(a + window_s, last)
            seen = F.transform(times, lambda t, p: F.when((t >= a) & (t < b), p))

            def picks(inside: Column) -> Column:
                end = F.size(inside) - 1
                spread = F.sequence(F.lit(0), F.lit(n_frames - 1))
                at = lambda j: F.least(end, F.bround(j * end / max(1, n_frames - 1)).cast("int"))
                return F.transform(spread, lambda j: F.get(inside, at(j)))

            return F.struct(a.alias("start_s"), b.alias("end_s"), let(F.array_compact(seen), picks).alias("frames"))

        def until_empty(ws: Column) -> Column:
            # a window without frames ends the scan
            empty = F.array_position(F.transform(ws, lambda w: F.get(w["frames"], F.lit(0)).isNull()), True)
            return F.when(empty > 0, F.slice(ws, 1, (empty - 1).cast("int"))).otherwise(ws)

        return let(F.transform(F.sequence(F.lit(0), count), window), until_empty)

    return F.when(F.size(frame_times) > 0, let(frame_times, windows_of))


def select_keyframes(frames: Column, min_distance: int = 8, max_gap_s: float = 8.0) -> Column:
    """Keep a frame that differs from the last kept one, or after `max_gap_s` without one.

    frames: array of structs with t_s and phash, in time order.
    """

    def step(kept: Column, f: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        changed = last.isNull() | (hamming(f["phash"], last["phash"]) >= min_distance)
        return F.when(changed | (f["t_s"] - last["t_s"] >= max_gap_s), F.array_append(kept, f)).otherwise(kept)

    return F.aggregate(frames, F.filter(frames, lambda f: F.lit(False)), step)


def pick_distinct(frames: Column, k: int = 3, min_distance: int = 6) -> Column:
    """Up to k frames that differ pairwise by at least `min_distance` bits."""

    def step(chosen: Column, f: Column) -> Column:
        distinct = F.forall(chosen, lambda c: hamming(f["phash"], c["phash"]) >= min_distance)
        return F.when((F.size(chosen) < k) & distinct, F.array_append(chosen, f)).otherwise(chosen)

    return F.aggregate(frames, F.filter(frames, lambda f: F.lit(False)), step)
