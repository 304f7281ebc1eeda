"""Table functions for SQL users: `register` makes them callable by name.

    SELECT v.video_id, c.* FROM videos v, LATERAL plan_chunks(v.duration_s) c
    SELECT * FROM sample_windows(TABLE(SELECT * FROM chunks) PARTITION BY video_id ORDER BY chunk_index)

They plan as the column expressions of `media` do, a row or a video at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

CHUNK_S, TAIL_S = 60.0, 15.0
WINDOW_S, STRIDE_S = 8.0, 4.0


@udtf(returnType="chunk_index long, start_s double, end_s double")
class PlanChunks:
    """Chunks of a duration; a short rest goes to the last one. Null and non-positive durations have none."""

    def eval(self, duration_s: float) -> Iterator[tuple]:
        if duration_s is None or not duration_s > 0:
            return
        whole = max(1, math.floor(duration_s / CHUNK_S))
        n = whole + (1 if duration_s - whole * CHUNK_S >= TAIL_S else 0)
        for i in range(n):
            yield i, i * CHUNK_S, round(duration_s, 3) if i == n - 1 else (i + 1) * CHUNK_S


@udtf(returnType="video_id long, chunk_index long, window_index long, start_s double, end_s double, in_video long")
class SampleWindows:
    """Sampling windows of every chunk of a video, numbered within the chunk and through the video in the call's order."""

    def __init__(self):
        self.seen = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        frames = max(1, math.ceil(row["end_s"] - row["start_s"]))
        for k in range(max(0, math.ceil((frames - WINDOW_S) / STRIDE_S)) + 1):
            start = row["start_s"] + k * STRIDE_S
            yield row["video_id"], row["chunk_index"], k, start, min(start + WINDOW_S, row["start_s"] + frames), self.seen
            self.seen += 1


def register(spark: SparkSession) -> None:
    for name, function in (("plan_chunks", PlanChunks), ("sample_windows", SampleWindows)):
        spark.udtf.register(name, function)
