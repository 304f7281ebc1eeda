"""Operational analytics over the job log and timing samples. `now` is a parameter, so results repeat."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import seconds_between
from ..operators.quantiles import nearest_rank
from .library import CHUNK_JOBS

P = {"p50": 0.5, "p95": 0.95}


def cutoff(window_min: int, now: datetime) -> Column:
    if not 1 <= window_min <= 1440:
        raise ValueError("window_min must be between 1 and 1440")
    return F.lit(now) - F.expr(f"INTERVAL {int(window_min)} MINUTES")


def since(df: DataFrame, ts: str, window_min: int, now: datetime) -> DataFrame:
    return df.filter(F.col(ts) >= cutoff(window_min, now))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Counts by (queue, status) and, with queue null, by status: one pass."""
    d = jobs.groupingSets([["queue", "status"], ["status"]], "queue", "status").agg(F.count(F.lit(1)).alias("n"))
    return d.select("queue", "status", "n")


def throughput(chunks: DataFrame, jobs: DataFrame, window_min: int, now: datetime) -> DataFrame:
    """One row: indexed seconds against busy seconds of the trailing window."""
    done = since(chunks.filter("status = 'done'"), "done_at", window_min, now).agg(
        F.coalesce(F.sum(F.col("end_s") - F.col("start_s")), F.lit(0.0)).alias("indexed_s"),
        F.min("done_at").alias("_a"),
        F.max("done_at").alias("_b"),
        F.count(F.lit(1)).alias("chunks"),
    )
    busy = since(jobs.filter((F.col("status") == "succeeded") & F.col("type").isin(*CHUNK_JOBS)), "finished_at", window_min, now).agg(
        F.coalesce(F.sum(seconds_between(F.col("started_at"), F.col("finished_at"))), F.lit(0.0)).alias("busy_s")
    )
    one = F.lit(1)
    d = done.withColumn("_k", one).join(busy.withColumn("_k", one), "_k")
    wall = F.when(F.col("chunks") > 1, seconds_between(F.col("_a"), F.col("_b")))
    factor = F.when(F.col("busy_s") > 0, F.col("indexed_s") / F.col("busy_s"))
    return d.select(
        F.round("indexed_s", 1).alias("indexed_video_seconds"),
        "chunks",
        F.round("busy_s", 1).alias("worker_busy_seconds"),
        F.round(factor, 2).alias("realtime_factor"),
        F.round(F.when(wall > 0, wall), 1).alias("wall_seconds"),
        F.round(F.when(F.col("indexed_s") > 0, 3600 / factor), 0).alias("seconds_to_index_one_hour"),
    )


def latency_summary(videos: DataFrame) -> DataFrame:
    """p50, p95 and n of time to first searchable, index wall time and wall time per hour of video."""
    ttfs = videos.select(F.lit("first_searchable").alias("measure"), seconds_between(F.col("upload_completed_at"), F.col("first_searchable_at")).alias("v"))
    wall_v = seconds_between(F.col("upload_completed_at"), F.col("completed_at"))
    ready = videos.filter((F.col("status") == "ready") & (F.col("duration_s") > 0))
    wall = ready.select(F.lit("index_wall").alias("measure"), wall_v.alias("v"))
    hour = ready.select(F.lit("per_hour").alias("measure"), (wall_v / F.col("duration_s") * 3600).alias("v"))
    return nearest_rank(ttfs.unionByName(wall).unionByName(hour), ["measure"], "v", P)


def sample_summary(samples: DataFrame, window_min: int, now: datetime, newest: int | None = None) -> DataFrame:
    """p50, p95 and n per sample name of the window, with the kind split off; of the `newest` samples alone if that is given."""
    recent = since(samples, "ts", window_min, now)
    if newest is not None:
        recent = recent.orderBy(F.col("id").desc()).limit(newest)
    named = recent.filter(F.col("name").startswith("infer.") | F.col("name").startswith("job.") | (F.col("name") == "search.total"))
    d = nearest_rank(named, ["name"], "value", P)
    return d.select(F.substring_index("name", ".", 1).alias("kind"), F.regexp_replace("name", r"^[^.]*\.", "").alias("name"), "p50", "p95", "n")


def worker_activity(jobs: DataFrame, window_min: int, now: datetime) -> DataFrame:
    seen = F.coalesce("finished_at", "heartbeat_at", "started_at")
    d = jobs.filter(F.col("locked_by").isNotNull()).withColumn("_seen", seen)
    return since(d, "_seen", window_min, now).groupBy("locked_by").agg(
        F.max("_seen").alias("last_seen"), F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "running").alias("running")
    )


def retries_total(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"))


def recent_failures(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.filter(F.col("last_error").isNotNull()).orderBy(F.coalesce("finished_at", "created_at").desc(), "id").limit(n)


def job_log(jobs: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    d = jobs.filter(F.col("status") == status) if status else jobs
    return d.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def reap_stale(jobs: DataFrame, now: datetime, timeout_s: int = 90) -> DataFrame:
    """Running jobs without a heartbeat for `timeout_s`: queued again, or dead at their last attempt."""
    silent = (F.col("status") == "running") & (F.col("heartbeat_at") < F.lit(now) - F.expr(f"INTERVAL {int(timeout_s)} SECONDS"))
    why = F.concat(F.lit("lease expired: worker "), F.coalesce("locked_by", F.lit("?")), F.lit(" went silent"))
    d = jobs.withColumn("_s", F.coalesce(silent, F.lit(False)))
    return (
        d.withColumn("status", F.when(F.col("_s"), F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("queued")).otherwise(F.col("status")))
        .withColumn("last_error", F.when(F.col("_s"), why).otherwise(F.col("last_error")))
        .withColumn("locked_by", F.when(~F.col("_s"), F.col("locked_by")))
        .withColumn("heartbeat_at", F.when(~F.col("_s"), F.col("heartbeat_at")))
        .drop("_s")
    )


def ops_summary(jobs: DataFrame, chunks: DataFrame, videos: DataFrame, samples: DataFrame, window_min: int, now: datetime) -> dict[str, DataFrame]:
    """All panels of the operations page as tables."""
    return {
        "jobs": job_counts(jobs),
        "retries": retries_total(jobs),
        "videos": videos.groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "throughput": throughput(chunks, jobs, window_min, now),
        "latency": latency_summary(videos),
        "samples": sample_summary(samples, window_min, now),
        "workers": worker_activity(jobs, window_min, now),
        "failures": recent_failures(jobs),
    }
