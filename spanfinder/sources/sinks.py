"""Idempotent table writes. A target is a parquet folder every executor can reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return False
    # a folder without data files holds no table yet
    return any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(target))


def new_rows(target: DataFrame | None, df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key of `df` (the first in `order`) that the target does not hold yet."""
    from ..operators.topk import topk

    first = topk(df, list(keys), list(order), 1, "_r").drop("_r") if order else df.dropDuplicates(list(keys))
    return first if target is None else first.join(target.select(*keys), list(keys), "left_anti")


def insert_if_absent(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column] = ()) -> None:
    """Append rows with unseen keys; importing the same rows again adds nothing."""
    spark = df.sparkSession
    target = spark.read.parquet(path) if table_exists(spark, path) else None
    new_rows(target, df, keys, order).write.mode("append").parquet(path)


def merged(target: DataFrame | None, df: DataFrame, keys: Sequence[str], recency: str) -> DataFrame:
    """Rows of both sides with the most recent one per key; `df` wins when equally recent."""
    from ..operators.topk import topk

    both = df.withColumn("_new", F.lit(1))
    if target is not None:
        both = both.unionByName(target.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    ranked = topk(both, list(keys), [F.col(recency).desc(), F.col("_new").desc()], 1, "_r")
    return ranked.drop("_r", "_new")


def upsert(df: DataFrame, path: str, keys: Sequence[str], recency: str, by: Sequence[str] = ()) -> None:
    """Merge by key into a versioned table. Only partitions with a changed or new row are written, and published in one step, so
    readers see the table before or after the merge."""
    spark = df.sparkSession
    if versions.state(spark, path) is None:
        versions.commit(merged(None, df, keys, recency), path, by)
    else:
        versions.change(spark, path, df, keys, lambda rows: merged(rows, df, keys, recency), fresh=df)


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Delete and insert by partition key in one commit: a repeated write leaves identical rows. Rows meet by partition before, so
    files are as many as the data needs, not one a task and partition; a large partition is spread over tasks."""
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_samples(df: DataFrame, path: str) -> None:
    """Append timing samples (name, value, source, ts)."""
    df.select("name", "value", "source", "ts").write.mode("append").parquet(path)


def without_videos(table: DataFrame, video_ids: DataFrame) -> DataFrame:
    return table.join(video_ids.select("video_id").distinct(), "video_id", "left_anti")


CHILD_TABLES: tuple[str, ...] = ("videos", "video_chunks", "utterances", "segments", "frames", "topics", "embeddings", "jobs")


def purge(spark: SparkSession, root: str, video_ids: DataFrame, tables: Sequence[str] = CHILD_TABLES) -> None:
    """Remove videos from the library and from all versioned tables that refer to them. Partitions without their rows are not
    written; a partition that loses all rows leaves the table."""
    for name in tables:
        path = f"{root}/{name}"
        if versions.state(spark, path) is not None:
            versions.change(spark, path, video_ids, ["video_id"], lambda rows: without_videos(rows, video_ids))


def reset_jobs(jobs: DataFrame, video_ids: DataFrame) -> DataFrame:
    """Dead and failed jobs of the videos go back to queued with their error state cleared."""
    hit = F.col("_v").isNotNull() & F.col("status").isin("dead", "failed")
    marked = jobs.join(video_ids.select("video_id", F.lit(1).alias("_v")).distinct(), "video_id", "left")
    cleared = {"last_error": "string", "locked_by": "string", "heartbeat_at": "timestamp"}
    out = marked.withColumn("attempts", F.when(hit, 0).otherwise(F.col("attempts")))
    for c, t in cleared.items():
        out = out.withColumn(c, F.when(hit, F.lit(None).cast(t)).otherwise(F.col(c)))
    return out.withColumn("status", F.when(hit, "queued").otherwise(F.col("status"))).drop("_v").select(*jobs.columns)


def reset_chunks(chunks: DataFrame, video_ids: DataFrame) -> DataFrame:
    """Failed chunks of the videos go back to pending."""
    hit = F.col("_v").isNotNull() & (F.col("status") == "failed")
    marked = chunks.join(video_ids.select("video_id", F.lit(1).alias("_v")).distinct(), "video_id", "left")
    out = marked.withColumn("error", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("error")))
    return out.withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).drop("_v").select(*chunks.columns)


def export_jsonl(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.write.mode("overwrite").json(path)


def passages_records(pairs: DataFrame) -> DataFrame:
    """Training pairs to one record per query: query, positive passage, ranked negatives."""
    rows = pairs.groupBy("query_id", "query").agg(
        F.max(F.when(F.col("label") == 1.0, F.col("passage"))).alias("positive"),
        F.array_compact(F.array_sort(F.collect_list(F.when(F.col("label") == 0.0, F.col("passage"))))).alias("negatives"),
    )
    return rows
