"""Stored experiment runs: written one row a query with nested JSON, scanned with types, and taken apart again.

A record holds a query's metrics, its hits in rank order and how each lane did. Whatever starts from a run (mining, router
training, reports) reads the records, joined to the queries and videos that still exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import METRICS, mine_negatives

RECORD = "query_id {id}, n_relevant int, first_rank int, metrics map<string,double>, hits string, lanes string, experiment string"
HITS = "array<struct<rank: int, video: string, segment_id: {id}, start_s: double, end_s: double, score: double>>"
LANES = "struct<attribution: map<string, struct<first_rank: int, hit10: double>>, unique: string, ceiling: boolean>"
LEDGER = "experiment string, status string, spec string, config string, n_queries long, overall string, at timestamp"


def records(results: DataFrame, hits: DataFrame) -> DataFrame:
    """One row a query: results (one run's `score_queries` with lanes, ceiling, unique_lane) with its hits as JSON.

    Hits are at most the run's limit per query. A query without hits has an empty list.
    """
    item = F.struct("rank", "video", "segment_id", "start_s", "end_s", "score")
    listed = hits.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("hits"))
    attribution = F.transform_values("lanes", lambda _, v: F.struct(v["first_rank"].cast("int").alias("first_rank"), v["hit10"].alias("hit10")))
    lanes = F.to_json(F.struct(attribution.alias("attribution"), F.col("unique_lane").alias("unique"), "ceiling"))
    metrics = F.create_map(*[c for m in METRICS for c in (F.lit(m), F.col(f"`{m}`").cast("double"))])
    rows = results.select("experiment", "query_id", F.col("n_relevant").cast("int").alias("n_relevant"), F.col("first_rank").cast("int").alias("first_rank"), metrics.alias("metrics"), lanes.alias("lanes"))
    return rows.join(listed, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit("[]"))).select("query_id", "n_relevant", "first_rank", "metrics", "hits", "lanes", "experiment")


def stored(spark: SparkSession, sink: str, experiment: str | None = None, ids: str = "string") -> DataFrame:
    """Typed scan of the records; with a name only that run's folder is read."""
    rows = spark.read.schema(RECORD.format(id=ids)).parquet(f"{sink}/records")
    return rows if experiment is None else rows.where(F.col("experiment") == experiment)


def ledger(spark: SparkSession, sink: str) -> DataFrame:
    """All runs with their last status, the settings as written."""
    return spark.read.schema(LEDGER).parquet(f"{sink}/experiments")


def explode_hits(rows: DataFrame, ids: str = "string") -> DataFrame:
    """(experiment, query_id, rank, video, segment_id, start_s, end_s, score) of stored records."""
    return rows.select("experiment", "query_id", F.inline(F.from_json("hits", HITS.format(id=ids))))


def explode_lanes(rows: DataFrame) -> DataFrame:
    """(experiment, query_id, lane, first_rank, hit10, is_unique, ceiling) of stored records."""
    parsed = rows.select("experiment", "query_id", F.from_json("lanes", LANES).alias("l"))
    flat = parsed.select("experiment", "query_id", F.explode("l.attribution").alias("lane", "a"), F.col("l.unique").alias("u"), "l.ceiling")
    return flat.select("experiment", "query_id", "lane", "a.first_rank", "a.hit10", F.coalesce(F.col("u") == F.col("lane"), F.lit(False)).alias("is_unique"), "ceiling")


def metric_columns(rows: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The stored metrics as columns again."""
    return rows.select("experiment", "query_id", "n_relevant", "first_rank", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])


def evaluated(rows: DataFrame, queries: DataFrame, dataset_videos: DataFrame, videos: DataFrame) -> DataFrame:
    """Records of queries whose clip is still linked to a video of the library, with the query's text and the clip's key."""
    q = queries.select("query_id", "dataset", "dataset_video_id", "text", "modality")
    dv = dataset_videos.select("dataset", "dataset_video_id", F.col("external_id").alias("video_key"), "video_id")
    return rows.join(q, "query_id").join(dv, ["dataset", "dataset_video_id"]).join(videos.select("video_id"), "video_id")


def mine_stored(rows: DataFrame, truth: DataFrame, segments: DataFrame, max_iou: float = 0.1, per_query: int = 5, ids: str = "string") -> DataFrame:
    """Hard negatives from stored records (one run's, after `evaluated`), with the positive of every query."""
    hits = explode_hits(rows, ids).drop("experiment")
    return mine_negatives(hits, truth.join(rows.select("query_id"), "query_id", "left_semi"), segments, max_iou, per_query)
