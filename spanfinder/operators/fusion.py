"""Lane lists to one score per (query, segment)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE_COLUMNS = ["query_id", "lane", "segment_id", "score", "span_start", "span_end"]


def as_lane(hits: DataFrame, lane: str) -> DataFrame:
    """Uniform lane rows; lanes without spans get null ones."""
    for c in ("span_start", "span_end"):
        if c not in hits.columns:
            hits = hits.withColumn(c, F.lit(None).cast("double"))
    return hits.withColumn("lane", F.lit(lane)).select(*LANE_COLUMNS)


def union_lanes(lanes: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lanes)


def lane_rank(hits: DataFrame) -> DataFrame:
    """1-based rank in every lane of every query."""
    w = Window.partitionBy("query_id", "lane").orderBy(F.col("score").desc(), F.col("segment_id").asc())
    return hits.withColumn("rank", F.row_number().over(w))


def lane_minmax(hits: DataFrame) -> DataFrame:
    """Min-max score in every lane of every query; 1 when all scores are equal."""
    w = Window.partitionBy("query_id", "lane")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(hi - lo < 1e-9, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def contribution(method: str, rrf_k: int, weight: Column) -> Column:
    if method == "weighted":
        return weight * F.col("norm")
    if method == "rrf":
        return weight / (rrf_k + F.col("rank"))
    raise ValueError(f"unknown fusion {method!r} (weighted | rrf)")


def fuse(hits: DataFrame, plans: DataFrame, method: str = "weighted", rrf_k: int = 60) -> DataFrame:
    """Fused score per (query, segment) with the raw score, rank and span of every lane.

    hits: ranked lane rows, at most k per lane and query. plans: (query_id, weights).
    """
    scored = lane_minmax(lane_rank(hits)).join(plans.select("query_id", "weights"), "query_id")
    weight = F.coalesce(F.try_element_at("weights", F.col("lane")), F.lit(0.0))
    rows = scored.withColumn("part", contribution(method, rrf_k, weight))
    entry = lambda *cols: F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", *cols))))
    span = F.when(F.col("span_start").isNotNull(), F.struct("lane", F.struct("span_start", "span_end").alias("span")))
    fused = rows.groupBy("query_id", "segment_id").agg(
        F.sum("part").alias("fused"),
        entry("score").alias("signals"),
        entry("rank").alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(span))).alias("spans"),
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return fused.withColumn("total_candidates", n)
