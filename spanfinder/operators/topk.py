"""Top-k per group, pooling of rows to segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The filter on row_number is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_first(score: str = "score", tie: str = "segment_id") -> list[Column]:
    return [F.col(score).desc(), F.col(tie).asc()]


def max_pool(hits: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    return hits.groupBy(*by).agg(F.max(score).alias(score))


def best_span(windows: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Max score per group with the span of the window that has it (earliest on ties)."""
    best = F.max(F.struct(F.col(score), (-F.col("start_s")).alias("neg"), F.col("end_s"))).alias("b")
    return windows.groupBy(*by).agg(best).select(
        *by, F.col(f"b.{score}").alias(score), (-F.col("b.neg")).alias("span_start"), F.col("b.end_s").alias("span_end")
    )


def pooled_topk(hits: DataFrame, k: int, over: int = 3, with_span: bool = False, tie: str = "row_id") -> DataFrame:
    """Nearest k * over rows per query, pooled to their segment, then the best k segments."""
    near = topk(hits, ["query_id"], best_first(tie=tie), k * over).drop("rank")
    keys = ["query_id", "segment_id"]
    pooled = best_span(near, keys) if with_span else max_pool(near, keys)
    return topk(pooled, ["query_id"], best_first(), k)
