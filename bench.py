"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from spanfinder.catalog import QUERIES
from spanfinder.session import session

HEADLINE = [
    "search_hybrid",
    "lane_dense_topk",
    "lane_lexical_topk",
    "lane_ocr_trigram",
    "fuse_weighted",
    "nms_hits",
    "metrics_ir",
    "experiment_agg_by_group",
    "paired_bootstrap",
    "hard_negatives",
    "build_segments",
    "depth_scores",
    "ngram_counts",
    "merge_lines",
    "asof_utterance",
    "assign_points",
    "latency_pct",
    "throughput",
    "job_counts_rollup",
    "stream_rate_5m",
    "stream_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    n_queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
                "search_ms_per_query": round(1000 * times["search_hybrid"] / n_queries, 2),
            }
        )
    )


if __name__ == "__main__":
    main()
