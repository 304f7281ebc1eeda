"""Scoring of ranked lists against labelled spans, aggregation and comparison of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExperimentSpec, SearchConfig
from ..functions import fixed_values as V
from ..functions import spans as S
from ..operators.ordered import positions, seeded_key, seeded_subset
from ..operators.quantiles import nearest_rank, paired_bootstrap
from ..operators.sizing import salted_join
from ..session import cut_lineage

OVERLAP_METRICS = ["mrr", "ndcg@10", "recall@1", "recall@5", "recall@10", "hit@1", "hit@5", "hit@10"]
TEMPORAL_METRICS = ["r1@0.5", "r1@0.7", "r5@0.5", "r5@0.7", "map@0.5", "map@0.75", "map"]
METRICS = OVERLAP_METRICS + TEMPORAL_METRICS

SPAN = ("video", "start_s", "end_s")


def load_queries(queries: DataFrame, dataset_videos: DataFrame, videos: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Evaluable queries of a split: linked to a ready video, optionally a subset by id or by video."""
    q = queries.filter((F.col("dataset") == spec.dataset) & (F.col("split") == spec.split))
    dv = dataset_videos.filter(F.col("dataset") == spec.dataset).select("dataset_video_id", F.col("external_id").alias("video_key"), "video_id")
    rows = q.join(dv, "dataset_video_id").join(videos.select("video_id", F.col("status").alias("video_status")), "video_id")
    if "ids" in spec.subset:
        rows = rows.filter(F.col("external_id").isin([str(i) for i in spec.subset["ids"]]))
    elif spec.subset.get("limit"):
        rows = seeded_subset(rows, "video_key", int(spec.subset["limit"]), int(spec.subset.get("seed", 0)))
    ready = rows.filter(F.col("video_status") == "ready").drop("video_status")
    return ready.withColumn("modality", F.coalesce("modality", F.lit("all")))


def restrict(queries: DataFrame, corpus, cfg: SearchConfig, scope: str):
    """(corpus, scope pairs, config) for queries that see their own clip, the split's clips, or everything.

    The split's clips are the same for all queries, so the corpus itself is filtered; when there is only
    one clip, the cap on hits per video is lifted.
    """
    if scope == "video":
        return corpus, queries.select("query_id", "video_id"), cfg
    if scope == "dataset":
        clips = queries.select("video_id").distinct()
        if clips.limit(2).count() == 1:
            cfg = cfg.with_overrides({"max_hits_per_video": 0})
        return corpus.only(clips), None, cfg
    return corpus, None, cfg


def touching_truth(hits: DataFrame, truth: DataFrame, tolerance_s: float) -> DataFrame:
    """Truth spans some hit of the same query overlaps or starts near; all others cannot be credited.

    The labels of one query may be many, its hits are few: the hits are repeated over the salts.
    """
    h = hits.select("query_id", "video", F.col("start_s").alias("_hs"), F.col("end_s").alias("_he"))
    pairs = salted_join(truth.select("query_id", *SPAN), h, ["query_id", "video"], ["start_s", "end_s"])
    crossing = (F.col("_hs") < F.col("end_s")) & (F.col("_he") > F.col("start_s"))
    near = (F.col("_hs") >= F.col("start_s") - tolerance_s) & (F.col("_hs") <= F.col("end_s") + tolerance_s)
    return pairs.filter(crossing | near).select("query_id", *SPAN).distinct()


def _lists(hits: DataFrame, truth: DataFrame, by: Sequence[str], tolerance_s: float) -> DataFrame:
    """Ranked hits and creditable truth of every group that has labels."""
    listed = hits.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", *SPAN))), lambda s: F.struct(*[s[f].alias(f) for f in SPAN])).alias("hits")
    )
    near = touching_truth(hits, truth, tolerance_s).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("start_s", "end_s", "video"))).alias("_t")
    )
    near = near.select("query_id", F.transform("_t", lambda s: F.struct(*[s[f].alias(f) for f in SPAN])).alias("truth"))
    labelled = truth.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_relevant"))
    empty = F.filter(F.array(F.struct(F.lit("").alias("video"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"))), lambda _: F.lit(False))
    out = labelled.join(listed, "query_id", "left").join(near, "query_id", "left")
    return out.withColumn("hits", F.coalesce("hits", empty)).withColumn("truth", F.coalesce("truth", empty))


def score_queries(hits: DataFrame, truth: DataFrame, tolerance_s: float = V.TOLERANCE_S) -> DataFrame:
    """All metrics per labelled query.

    hits: (query_id, video, start_s, end_s, rank), ranks bounded by the result limit.
    truth: (query_id, video, start_s, end_s). A labelled query without hits scores 0.
    """
    d = _lists(hits, truth, ["query_id"], tolerance_s)
    d = d.withColumn("rels", S.relevance(F.col("hits"), F.col("truth"), tolerance_s))
    cols = S.ir_metrics(F.col("rels"), F.col("n_relevant")) | S.temporal_metrics(F.col("hits"), F.col("truth"), F.col("n_relevant"))
    return d.select("query_id", "n_relevant", S.first_rank(F.col("rels")).alias("first_rank"), "rels", *[c.alias(n) for n, c in cols.items()])


def lane_attribution(lane_hits: DataFrame, truth: DataFrame, tolerance_s: float = V.TOLERANCE_S, k: int = 10) -> DataFrame:
    """(query_id, lane, first_rank, hit@10) per lane and labelled query, with ceiling and unique lane.

    lane_hits: (query_id, lane, video, start_s, end_s, rank).
    """
    top = lane_hits.filter(F.col("rank") <= k)
    d = _lists(top, truth, ["query_id", "lane"], tolerance_s).filter(F.col("lane").isNotNull())
    first = S.first_rank(S.relevance(F.col("hits"), F.col("truth"), tolerance_s))
    per_lane = d.select("query_id", "lane", first.alias("first_rank"))
    per_lane = per_lane.withColumn("hit@10", F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0))
    return per_lane


def attribution_by_query(per_lane: DataFrame) -> DataFrame:
    """lanes map, ceiling (some lane had it) and the only lane that had it, per query."""
    found = F.array_sort(F.collect_list(F.when(F.col("first_rank").isNotNull(), F.col("lane"))))
    return per_lane.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", F.struct("first_rank", F.col("`hit@10`").alias("hit10")))))).alias("lanes"),
        (F.size(found) > 0).alias("ceiling"),
        F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("unique_lane"),
    )


def scoped(df: DataFrame, group: str | None) -> DataFrame:
    """Every row under the scope 'overall' and, with a group column, under its own group as well."""
    scopes = [F.lit("overall")] + ([F.concat(F.lit(f"{group}="), F.col(group).cast("string"))] if group else [])
    return df.withColumn("scope", F.explode(F.array(*scopes)))


def aggregate(results: DataFrame, group: str | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Means of all metrics (4 digits), query counts, latency percentiles and lanes per query, overall and per group."""
    rows = scoped(results, group)
    aggs = [F.round(F.avg(F.col(f"`{m}`")), 4).alias(m) for m in metrics] + [F.count(F.lit(1)).alias("n")]
    if "lanes_run" in results.columns:
        aggs.append(F.round(F.avg(F.size("lanes_run")), 2).alias("lanes_per_query"))
    if "ceiling" in results.columns:
        aggs.append(F.round(F.avg(F.col("ceiling").cast("double")), 4).alias("lane_ceiling"))
    out = rows.groupBy("scope").agg(*aggs)
    if "latency_ms" in results.columns:
        lat = nearest_rank(rows, ["scope"], "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}).drop("n")
        out = out.join(lat, "scope", "left")
    return out


def aggregate_lanes(per_lane: DataFrame, queries: DataFrame, group: str | None = None) -> DataFrame:
    """hit@10 of every lane over all queries of a scope and how often it alone had the answer."""
    unique = attribution_by_query(per_lane).select("query_id", "unique_lane")
    n = scoped(queries, group).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    cols = ["query_id"] + ([group] if group else [])
    rows = scoped(per_lane.join(queries.select(*cols), "query_id").join(unique, "query_id"), group)
    hit = F.sum(F.col("`hit@10`"))
    alone = F.sum(F.when(F.col("unique_lane") == F.col("lane"), 1).otherwise(0))
    out = rows.groupBy("scope", "lane").agg(hit.alias("_h"), alone.alias("unique")).join(n, "scope")
    return out.select("scope", "lane", F.round(F.col("_h") / F.col("n"), 4).alias("hit@10"), "unique")


def strongest_lane(lanes: DataFrame) -> DataFrame:
    """Lane with the best hit@10 per scope (first name on ties)."""
    ranked = lanes.groupBy("scope").agg(F.min(F.struct((-F.col("`hit@10`")).alias("neg"), F.col("lane"))).alias("b"))
    return ranked.select("scope", F.col("b.lane").alias("lane"), (-F.col("b.neg")).alias("hit@10"))


def pair(base: DataFrame, other: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Queries both experiments scored, with other - base per metric; one-sided queries drop out."""
    b = base.select("query_id", *[F.col(f"`{m}`").alias(f"_b_{m}") for m in metrics])
    joined = other.join(b, "query_id")
    return joined.withColumns({f"delta_{m}": F.col(f"`{m}`") - F.col(f"`_b_{m}`") for m in metrics}).drop(*[f"_b_{m}" for m in metrics])


def compare(results: DataFrame, base: str, metrics: Sequence[str] = ("mrr", "recall@5"), n: int = 1000, seed: int = 0) -> DataFrame:
    """Paired bootstrap of every other experiment against `base`: one row per experiment and metric."""
    b = results.filter(F.col("experiment") == base).drop("experiment")
    others = results.filter(F.col("experiment") != base)
    deltas = pair(b, others, metrics)
    long = deltas.select(
        "experiment",
        "query_id",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`delta_{m}`").alias("delta")) for m in metrics])).alias("d"),
    ).select("experiment", "query_id", "d.metric", "d.delta")
    return paired_bootstrap(long, ["experiment", "metric"], "query_id", n=n, seed=seed)


def ablation_table(results: DataFrame, base: str, metric: str = "mrr", columns: Sequence[str] = ("mrr", "recall@1", "recall@5", "recall@10")) -> DataFrame:
    """Means per experiment with the change of `metric` against the base and its interval."""
    means = results.groupBy("experiment").agg(*[F.round(F.avg(F.col(f"`{c}`")), 4).alias(c) for c in columns])
    ci = compare(results, base, [metric]).select("experiment", F.col("mean").alias("delta"), "lo", "hi", "significant")
    return means.join(ci, "experiment", "left")


def misses(results: DataFrame, depth: int = 5) -> DataFrame:
    """Queries without a hit in the top five, with the lanes that had the answer."""
    lanes = F.map_keys(F.map_filter("lanes", lambda _, v: v["first_rank"].isNotNull())) if "lanes" in results.columns else F.lit(None)
    return results.filter(F.col("first_rank").isNull() | (F.col("first_rank") > depth)).withColumn("lanes_with_answer", lanes)


def metric_changes(base: DataFrame, other: DataFrame, metric: str = "mrr") -> DataFrame:
    """Queries whose metric differs between two experiments."""
    b = base.select("query_id", F.col(f"`{metric}`").alias("before"))
    return other.select("query_id", F.col(f"`{metric}`").alias("after")).join(b, "query_id").filter(F.abs(F.col("after") - F.col("before")) > 1e-9)


# --- hard negatives --------------------------------------------------------------------------


def best_positive(truth: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment with the highest IoU against any truth span of its query (lowest start on ties)."""
    from ..operators.intervals import overlap_join

    t = truth.select("query_id", "video", F.col("start_s").alias("start_s"), F.col("end_s").alias("end_s"))
    s = segments.select(F.col("video_id").alias("video"), "segment_id", "start_s", "end_s")
    pairs = overlap_join(s, t, ["video"])
    v = S.iou(
        {"video": F.col("video"), "start_s": F.col("start_s"), "end_s": F.col("end_s")},
        {"video": F.col("video"), "start_s": F.col("r_start_s"), "end_s": F.col("r_end_s")},
    )
    order = F.struct((-F.round(v, 9)).alias("neg_iou"), "start_s", "segment_id")
    best = pairs.filter(v > 0).groupBy("query_id").agg(F.min_by(F.struct("segment_id", "video", "start_s", "end_s", v.alias("iou")), order).alias("b"))
    return best.select("query_id", F.col("b.segment_id").alias("positive_id"), F.col("b.start_s").alias("positive_start"), F.col("b.end_s").alias("positive_end"), F.col("b.iou").alias("positive_iou"))


def mine_negatives(hits: DataFrame, truth: DataFrame, segments: DataFrame, max_iou: float = 0.1, per_query: int = 5) -> DataFrame:
    """First `per_query` hits per query that are neither the positive nor overlap any truth span by more than max_iou.

    hits: (query_id, segment_id, video, start_s, end_s, rank). Queries without a positive are skipped.
    """
    from ..operators.topk import topk

    pos = best_positive(truth, segments)
    t = truth.select("query_id", "video", F.col("start_s").alias("_ts"), F.col("end_s").alias("_te"))
    # labels may be many, hits are few: repeat the hits
    near = salted_join(t, hits.select("query_id", "segment_id", "rank", *SPAN), ["query_id", "video"], ["_ts", "_te"]).filter(
        (F.col("_ts") < F.col("end_s")) & (F.col("_te") > F.col("start_s"))
    )
    v = S.iou(
        {"video": F.col("video"), "start_s": F.col("start_s"), "end_s": F.col("end_s")},
        {"video": F.col("video"), "start_s": F.col("_ts"), "end_s": F.col("_te")},
    )
    worst = near.groupBy("query_id", "rank").agg(F.max(v).alias("_iou"))
    wrong = (
        hits.join(pos, "query_id")
        .filter(F.col("segment_id") != F.col("positive_id"))
        .join(worst, ["query_id", "rank"], "left")
        .filter(F.coalesce("_iou", F.lit(0.0)) <= max_iou)
        .drop("_iou")
    )
    return topk(wrong, ["query_id"], [F.col("rank").asc()], per_query, rank="nth")


def training_pairs(negatives: DataFrame, queries: DataFrame, passages: DataFrame, max_neg: int = 4, seed: int = 0) -> DataFrame:
    """(split, query, passage, label): a seeded tenth of the queries is dev; empty passages are dropped.

    passages: (segment_id, passage).
    """
    asked = negatives.select("query_id").distinct()
    hashed = asked.withColumn("_h", seeded_key(seed, F.col("query_id"))).withColumn("_g", F.lit(0))
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    placed = positions(hashed, ["_g"], ["_h", "query_id"], bucket, "_pos")
    total = asked.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("_dev")).withColumn("_g", F.lit(0))
    split = placed.join(F.broadcast(total), "_g").select("query_id", F.when(F.col("_pos") < F.col("_dev"), "dev").otherwise("train").alias("split"))
    pos = negatives.select("query_id", F.col("positive_id").alias("segment_id")).distinct().withColumn("label", F.lit(1.0))
    neg = negatives.filter(F.col("nth") <= max_neg).select("query_id", "segment_id").withColumn("label", F.lit(0.0))
    text = passages.select("segment_id", "passage")
    heard = pos.join(text, "segment_id").filter(F.length(F.trim("passage")) > 0)
    rows = heard.unionByName(neg.join(text, "segment_id").filter(F.length(F.trim("passage")) > 0).join(heard.select("query_id"), "query_id", "left_semi"))
    return rows.join(split, "query_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")


# --- experiment run --------------------------------------------------------------------------


def run_experiment(
    spec: ExperimentSpec,
    queries: DataFrame,
    truth: DataFrame,
    corpus,
    *,
    base: SearchConfig | None = None,
    sink: str | None = None,
    **search_options,
) -> dict[str, DataFrame]:
    """One batch search over all queries of a split, scored, attributed and aggregated.

    queries: loaded queries (query_id, text, modality, video_id, video_key). With `sink` the run, its
    results, hits and records are written under the experiment's name; a failed run is recorded as failed.
    """
    from ..sources.sinks import replace_partitions
    from .recorded import LEDGER, records
    from .search import search

    spark = queries.sparkSession
    cfg = (base or SearchConfig()).with_overrides(spec.search)

    def record(status: str, n_queries: int | None = None, overall: str | None = None) -> None:
        if sink:
            row = [(spec.name, status, spec.to_json(), cfg.to_json(), n_queries, overall, None)]
            replace_partitions(spark.createDataFrame(row, LEDGER).withColumn("at", F.current_timestamp()), f"{sink}/experiments", ["experiment"])

    record("running")
    try:
        library, pairs, cfg = restrict(queries, corpus, cfg, spec.scope)
        hits, lanes = search(queries, library, cfg, limit=spec.limit, scope=pairs, debug=True, present=False, **search_options)
        # both are bounded lists per query and are read several times below
        hits, lanes = cut_lineage(hits), cut_lineage(lanes)
        hits = hits.withColumn("video", F.col("video_id"))
        scored = score_queries(hits, truth, spec.tolerance_s)
        per_lane = lane_attribution(lanes.withColumn("video", F.col("video_id")), truth, spec.tolerance_s)
        extra = [c for c in (spec.group_by,) if c in queries.columns]
        results = scored.join(attribution_by_query(per_lane), "query_id", "left").join(queries.select("query_id", *extra), "query_id")
        results = results.withColumn("experiment", F.lit(spec.name))
        hits = hits.withColumn("experiment", F.lit(spec.name))
        if sink:
            replace_partitions(results, f"{sink}/results", ["experiment"])
            replace_partitions(hits, f"{sink}/hits", ["experiment"])
            replace_partitions(records(results, hits), f"{sink}/records", ["experiment"])
            results = spark.read.parquet(f"{sink}/results").filter(F.col("experiment") == spec.name)
            hits = spark.read.parquet(f"{sink}/hits").filter(F.col("experiment") == spec.name)
        group = extra[0] if extra else None
        out = {
            "results": results,
            "hits": hits,
            "overall": aggregate(results, group),
            "lanes": aggregate_lanes(per_lane, results.select("query_id", *extra), group),
        }
    except Exception:
        record("failed")
        raise
    whole = out["overall"].where("scope = 'overall'").drop("scope")
    told = whole.select("n", F.to_json(F.struct(*[F.col(f"`{c}`") for c in whole.columns])).alias("json")).first() if sink else None  # one row
    record("done", told["n"] if told else 0, told["json"] if told else None)
    return out


def list_experiments(experiments: DataFrame, n: int = 20) -> DataFrame:
    return experiments.orderBy(F.col("at").desc()).limit(n)
