"""Batch search: a table of queries against a corpus of segments, frames and windows, in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.spans import suppress
from ..functions.text import highlight, passage, short_key, term_tokens
from ..operators import fusion as fu
from ..operators.encoders import Encoder, embed, rerank
from ..operators.fuzzy import fuzzy_hits, fuzzy_topk
from ..operators.lexical import lexical_hits, lexical_lane, query_items
from ..operators.sizing import BROADCAST_ROWS, at_most
from ..operators.topk import best_first, pooled_topk, topk
from ..operators.vector_search import nearest
from ..session import cut_lineage
from .query_planning import decompose
from .routing import Router, get_router, pin_weights

VECTOR_LANES = {"text": "speech_q", "caption": "visual_q", "visual": "visual_q", "temporal": "visual_q"}


@dataclass
class Corpus:
    """segments(segment_id, video_id, start_s, end_s, text, ocr_text, caption_text, text_embedding,
    caption_embedding), frames(frame_id, segment_id, video_id, visual_embedding),
    windows(window_id, segment_id, video_id, kind, model_key, start_s, end_s, embedding).

    The text and caption vectors may live in a table of their own, vectors(segment_id, video_id,
    text_embedding, caption_embedding), so that no step joins them to the texts."""

    segments: DataFrame
    frames: DataFrame | None = None
    windows: DataFrame | None = None
    vectors: DataFrame | None = None

    def only(self, video_ids: DataFrame) -> Corpus:
        """The same corpus restricted to some videos."""
        cut = lambda t: None if t is None else t.join(video_ids, "video_id", "left_semi")
        return Corpus(cut(self.segments), cut(self.frames), cut(self.windows), cut(self.vectors))


def scope_filter(df: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Rows of the scoped (query_id, video_id) pairs; no scope means everything."""
    return df if scope is None else df.join(scope.select("query_id", "video_id").distinct(), ["query_id", "video_id"], "left_semi")


def lane_on(plans: DataFrame, lane: str) -> DataFrame:
    """Queries that give the lane a positive weight; others cost the lane nothing."""
    return plans.filter(F.coalesce(F.try_element_at("weights", F.lit(lane)), F.lit(0.0)) > 0)


def ocr_lane(plans: DataFrame, segments: DataFrame, k: int, threshold: float, scope: DataFrame | None = None) -> DataFrame:
    """Full-text matches of the speech terms (of ocr_q when there are none) joined with fuzzy matches of
    ocr_q in the on-screen text; the greater score counts."""
    asked = plans.filter(F.length(F.trim("ocr_q")) > 0)
    fallback = (F.size("terms") == 0) & (F.size("phrases") == 0)
    asked = asked.withColumn("terms", F.when(fallback, F.array_distinct(term_tokens(F.col("ocr_q")))).otherwise(F.col("terms")))
    shown = segments.filter(F.length("ocr_text") > 0)
    items = query_items(asked, lambda t: t)
    found = fuzzy_topk(asked, items, shown, "ocr_text", threshold, k, scope)
    if found is not None:
        return found
    exact = lexical_hits(items, shown, "ocr_text", lambda t: t)
    # an exact match counts with the greater of both scores, so its similarity is wanted at any level
    tokens = F.array_union("terms", F.flatten(F.transform("phrases", term_tokens)))
    fuzzy = fuzzy_hits(asked.withColumn("tokens", tokens), shown, "ocr_text", threshold)
    both = (
        exact.withColumn("exact", F.lit(True))
        .unionByName(fuzzy.withColumn("exact", F.lit(False)))
        .groupBy("query_id", "segment_id")
        .agg(F.max("score").alias("score"), F.max("exact").alias("exact"), F.max(F.when(~F.col("exact"), F.col("score"))).alias("similar"))
        .filter(F.col("exact") | (F.col("similar") > threshold))
        .select("query_id", "segment_id", "score")
    )
    return topk(_in_scope(both, segments, scope), ["query_id"], best_first(), k)


def _in_scope(hits: DataFrame, segments: DataFrame, scope: DataFrame | None) -> DataFrame:
    if scope is None:
        return hits
    placed = hits.join(segments.select("segment_id", "video_id"), "segment_id")
    return scope_filter(placed, scope).drop("video_id")


def candidate_lanes(
    plans: DataFrame, corpus: Corpus, cfg: SearchConfig, vectors: dict[str, str], scope: DataFrame | None = None
) -> list[DataFrame]:
    """Candidate rows of every lane that is switched on; `vectors` names the query vector per lane."""
    k, seg = cfg.candidates, corpus.segments
    vec = seg if corpus.vectors is None else corpus.vectors
    segs = seg if "ocr_text" in seg.columns else seg.withColumn("ocr_text", F.lit(""))

    def near(lane: str, table: DataFrame, column: str, key: str, payload: tuple[str, ...], n: int) -> DataFrame:
        asked = lane_on(plans, lane).select("query_id", F.col(vectors[lane]).alias("query_vector"))
        return nearest(asked, table, n, vector=column, row_key=key, payload=payload, scope=scope)

    def may_run(lane: str) -> bool:
        # a lane with base weight 0 stays 0 under every router
        return cfg.lanes.get(lane, 0.0) > 0

    lanes = []
    if may_run("text") and "text" in vectors:
        lanes.append(fu.as_lane(near("text", vec, "text_embedding", "segment_id", (), k), "text"))
    if may_run("lexical"):
        lanes.append(fu.as_lane(lexical_lane(lane_on(plans, "lexical"), seg, k, scope=scope), "lexical"))
    if may_run("visual") and "visual" in vectors and corpus.frames is not None:
        hits = near("visual", corpus.frames, "visual_embedding", "frame_id", ("segment_id",), 3 * k)
        lanes.append(fu.as_lane(pooled_topk(hits.drop("rank"), k, tie="frame_id"), "visual"))
    if may_run("ocr"):
        lanes.append(fu.as_lane(ocr_lane(lane_on(plans, "ocr"), segs, k, cfg.ocr_trgm_threshold, scope), "ocr"))
    if may_run("caption") and "caption" in vectors:
        lanes.append(fu.as_lane(near("caption", vec, "caption_embedding", "segment_id", (), k), "caption"))
    if may_run("temporal") and "temporal" in vectors and corpus.windows is not None:
        rows = version_filter(corpus.windows, "temporal", cfg.models.get("temporal", ""))
        hits = near("temporal", rows.filter("segment_id IS NOT NULL"), "embedding", "window_id", ("segment_id", "start_s", "end_s"), 3 * k)
        lanes.append(fu.as_lane(pooled_topk(hits.drop("rank"), k, with_span=True, tie="window_id"), "temporal"))
    return lanes


def version_filter(windows: DataFrame, kind: str, model: str) -> DataFrame:
    """Rows of one model version; the table is partitioned by (kind, model_key), so others are not read."""
    return windows.filter((F.col("kind") == kind) & (F.col("model_key") == short_key(F.lit(model))))


def head(fused: DataFrame, n: int) -> DataFrame:
    return topk(fused, ["query_id"], [F.col("fused").desc(), F.col("segment_id").asc()], n, rank="fused_rank")


def hydrate(head_rows: DataFrame, segments: DataFrame, is_small: bool) -> DataFrame:
    """Late materialisation: wide segment columns are read for the fused head only.

    `is_small` says that the head, at most n rows per query, is known to fit a broadcast.
    """
    cols = [c for c in ("segment_id", "video_id", "start_s", "end_s", "text", "ocr_text", "caption_text") if c in segments.columns]
    wide = segments.select(*cols)
    for c in ("ocr_text", "caption_text"):
        if c not in cols:
            wide = wide.withColumn(c, F.lit(""))
    return wide.join(F.broadcast(head_rows) if is_small else head_rows, "segment_id")


def final_scores(rows: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Mix of rerank, fused and visual evidence; rows outside the rerank head are scaled by 0.9.

    rows: head rows with fused, fused_rank, signals, weights and, when reranking, `rerank`.
    """
    per_query = Window.partitionBy("query_id")
    weight = lambda lane: F.coalesce(F.try_element_at("weights", F.lit(lane)), F.lit(0.0))
    coef = cfg.final_mix["visual"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight("visual"), weight("temporal")))
    norms = []
    for lane in ("visual", "temporal"):
        s = F.when(weight(lane) > 0, F.try_element_at("signals", F.lit(lane)))
        lo, hi = F.min(s).over(per_query), F.max(s).over(per_query)
        norms.append(F.coalesce(F.when(hi > lo, (s - lo) / (hi - lo)).when(s.isNotNull(), 1.0), F.lit(0.0)))
    top = F.max("fused").over(per_query)
    base = cfg.final_mix["fused"] * (F.col("fused") / F.when(top == 0, 1.0).otherwise(top)) + coef * F.greatest(F.lit(0.0), *norms)
    if not cfg.rerank:
        return rows.withColumn("score", base)
    score = F.when(F.col("rerank").isNotNull(), cfg.final_mix["rerank"] * F.col("rerank") + base).otherwise(base * 0.9)
    return rows.withColumn("score", score)


def apply_span_mode(rows: DataFrame, mode: str) -> DataFrame:
    """In window mode the temporal lane's best window replaces the segment bounds."""
    if mode != "window":
        return rows
    span = F.try_element_at("spans", F.lit("temporal"))
    return rows.withColumn("start_s", F.coalesce(span["span_start"], "start_s")).withColumn(
        "end_s", F.coalesce(span["span_end"], "end_s")
    )


def suppress_hits(hits: DataFrame, window_s: float, cap: int | None, limit: int, carry: tuple[str, ...] = (), uncapped: DataFrame | None = None) -> DataFrame:
    """Temporal suppression per (query, video), then the best `limit` hits per query.

    The lists are heads of bounded length. Queries in `uncapped` have no per-video cap.
    """
    fields = ["start_s", "end_s", "segment_id", *carry]
    item = F.struct((-F.col("score")).alias("neg"), *fields)
    by = ["query_id", "video_id"]
    limit_col = F.lit(cap).cast("int")
    d = hits
    if uncapped is not None:
        d = d.join(uncapped.select("query_id", F.lit(True).alias("_one")), "query_id", "left")
        limit_col = F.when(F.first("_one").isNull(), limit_col)
    else:
        limit_col = F.first(limit_col)
    order = F.array_sort(
        F.collect_list(item),
        lambda a, b: F.when(a["neg"] < b["neg"], -1)
        .when(a["neg"] > b["neg"], 1)
        .when(a["segment_id"] < b["segment_id"], -1)
        .when(a["segment_id"] > b["segment_id"], 1)
        .otherwise(0),
    )
    grouped = d.groupBy(*by).agg(order.alias("_h"), limit_col.alias("_cap"))
    kept = grouped.select(*by, F.explode(suppress(F.col("_h"), window_s, F.col("_cap"))).alias("h"))
    flat = kept.select(*by, *[F.col(f"h.{f}").alias(f) for f in fields], (-F.col("h.neg")).alias("score"))
    return topk(flat, ["query_id"], best_first(), limit)


def plan_queries(queries: DataFrame, cfg: SearchConfig, router: Router | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """decompose, route with the configured router, then apply pinned weights."""
    chosen = router or get_router(cfg.router, cfg.ocr_no_cue_factor, folder=cfg.router_folder)
    return pin_weights(chosen.route(decompose(queries), cfg.lanes), weights)


def search(
    queries: DataFrame,
    corpus: Corpus,
    config: SearchConfig | None = None,
    *,
    limit: int = 20,
    scope: DataFrame | None = None,
    vectors: dict[str, str] | None = None,
    encoders: dict[str, Encoder] | None = None,
    router: Router | None = None,
    weights: dict[str, float] | None = None,
    scorer: Callable | None = None,
    present: bool = True,
    debug: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Ranked moments for every query.

    queries: (query_id, text, ...). Query vectors come from columns named in `vectors` or from
    `encoders`, per lane. `present` adds the texts and a marked snippet to the final hits. With `debug` the
    ranked lane rows before fusion are returned as well.
    """
    cfg = config or SearchConfig()
    plans = plan_queries(queries, cfg, router, weights)
    names = dict(vectors or {})
    for lane, encoder in (encoders or {}).items():
        if cfg.lanes.get(lane, 0.0) > 0:
            names[lane] = f"_vec_{lane}"
            plans = embed(plans, VECTOR_LANES[lane], encoder, names[lane])
    # every lane reads and filters the plans: decompose and encode once, and keep the optimizer from
    # substituting the nested pattern expressions into each lane's filters
    plans = cut_lineage(plans)
    lanes = candidate_lanes(plans, corpus, cfg, names, scope)
    merged = fu.union_lanes(lanes)
    asked = plans.select("query_id", "weights", "terms", "speech_q")
    n_head = max(cfg.rerank_top_k, 4 * limit)
    small = at_most(queries, BROADCAST_ROWS // n_head)
    asked = F.broadcast(asked) if small else asked
    fused = fu.fuse(merged, asked, cfg.fusion, cfg.rrf_k)
    top = head(fused, n_head)
    rows = hydrate(top, corpus.segments, small).join(asked, "query_id")
    if cfg.rerank:
        caption = F.col("caption_text") if cfg.caption_in_rerank_passage else None
        text = passage(F.col("text"), F.col("ocr_text"), caption)
        # rows outside the rerank head have no passage and get no score
        rows = rows.withColumn("passage", F.when(F.col("fused_rank") <= cfg.rerank_top_k, text))
        rows = rerank(rows, scorer)
    rows = apply_span_mode(final_scores(rows, cfg), cfg.span_mode)
    shown = {"fused": F.round("fused", 4)} | ({"rerank": F.round("rerank", 4)} if cfg.rerank else {})
    extra = F.create_map(*[c for name, col in shown.items() for c in (F.lit(name), col)])
    rows = rows.withColumn(
        "signals",
        F.map_filter(
            F.map_concat(F.transform_values("signals", lambda _, v: F.round(v, 4)), extra), lambda _, v: v.isNotNull()
        ),
    )
    single = None
    if scope is not None:
        single = scope.groupBy("query_id").agg(F.countDistinct("video_id").alias("n")).filter("n = 1")
    # suppression moves ids and scores only; texts are fetched for the hits that remain
    hits = suppress_hits(rows, cfg.dedup_window_s, cfg.max_hits_per_video or None, limit, ("signals", "total_candidates"), single)
    hits = hits.withColumn("score", F.round("score", 4))
    if present:
        texts = [c for c in ("text", "ocr_text", "caption_text") if c in corpus.segments.columns]
        shown = corpus.segments.select("segment_id", *texts)
        hits = shown.join(F.broadcast(hits) if small else hits, "segment_id").join(asked.select("query_id", "terms"), "query_id")
        hits = hits.withColumn("snippet", highlight(F.col("text"), F.col("terms"))).drop("terms")
    if not debug:
        return hits
    spans = corpus.segments.select("segment_id", "video_id", "start_s", "end_s")
    lane_rows = fu.lane_rank(merged).join(spans, "segment_id")
    return hits, lane_rows
