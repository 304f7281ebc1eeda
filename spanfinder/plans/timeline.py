"""Topic timelines: cut every video where slide headings or the flow of its segments change.

All steps over the rows of a video run in blocks, so that one very long video does not end up in one
task; only its candidate cuts, a bounded number, are decided in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.numeric import dot, l2_norm
from ..functions.text import box_height, title_case
from ..operators.encoders import Encoder, HashingEncoder
from ..operators.intervals import point_in_interval
from ..operators.ordered import BLOCK_ROWS, halo_blocks, neighbours, positions, running
from ..operators.pooling import mean_pool
from ..session import cut_lineage
from .keyphrases import ngram_candidates, ngram_counts, phrase_tokens, rank_phrases

BLOCK_S = 36_000.0


def time_block(col: str = "start_s", width: float = BLOCK_S) -> Column:
    return F.floor(F.col(col) / width)


def _pos_block(rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col("pos") / rows)


def ffill(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], block: Column, out: str) -> DataFrame:
    """Last non-null value up to the row."""
    return running(df, by, order, block, col, "last", out)


def heading_cuts(rows: DataFrame, by: Sequence[str] = ("video_id",), heading: str = "heading") -> DataFrame:
    """Positions where the (filled) heading changes and the new one stays for one more row or to the end."""
    filled = ffill(rows, heading, by, ["pos"], _pos_block(), "_h")
    near = neighbours(filled, by, "pos", {"_prev": ("_h", -1), "_next": ("_h", 1), "_has_next": ("pos", 1)})
    changed = F.col("_prev").isNotNull() & F.col("_h").isNotNull() & (F.lower("_prev") != F.lower("_h"))
    stays = F.col("_has_next").isNull() | (F.lower(F.coalesce("_next", F.lit(""))) == F.lower("_h"))
    return near.filter(changed & stays).select(*by, F.col("pos").alias("cut"))


def _mean(vectors: Column) -> Column:
    total = F.aggregate(
        F.slice(vectors, 2, 1 << 30), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")),
    )
    return F.transform(total, lambda x: x / F.size(vectors))


def block_similarity(rows: DataFrame, by: Sequence[str] = ("video_id",), vector: str = "embedding", width: int = V.SIMILARITY_ROWS) -> DataFrame:
    """Cosine of the mean of up to `width` rows ending here and the mean of the next ones; null on the last row.

    A mean without length counts as similar.
    """
    d = halo_blocks(rows, "pos", width - 1, width)
    w = Window.partitionBy(*by, "_blk").orderBy("pos")
    left = F.collect_list(vector).over(w.rowsBetween(-(width - 1), 0))
    right = F.collect_list(vector).over(w.rowsBetween(1, width))
    d = d.withColumn("_l", left).withColumn("_r", right).filter("_core").drop("_blk", "_core")
    d = d.withColumn("_lm", _mean(F.col("_l"))).withColumn("_rm", F.when(F.size("_r") > 0, _mean(F.col("_r"))))
    n = l2_norm(F.col("_lm")) * l2_norm(F.col("_rm"))
    sim = F.when(n > 0, dot(F.col("_lm"), F.col("_rm")) / n).otherwise(1.0)
    return d.withColumn("gap", F.when(F.size("_r") > 0, sim)).drop("_l", "_r", "_lm", "_rm")


def depth_scores(gaps: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Drop of every gap below the highest gap before it and the highest gap after it."""
    real = gaps.filter(F.col("gap").isNotNull())
    up = running(real, by, ["pos"], _pos_block(), "gap", "max", "_lp")
    both = running(up, by, ["pos"], _pos_block(), "gap", "max", "_rp", reverse=True)
    return both.withColumn("depth", (F.col("_lp") - F.col("gap")) + (F.col("_rp") - F.col("gap"))).drop("_lp", "_rp")


def depth_threshold(depths: DataFrame, by: Sequence[str] = ("video_id",), factor: float = 0.5) -> DataFrame:
    return depths.groupBy(*by).agg((F.avg("depth") + factor * F.stddev_pop("depth")).alias("threshold"))


def _accept(cuts: Column, candidates: Column, min_s: Column, most: int | None) -> Column:
    """Fold ordered candidates into the accepted cuts; both sides of a new cut must be long enough."""

    def step(acc: Column, c: Column) -> Column:
        prev = F.array_max(F.filter(acc, lambda k: k["b"] <= c["b"]))
        nxt = F.array_min(F.filter(acc, lambda k: k["b"] > c["b"]))
        long_enough = (c["end_prev"] - prev["start"] >= min_s) & (nxt["end_prev"] - c["start"] >= min_s)
        room = F.lit(True) if most is None else F.size(acc) - 2 < most
        fresh = ~F.exists(acc, lambda k: k["b"] == c["b"])
        return F.when(room & fresh & long_enough, F.array_append(acc, c)).otherwise(acc)

    return F.aggregate(candidates, cuts, step)


def _cut(b: Column, start: Column, end_prev: Column) -> Column:
    return F.struct(b.cast("bigint").alias("b"), start.cast("double").alias("start"), end_prev.cast("double").alias("end_prev"))


def segment_topics(rows: DataFrame, min_topic_s: float | None = None) -> DataFrame:
    """(video_id, cuts) with the ascending start positions of all topics.

    rows: (video_id, pos, start_s, end_s, embedding, heading). Forced heading cuts come first with a
    relaxed minimum length, then depth-ordered drift cuts, at most 24 topics.
    """
    by = ["video_id"]
    n_last = F.max_by("end_s", "pos")
    shape = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("start_s", "pos").alias("first_start"), n_last.alias("last_end")
    )
    length = F.col("last_end") - F.col("first_start")
    m = F.lit(min_topic_s) if min_topic_s else F.least(F.lit(V.MIN_TOPIC_S), F.greatest(F.lit(V.FORCED_MIN_S), length / 6))
    shape = shape.withColumn("m", m)
    with_prev = neighbours(rows, by, "pos", {"_end_prev": ("end_s", -1)})
    cut_rows = with_prev.select(*by, F.col("pos").alias("cut"), _cut(F.col("pos"), F.col("start_s"), F.col("_end_prev")).alias("c"))
    forced = heading_cuts(rows).join(cut_rows, [*by, "cut"]).groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("forced"))

    depths = depth_scores(block_similarity(rows)).select(*by, "pos", "depth")
    cands = (
        depths.join(depth_threshold(depths), by)
        .filter(F.col("depth") >= F.col("threshold"))
        .select(*by, (F.col("pos") + 1).alias("cut"), "depth")
    )
    # a cut rules out only candidates closer than m, so this many of the deepest always suffice
    per_bin = rows.join(shape.select(*by, "m"), by).groupBy(*by, F.floor(F.col("end_s") / F.col("m")).alias("_bin")).agg(F.count(F.lit(1)).alias("_k"))
    bound = per_bin.groupBy(*by).agg((((V.MAX_TOPICS + 1) * (4 * F.max("_k") + 1)) + V.MAX_TOPICS).alias("enough"))
    deepest = [F.col("depth").desc(), F.col("cut").asc()]
    local = Window.partitionBy(*by, "_blk").orderBy(*deepest)
    whole = Window.partitionBy(*by).orderBy(*deepest)
    kept = (
        cands.join(bound, by)
        .withColumn("_blk", F.floor(F.col("cut") / BLOCK_ROWS))
        .withColumn("_i", F.row_number().over(local))
        .filter(F.col("_i") <= F.col("enough"))
        .withColumn("_i", F.row_number().over(whole))
        .filter(F.col("_i") <= F.col("enough"))
    )
    drift = kept.join(cut_rows, [*by, "cut"]).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("neg"), "cut", "c"))), lambda s: s["c"]).alias("drift")
    )
    none = F.filter(F.array(_cut(F.lit(0), F.lit(0.0), F.lit(0.0))), lambda _: F.lit(False))
    d = shape.join(forced, by, "left").join(drift, by, "left")
    edges = F.array(
        _cut(F.lit(0), F.col("first_start"), F.lit(None)), _cut(F.col("n"), F.lit(None), F.col("last_end"))
    )
    d = d.withColumn("_c", _accept(edges, F.coalesce("forced", none), F.least("m", F.lit(V.FORCED_MIN_S)), None))
    d = d.withColumn("_c", _accept(F.col("_c"), F.coalesce("drift", none), F.col("m"), V.MAX_TOPICS - 1))
    starts = F.array_sort(F.filter(F.transform("_c", lambda c: c["b"]), lambda b: b < F.col("n")))
    return d.select(*by, F.when(F.col("n") <= 2, F.array(F.lit(0).cast("bigint"))).otherwise(starts).alias("cuts"))


def topic_of_rows(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with the index of their topic."""
    at = F.size(F.filter("cuts", lambda b: b <= F.col("pos"))) - 1
    return rows.join(cuts, "video_id").withColumn("topic", at).drop("cuts")


def heading_votes(frames: DataFrame) -> DataFrame:
    """The tallest on-screen line of every frame, when it looks like a title: (video_id, t_s, title, height)."""
    lines = F.transform("ocr_boxes", lambda b: F.struct(box_height(b["b"]).alias("h"), b["t"].alias("t")))
    # the first of equally tall lines wins
    tallest = F.array_max(F.transform(lines, lambda s, i: F.struct(s["h"].alias("h"), (-i).alias("i"), F.trim(s["t"]).alias("t"))))
    d = frames.filter(F.size("ocr_boxes") > 0).withColumn("_b", tallest)
    n_words = F.size(F.filter(F.split("_b.t", r"\s+"), lambda w: F.length(w) > 0))
    good = n_words.between(1, 8) & (F.length("_b.t") >= 3) & (F.col("_b.h") > 0)
    return d.filter(good).select("video_id", "t_s", F.col("_b.t").alias("title"), F.col("_b.h").alias("height"))


def slide_heading(votes: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Title with the greatest summed height inside every span, 60 characters: (by..., heading)."""
    keyed = spans.select("video_id", *[c for c in by if c != "video_id"], "start_s", "end_s")
    met = point_in_interval(votes, keyed, ["video_id"], "t_s")
    sums = met.groupBy(*by, "title").agg(F.sum("height").alias("h"), F.min("t_s").alias("first"))
    best = sums.groupBy(*by).agg(F.min_by("title", F.struct((-F.col("h")).alias("neg"), "first", "title")).alias("title"))
    return best.select(*by, F.substring("title", 1, 60).alias("heading"))


def make_contiguous(topics: DataFrame) -> DataFrame:
    """First topic starts at 0, each other one where the previous ends. Topics per video are few."""
    w = Window.partitionBy("video_id").orderBy("index")
    return topics.withColumn("start_s", F.coalesce(F.lag("end_s").over(w), F.lit(0.0)))


def indexed_rows(segments: DataFrame, width: float = BLOCK_S) -> DataFrame:
    """Segments with a text vector, numbered per video in time order."""
    usable = segments.filter(F.col("embedding").isNotNull())
    return positions(usable, ["video_id"], ["start_s", "segment_id"], time_block("start_s", width))


def build_timeline(segments: DataFrame, frames: DataFrame | None = None, encoder: Encoder | None = None, top_k: int = 6) -> DataFrame:
    """Topics of every video: span, label, keyphrases, centroid, source.

    segments: (segment_id, video_id, start_s, end_s, text, ocr_text, embedding);
    frames: (video_id, t_s, ocr_boxes).
    """
    enc = encoder or HashingEncoder()
    rows = indexed_rows(segments)
    votes = None if frames is None else heading_votes(frames)
    if votes is None:
        rows = rows.withColumn("heading", F.lit(None).cast("string"))
    else:
        rows = rows.join(slide_heading(votes, rows, ["video_id", "segment_id"]), ["video_id", "segment_id"], "left")
    # the numbered rows feed every later step: write them once, without the texts
    rows = cut_lineage(rows.select("video_id", "segment_id", "pos", "start_s", "end_s", "embedding", "heading"))
    cuts = cut_lineage(segment_topics(rows))
    placed = topic_of_rows(rows, cuts)
    key = ["video_id", "topic"]
    spans = placed.groupBy(*key).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    centroids = mean_pool(placed, key)
    texts = segments.select("video_id", "segment_id", "text", "ocr_text")
    said = cut_lineage(placed.select(*key, "segment_id", "pos").join(texts, ["video_id", "segment_id"]))
    phrases = cut_lineage(topic_phrases(said, key, enc, top_k))
    out = spans.join(centroids, key).join(phrases, key, "left")
    if votes is None:
        out = out.withColumn("heading", F.lit(None).cast("string"))
    else:
        out = out.join(slide_heading(votes, spans, key), key, "left")
    kp = F.coalesce("keyphrases", F.array().cast("array<string>"))
    return make_contiguous(
        out.select(
            "video_id",
            F.col("topic").alias("index"),
            "start_s",
            "end_s",
            F.coalesce("heading", title_case(F.get(kp, F.lit(0)))).alias("label"),
            kp.alias("keyphrases"),
            F.col("centroid").alias("embedding"),
            F.when(F.col("heading").isNotNull(), "heading").otherwise("extractive").alias("source"),
        )
    )


def topic_phrases(placed: DataFrame, key: list[str], enc: Encoder, top_k: int) -> DataFrame:
    """Keyphrases of the joined texts of a topic, counted piece by piece.

    Every piece carries the first two tokens of what follows it in the topic, so that phrases across
    segment borders are counted as in the joined text.
    """
    screen = F.array_distinct(F.split(F.coalesce("ocr_text", F.lit("")), "\n"))
    spoken = placed.select(*key, "pos", phrase_tokens(F.coalesce("text", F.lit(""))).alias("t")).filter(F.size("t") > 0)
    spoken = spoken.withColumn("head", F.slice("t", 1, 2)).withColumn("own", F.size("t"))
    spoken = positions(spoken, ["video_id"], ["pos"], _pos_block(), "turn")
    near = neighbours(spoken, ["video_id"], "turn", {"h1": ("head", 1), "h2": ("head", 2), "k1": ("topic", 1), "k2": ("topic", 2)})
    none = F.array().cast("array<string>")
    h1 = F.when(F.col("k1") == F.col("topic"), F.col("h1"))
    h2 = F.when((F.col("k2") == F.col("topic")) & (F.size("h1") < 2), F.col("h2"))
    follow = F.slice(F.concat(F.coalesce(h1, none), F.coalesce(h2, none)), 1, 2)
    pieces = near.select(*key, F.concat("t", follow).alias("t"), "own")
    lines = placed.select(*key, F.explode(screen).alias("line")).distinct().select(*key, phrase_tokens(F.col("line")).alias("t"))
    pieces = pieces.unionByName(lines.withColumn("own", F.size("t")))
    cands = ngram_candidates(ngram_counts(pieces, key, F.col("t"), F.col("own")), key)
    docs = mean_pool(enc.add(placed.select(*key, "text"), "text", "_v"), key, "_v", "vector")
    return rank_phrases(cands, docs, key, enc, top_k)
