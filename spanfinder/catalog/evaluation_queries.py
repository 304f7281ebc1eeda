"""Metrics, attribution, aggregation, comparison, negatives and router on two recorded runs.

The runs are the ten best segments of the lexical and of the dense lane; labels are the segments that
hold the query text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExperimentSpec, SearchConfig
from ..functions import fixed_values as V
from ..plans import evaluation as ev
from ..plans import recorded as rec
from ..plans.learned_router import holdout_split, save_router, train_router, training_rows
from ..plans.query_planning import decompose
from ..plans.routing import get_router
from ..session import cut_lineage, shared_dir
from . import bindings as B
from ..plans.search import Corpus
from .registry import ORACLES, query
from .search_queries import DENSE, dense, lexical, lexical_sql, rounded, vectors


def run_hits(spark: SparkSession, sf: str, lane: str, k: int = 10) -> DataFrame:
    hits = (dense if lane == "text" else lexical)(spark, sf, k)
    spans = B.spans_only(spark, sf).withColumnRenamed("video_id", "video")
    # recorded: a run's hits are stored before they are scored
    return cut_lineage(hits.join(spans, "segment_id"))


def both_runs(spark: SparkSession, sf: str) -> DataFrame:
    lanes = [run_hits(spark, sf, lane).withColumn("lane", F.lit(lane)) for lane in ("text", "lexical")]
    return lanes[0].unionByName(lanes[1])


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-query metrics of both runs, the labels read once."""
    truth = cut_lineage(B.truth(spark, sf))
    scored = [
        ev.score_queries(run_hits(spark, sf, lane), truth).withColumn("experiment", F.lit(lane)) for lane in ("text", "lexical")
    ]
    return cut_lineage(scored[0].unionByName(scored[1]))


# --- shared SQL ------------------------------------------------------------------------------

_BASE = f"""{DENSE}, {lexical_sql()}, {B.SPANS}, {B.TRUTH},
lanes AS (SELECT query_id, 'text' AS lane, segment_id, rank, score FROM dense WHERE rank <= 10
  UNION ALL SELECT query_id, 'lexical', segment_id, rank, score FROM lexical WHERE rank <= 10),
hits AS (SELECT l.query_id, l.lane, CAST(l.rank AS INT) AS rank, l.segment_id, s.video_id AS video, s.start_s, s.end_s
  FROM lanes l JOIN spans s USING (segment_id)),
tl AS (SELECT query_id, list({{'v': video, 's': start_s, 'e': end_s}} ORDER BY start_s, end_s, video) AS t, count(*) AS n FROM truth GROUP BY query_id),
seeds AS (SELECT query_id, lane, n, t FROM tl, (SELECT unnest(['text', 'lexical']) AS lane))"""

_OVERLAP = "h.video = t[i].v AND ((h.start_s < t[i].e AND h.end_s > t[i].s) OR (h.start_s >= t[i].s - 3 AND h.start_s <= t[i].e + 3))"
_REL = f"""rel AS (
  SELECT query_id, lane, 0 AS rank, CAST([] AS BIGINT[]) AS used, 0 AS rel FROM seeds
  UNION ALL
  SELECT query_id, lane, rank + 1, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END, CASE WHEN m IS NULL THEN 0 ELSE 1 END
  FROM (SELECT r.query_id, r.lane, r.rank, r.used,
          list_filter(range(1, len(s.t) + 1), lambda i: NOT list_contains(r.used, i) AND {_OVERLAP.replace('t[i]', 's.t[i]')})[1] AS m
        FROM rel r JOIN hits h ON h.query_id = r.query_id AND h.lane = r.lane AND h.rank = r.rank + 1
        JOIN seeds s ON s.query_id = r.query_id AND s.lane = r.lane)),
rels AS (SELECT query_id, lane, rank, rel FROM rel WHERE rank > 0)"""
_IR = """ir AS (SELECT s.query_id, s.lane, s.n AS n_relevant, min(CASE WHEN rel = 1 THEN rank END) AS first_rank,
   coalesce(1.0e0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr,
   coalesce(sum(rel / log2(rank + 1)), 0) / list_sum(list_transform(range(1, CAST(least(s.n, 10) AS INT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10,
   least(1.0, coalesce(sum(CASE WHEN rank <= 1 THEN rel END), 0) / s.n::DOUBLE) AS recall1,
   least(1.0, coalesce(sum(CASE WHEN rank <= 5 THEN rel END), 0) / s.n::DOUBLE) AS recall5,
   least(1.0, coalesce(sum(CASE WHEN rank <= 10 THEN rel END), 0) / s.n::DOUBLE) AS recall10
  FROM seeds s LEFT JOIN rels r ON r.query_id = s.query_id AND r.lane = s.lane GROUP BY s.query_id, s.lane, s.n)"""
_INTER = "greatest(0, least(h.end_s, s.t[i].e) - greatest(h.start_s, s.t[i].s))"
_IOU = f"(CASE WHEN h.video = s.t[i].v THEN {_INTER} / ((h.end_s - h.start_s) + (s.t[i].e - s.t[i].s) - {_INTER}) ELSE 0 END)"
_AP = f"""thr AS (SELECT unnest({list(V.IOU_THRESHOLDS)})::DOUBLE AS thr),
ap AS (
  SELECT query_id, lane, thr, 0 AS rank, CAST([] AS BIGINT[]) AS used, 0::DOUBLE AS total FROM seeds, thr
  UNION ALL
  SELECT query_id, lane, thr, rank + 1, CASE WHEN b.v >= thr THEN list_append(used, -b.i) ELSE used END,
    total + CASE WHEN b.v >= thr THEN (len(used) + 1) / (rank + 1)::DOUBLE ELSE 0 END
  FROM (SELECT a.*, list_sort(list_transform(list_filter(range(1, len(s.t) + 1), lambda i: NOT list_contains(a.used, i)),
             lambda i: {{'v': {_IOU}, 'i': -i}}))[-1] AS b
        FROM ap a JOIN hits h ON h.query_id = a.query_id AND h.lane = a.lane AND h.rank = a.rank + 1
        JOIN seeds s ON s.query_id = a.query_id AND s.lane = a.lane)),
aps AS (SELECT query_id, lane, thr, arg_max(total, rank) AS total FROM ap GROUP BY ALL),
best AS (SELECT h.query_id, h.lane, h.rank, max(list_max(list_transform(range(1, len(s.t) + 1), lambda i: {_IOU}))) AS v
   FROM hits h JOIN seeds s ON s.query_id = h.query_id AND s.lane = h.lane GROUP BY ALL),
tm AS (SELECT s.query_id, s.lane,
   (SELECT coalesce(max(CASE WHEN rank <= 1 AND v >= 0.5 THEN 1.0e0 END), 0) FROM best b WHERE b.query_id = s.query_id AND b.lane = s.lane) AS r1,
   (SELECT coalesce(max(CASE WHEN rank <= 5 AND v >= 0.7 THEN 1.0e0 END), 0) FROM best b WHERE b.query_id = s.query_id AND b.lane = s.lane) AS r5,
   (SELECT max(CASE WHEN thr = 0.5 THEN total END) / s.n FROM aps a WHERE a.query_id = s.query_id AND a.lane = s.lane) AS map50,
   (SELECT avg(total) / s.n FROM aps a WHERE a.query_id = s.query_id AND a.lane = s.lane) AS map_all FROM seeds s)"""


def _plain_names(df: DataFrame) -> DataFrame:
    names = {"ndcg@10": "ndcg10", "recall@1": "recall1", "recall@5": "recall5", "recall@10": "recall10", "r1@0.5": "r1", "r5@0.7": "r5", "map@0.5": "map50", "map": "map_all", "experiment": "lane"}
    for a, b in names.items():
        if a in df.columns:
            df = df.withColumnRenamed(a, b)
    return df


@query(f"WITH {B.SPANS}, {B.TRUTH} SELECT query_id, segment_id, video, start_s, end_s FROM truth")
def truth_spans(spark: SparkSession, sf: str) -> DataFrame:
    return B.truth(spark, sf).select("query_id", "segment_id", "video", "start_s", "end_s")


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_IR} SELECT query_id, lane, n_relevant, CAST(first_rank AS BIGINT) AS first_rank,
  round(mrr, 6) AS mrr, round(ndcg10, 6) AS ndcg10, round(recall1, 6) AS recall1, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10 FROM ir""")
def metrics_ir(spark: SparkSession, sf: str) -> DataFrame:
    d = _plain_names(results(spark, sf))
    cols = ["mrr", "ndcg10", "recall1", "recall5", "recall10"]
    return rounded(d.select("query_id", "lane", F.col("n_relevant").cast("long"), F.col("first_rank").cast("long"), *cols), *cols)


@query(f"""WITH RECURSIVE {_BASE}, {_AP} SELECT query_id, lane, r1, r5, round(map50, 6) AS map50, round(map_all, 6) AS map_all FROM tm""")
def metrics_temporal(spark: SparkSession, sf: str) -> DataFrame:
    d = _plain_names(results(spark, sf))
    return rounded(d.select("query_id", "lane", "r1", "r5", "map50", "map_all"), "map50", "map_all")


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, f AS (SELECT s.query_id, s.lane, min(CASE WHEN rel = 1 THEN rank END) AS first_rank
    FROM seeds s LEFT JOIN rels r ON r.query_id = s.query_id AND r.lane = s.lane GROUP BY ALL)
  SELECT query_id, count(first_rank) > 0 AS ceiling, CASE WHEN count(first_rank) = 1 THEN max(CASE WHEN first_rank IS NOT NULL THEN lane END) END AS unique_lane,
    CAST(max(CASE WHEN lane = 'text' THEN first_rank END) AS BIGINT) AS rank_text, CAST(max(CASE WHEN lane = 'lexical' THEN first_rank END) AS BIGINT) AS rank_lexical FROM f GROUP BY query_id""")
def lane_attribution(spark: SparkSession, sf: str) -> DataFrame:
    per_lane = ev.lane_attribution(both_runs(spark, sf), cut_lineage(B.truth(spark, sf)))
    d = ev.attribution_by_query(per_lane)
    rank = lambda lane: F.try_element_at("lanes", F.lit(lane))["first_rank"].cast("long")
    return d.select("query_id", "ceiling", "unique_lane", rank("text").alias("rank_text"), rank("lexical").alias("rank_lexical"))


_GROUPED = "grp AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'ocr' ELSE 'visual' END AS modality FROM ir)"


def _with_modality(df: DataFrame) -> DataFrame:
    return df.withColumn("modality", F.when(F.col("query_id") % 3 == 0, "speech").when(F.col("query_id") % 3 == 1, "ocr").otherwise("visual"))


_AGG = "round(avg(mrr), 4) AS mrr, round(avg(ndcg10), 4) AS ndcg10, round(avg(recall1), 4) AS recall1, round(avg(recall5), 4) AS recall5, round(avg(recall10), 4) AS recall10, count(*) AS n"


@query(f"WITH RECURSIVE {_BASE}, {_REL}, {_IR} SELECT lane, {_AGG} FROM ir GROUP BY lane")
def experiment_agg(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.aggregate(results(spark, sf).withColumn("lane", F.col("experiment")), "lane", ev.OVERLAP_METRICS)
    d = d.filter("scope != 'overall'").withColumn("lane", F.regexp_replace("scope", "^lane=", ""))
    return _plain_names(d).select("lane", "mrr", "ndcg10", "recall1", "recall5", "recall10", "n")


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_IR}, {_GROUPED}, lexical_run AS (SELECT * FROM grp WHERE lane = 'lexical')
  SELECT CASE WHEN grouping(modality) = 1 THEN 'overall' ELSE 'modality=' || modality END AS scope, {_AGG} FROM lexical_run GROUP BY GROUPING SETS ((), (modality))""")
def experiment_agg_by_group(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.score_queries(run_hits(spark, sf, "lexical"), cut_lineage(B.truth(spark, sf)))
    d = ev.aggregate(_with_modality(scored), "modality", ev.OVERLAP_METRICS)
    return _plain_names(d).select("scope", "mrr", "ndcg10", "recall1", "recall5", "recall10", "n")


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_GROUPED.replace('FROM ir', 'FROM seeds')}, f AS (SELECT s.query_id, s.lane, s.modality, min(CASE WHEN rel = 1 THEN rank END) AS fr
    FROM grp s LEFT JOIN rels r ON r.query_id = s.query_id AND r.lane = s.lane GROUP BY ALL),
  u AS (SELECT query_id, CASE WHEN count(fr) = 1 THEN max(CASE WHEN fr IS NOT NULL THEN lane END) END AS unique_lane FROM f GROUP BY query_id)
  SELECT CASE WHEN grouping(modality) = 1 THEN 'overall' ELSE 'modality=' || modality END AS scope, lane,
    round(avg(CASE WHEN fr IS NOT NULL THEN 1.0e0 ELSE 0 END), 4) AS hit10, count(CASE WHEN unique_lane = lane THEN 1 END) AS alone
  FROM f JOIN u USING (query_id) GROUP BY GROUPING SETS ((lane), (lane, modality))""")
def experiment_lanes(spark: SparkSession, sf: str) -> DataFrame:
    truth = cut_lineage(B.truth(spark, sf))
    per_lane = ev.lane_attribution(both_runs(spark, sf), truth)
    q = _with_modality(truth.select("query_id").distinct())
    d = ev.aggregate_lanes(per_lane, q, "modality")
    return d.select("scope", "lane", F.col("hit@10").alias("hit10"), F.col("unique").cast("long").alias("alone"))


_BOOT = """d AS (SELECT query_id, max(CASE WHEN lane = 'lexical' THEN mrr END) - max(CASE WHEN lane = 'text' THEN mrr END) AS delta FROM ir GROUP BY query_id),
 slots AS (SELECT delta, row_number() OVER (ORDER BY md5(query_id::VARCHAR), query_id) - 1 AS i FROM d),
 size AS (SELECT count(*) AS m, avg(delta) AS mean FROM d),
 draws AS (SELECT rep, ('0x' || substr(md5('0:' || rep || ':' || i), 1, 8))::BIGINT % m AS pick FROM slots, size, range(200) r(rep)),
 means AS (SELECT rep, avg(delta) AS mean FROM draws JOIN slots ON slots.i = pick GROUP BY rep),
 listed AS (SELECT list_sort(list(mean)) AS l FROM means)"""


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_IR}, {_BOOT} SELECT 'lexical' AS experiment, 'mrr' AS metric, m, round(mean, 6) AS mean,
  round(l[5], 6) AS lo, round(l[195], 6) AS hi FROM size, listed""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.compare(results(spark, sf), "text", ["mrr"], n=200)
    return rounded(d.select("experiment", "metric", "m", "mean", "lo", "hi"), "mean", "lo", "hi")


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_IR}, {_BOOT.replace('range(200)', 'range(1000)')},
  a AS (SELECT lane AS experiment, round(avg(mrr), 4) AS mrr, round(avg(recall1), 4) AS recall1, round(avg(recall5), 4) AS recall5, round(avg(recall10), 4) AS recall10 FROM ir GROUP BY lane)
  SELECT a.*, CASE WHEN experiment = 'lexical' THEN round(mean, 6) END AS delta, CASE WHEN experiment = 'lexical' THEN round(l[25], 6) END AS lo,
   CASE WHEN experiment = 'lexical' THEN round(l[975], 6) END AS hi FROM a, size, listed""")
def ablation_table(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.ablation_table(results(spark, sf), "text").drop("significant")
    for c in ("recall@1", "recall@5", "recall@10"):
        d = d.withColumnRenamed(c, c.replace("@", ""))
    return rounded(d, "delta", "lo", "hi")


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_IR} SELECT lane, query_id, CAST(first_rank AS BIGINT) AS first_rank FROM ir WHERE first_rank IS NULL OR first_rank > 5""")
def miss_list(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.misses(results(spark, sf))
    return d.select(F.col("experiment").alias("lane"), "query_id", F.col("first_rank").cast("long").alias("first_rank"))


@query(f"""WITH RECURSIVE {_BASE}, {_REL}, {_IR} SELECT a.query_id, round(a.mrr, 6) AS before, round(b.mrr, 6) AS after FROM ir a JOIN ir b ON a.query_id = b.query_id
  AND a.lane = 'text' AND b.lane = 'lexical' WHERE abs(a.mrr - b.mrr) > 1e-9""")
def mrr_changes(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    d = ev.metric_changes(r.filter("experiment = 'text'"), r.filter("experiment = 'lexical'"))
    return rounded(d, "before", "after")


_IOU_ROW = """(CASE WHEN a.video = b.video THEN greatest(0, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) /
   ((a.end_s - a.start_s) + (b.end_s - b.start_s) - greatest(0, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s))) ELSE 0 END)"""
# labels moved by four seconds, so that the best segment is a real choice
_SHIFTED = "moved AS (SELECT query_id, video, start_s + 4 AS start_s, end_s + 4 AS end_s FROM truth)"
_BESTPOS = f"""bp AS (SELECT query_id, segment_id AS positive_id, v AS iou FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, start_s, segment_id) AS nr FROM (
   SELECT b.query_id, a.segment_id, a.start_s, {_IOU_ROW} AS v FROM (SELECT segment_id, video_id AS video, start_s, end_s FROM spans) a JOIN moved b ON a.video = b.video) WHERE v > 0) WHERE nr = 1)"""


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    t = B.truth(spark, sf)
    return t.withColumn("start_s", F.col("start_s") + 4).withColumn("end_s", F.col("end_s") + 4)


@query(f"WITH {B.SPANS}, {B.TRUTH}, {_SHIFTED}, {_BESTPOS} SELECT query_id, positive_id, round(iou, 6) AS iou FROM bp")
def best_positive_iou(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.best_positive(_moved(spark, sf), B.spans_only(spark, sf))
    return rounded(d.select("query_id", "positive_id", F.col("positive_iou").alias("iou")), "iou")


_NEG = f"""{_SHIFTED}, {_BESTPOS}, lx AS (SELECT * FROM hits WHERE lane = 'lexical'),
 bad AS (SELECT a.query_id, a.rank, max({_IOU_ROW}) AS v FROM lx a JOIN moved b ON a.query_id = b.query_id GROUP BY ALL),
 neg AS (SELECT * FROM (SELECT l.query_id, l.segment_id, l.rank, positive_id, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS nth
    FROM lx l JOIN bp USING (query_id) LEFT JOIN bad USING (query_id, rank) WHERE l.segment_id <> positive_id AND coalesce(v, 0) <= 0.1) WHERE nth <= 5)"""


@query(f"WITH {_BASE}, {_NEG} SELECT query_id, segment_id, CAST(rank AS BIGINT) AS rank, positive_id, nth FROM neg")
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.mine_negatives(run_hits(spark, sf, "lexical"), cut_lineage(_moved(spark, sf)), B.spans_only(spark, sf))
    return d.select("query_id", "segment_id", F.col("rank").cast("long").alias("rank"), "positive_id", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_BASE}, {_NEG}, o AS (SELECT query_id, row_number() OVER (ORDER BY md5('0:' || query_id), query_id) - 1 AS p, greatest(1, count(*) OVER () // 10) AS dev FROM (SELECT DISTINCT query_id FROM neg)),
  pairs AS (SELECT DISTINCT query_id, positive_id AS segment_id, 1.0e0 AS label FROM neg UNION ALL SELECT query_id, segment_id, 0.0e0 FROM neg WHERE nth <= 4)
  SELECT query_id, segment_id, label, CASE WHEN p < dev THEN 'dev' ELSE 'train' END AS split, md5(substring(s.text, 1, 1500)) AS passage
  FROM pairs JOIN o USING (query_id) JOIN spans s USING (segment_id)""")
def train_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import passage

    neg = ev.mine_negatives(run_hits(spark, sf, "lexical"), cut_lineage(_moved(spark, sf)), B.spans_only(spark, sf))
    neg = cut_lineage(neg)
    docs = B.documents(spark, sf).select(F.col("doc_id").alias("segment_id"), passage(F.col("text"), F.lit("")).alias("passage"))
    pairs = ev.training_pairs(neg, B.plain_queries(spark, sf), docs)
    return pairs.select("query_id", "segment_id", "label", "split", F.md5("passage").alias("passage"))


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Lane outcomes of every benchmark query: is a segment of the query's own label in the lane's top ten."""
    emb = B.table(spark, sf, "embeddings").select("vec_id", "label")
    hits = both_runs(spark, sf).filter("rank <= 10")
    own = emb.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    seen = hits.join(emb.withColumnRenamed("vec_id", "segment_id"), "segment_id", "left").join(own, "query_id")
    per = seen.groupBy("query_id", "lane").agg(F.min(F.when((F.col("label") == F.col("own")) & (F.col("segment_id") != F.col("query_id")), F.col("rank"))).alias("first_rank"))
    per = per.withColumn("hit@10", F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0))
    return ev.attribution_by_query(per)


@query(f"""WITH {_BASE}, own AS (SELECT vec_id AS query_id, label AS own FROM embeddings), per AS (SELECT h.query_id, h.lane,
    min(CASE WHEN e.label = own AND h.segment_id <> h.query_id THEN h.rank END) AS fr FROM hits h JOIN own USING (query_id) LEFT JOIN embeddings e ON e.vec_id = h.segment_id GROUP BY ALL)
  SELECT query_id, lane, CASE WHEN fr IS NULL THEN 0.0e0 ELSE 1.0e0 END AS label FROM per""")
def router_labels(spark: SparkSession, sf: str) -> DataFrame:
    return training_rows(_recorded(spark, sf)).select("query_id", "lane", "label")


@query("""WITH o AS (SELECT item_id AS query_id, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark)
  SELECT query_id, p < floor(n * 0.2) AS held_out FROM o""")
def router_holdout(spark: SparkSession, sf: str) -> DataFrame:
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return holdout_split(q, 0.2, 0)


@query()
def router_train_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Train on recorded outcomes, save, load by name, then route the same queries with the learned weights."""
    labels = cut_lineage(training_rows(_recorded(spark, sf)))
    q = B.phrased_queries(spark, sf).join(B.plain_queries(spark, sf).drop("text"), "query_id").filter("query_vector IS NOT NULL")
    plans = cut_lineage(decompose(q))
    folder = f"{shared_dir(spark).rstrip('/')}/routers-{uuid.uuid4().hex}"
    save_router(train_router(plans, labels, "v1"), folder)
    routed = get_router("learned:v1", folder=folder).route(plans, V.LANE_WEIGHTS)
    w = lambda lane: F.round(F.try_element_at("weights", F.lit(lane)), 4)
    return routed.select("query_id", w("text").alias("w_text"), w("lexical").alias("w_lexical"), w("visual").alias("w_visual"))


# --- a recorded experiment ----------------------------------------------------------------------

NAMES = {m: m.replace("@0.5", "_50").replace("@0.75", "_75").replace("@0.7", "_70").replace("@", "") for m in ev.METRICS}


def _dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries, clips, videos, truth): sources are clips and videos, one in ten of which has failed; a benchmark item belongs
    to the source of the first document that holds it, and one in five is for training."""
    truth = cut_lineage(B.truth(spark, sf))
    owner = truth.groupBy("query_id").agg(F.min_by("video", "segment_id").alias("dataset_video_id"))
    split = F.when(F.col("query_id") % 5 == 4, "train").otherwise("test").alias("split")
    items = B.plain_queries(spark, sf).join(owner, "query_id")
    queries = _with_modality(items.select("query_id", F.col("query_id").cast("string").alias("external_id"), F.lit("items").alias("dataset"), split, "dataset_video_id", "text", "query_vector"))
    sources = B.table(spark, sf, "documents").select(F.col("source").alias("video_id")).distinct()
    clips = sources.select(F.lit("items").alias("dataset"), F.col("video_id").alias("dataset_video_id"), F.col("video_id").alias("external_id"), "video_id")
    number = F.regexp_extract("video_id", "([0-9]+)$", 1).cast("int")
    videos = sources.select("video_id", F.when(number % 10 == 7, "failed").otherwise("ready").alias("status"))
    return queries, clips, videos, truth


def stored_run(spark: SparkSession, sf: str) -> tuple[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """Run the hybrid search over the evaluable test queries; where its records are, and the tables they belong to."""
    data = queries, clips, videos, truth = _dataset(spark, sf)
    spec = ExperimentSpec("hybrid", "items", scope="corpus", search={"lanes": {lane: 0.0 for lane in V.LANES} | {"text": 1.0, "lexical": 0.8}, "router": "fixed"})
    asked = cut_lineage(ev.load_queries(queries, clips, videos, spec))
    corpus = Corpus(B.segments(spark, sf), vectors=vectors(spark, sf).withColumnRenamed("embedding", "text_embedding"))
    sink = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    ev.run_experiment(spec, asked, truth.join(asked.select("query_id"), "query_id", "left_semi"), corpus, base=SearchConfig(), sink=sink, vectors={"text": "query_vector"})
    return sink, data


_EVALUABLE = """own AS (SELECT query_id, arg_min(video, segment_id) AS video_id FROM truth GROUP BY query_id),
ev AS (SELECT query_id FROM own WHERE query_id % 5 <> 4 AND CAST(regexp_extract(video_id, '([0-9]+)$', 1) AS INT) % 10 <> 7)"""
_RUN = f"""{B.SPANS}, {B.TRUTH}, {_EVALUABLE},
hits AS (SELECT query_id, 'run' AS lane, CAST(rank AS INT) AS rank, segment_id, video_id AS video, start_s, end_s, score FROM ({ORACLES['search_hybrid']}) WHERE query_id IN (SELECT query_id FROM ev)),
tl AS (SELECT query_id, list({{'v': video, 's': start_s, 'e': end_s}} ORDER BY start_s, end_s, video) AS t, count(*) AS n FROM truth WHERE query_id IN (SELECT query_id FROM ev) GROUP BY query_id),
seeds AS (SELECT query_id, 'run' AS lane, n, t FROM tl)"""


def _within(k: int, level: float) -> str:
    return f"(SELECT coalesce(max(CASE WHEN rank <= {k} AND v >= {level} THEN 1.0e0 END), 0) FROM best b WHERE b.query_id = i.query_id)"


def _precision(level: float) -> str:
    return f"(SELECT max(CASE WHEN thr = {level} THEN total END) / i.n_relevant FROM aps a WHERE a.query_id = i.query_id)"


_SCORES = {
    "mrr": "mrr", "ndcg10": "ndcg10", "recall1": "recall1", "recall5": "recall5", "recall10": "recall10",
    "hit1": "CASE WHEN first_rank <= 1 THEN 1.0e0 ELSE 0 END", "hit5": "CASE WHEN first_rank <= 5 THEN 1.0e0 ELSE 0 END", "hit10": "CASE WHEN first_rank <= 10 THEN 1.0e0 ELSE 0 END",
    "r1_50": _within(1, 0.5), "r1_70": _within(1, 0.7), "r5_50": _within(5, 0.5), "r5_70": _within(5, 0.7),
    "map_50": _precision(0.5), "map_75": _precision(0.75), "map": "(SELECT avg(total) / i.n_relevant FROM aps a WHERE a.query_id = i.query_id)",
}
_ALL = f"""{_REL}, {_IR}, {_AP}, scores AS (SELECT query_id, n_relevant, CAST(first_rank AS BIGINT) AS first_rank, {', '.join(f'{sql} AS {name}' for name, sql in _SCORES.items())} FROM ir i)"""


@query(f"WITH RECURSIVE {_RUN}, {_ALL} SELECT query_id, n_relevant, first_rank, {', '.join(f'round({m}, 6) AS {m}' for m in _SCORES)} FROM scores")
def experiment_run(spark: SparkSession, sf: str) -> DataFrame:
    """All fifteen metrics of every query, read back from the records of a run."""
    sink, (queries, clips, videos, _) = stored_run(spark, sf)
    rows = rec.evaluated(rec.stored(spark, sink, "hybrid", "long"), queries, clips, videos)
    d = rec.metric_columns(rows).select("query_id", *[F.col(c).cast("long").alias(c) for c in ("n_relevant", "first_rank")], *[F.col(f"`{m}`").alias(n) for m, n in NAMES.items()])
    return rounded(d, *NAMES.values())


@query(f"""WITH RECURSIVE {_RUN}, {_ALL}, grp AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'ocr' ELSE 'visual' END AS modality FROM scores)
  SELECT 'done' AS status, CASE WHEN grouping(modality) = 1 THEN 'overall' ELSE 'modality=' || modality END AS scope, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _SCORES)}, count(*) AS n,
    CASE WHEN grouping(modality) = 1 THEN count(*) END AS told, CASE WHEN grouping(modality) = 1 THEN round(avg(mrr), 4) END AS told_mrr
  FROM grp GROUP BY GROUPING SETS ((), (modality))""")
def experiment_report(spark: SparkSession, sf: str) -> DataFrame:
    """The stored run's report: means overall and by modality, beside what the ledger says of it."""
    sink, (queries, clips, videos, _) = stored_run(spark, sf)
    rows = rec.evaluated(rec.stored(spark, sink, "hybrid", "long"), queries, clips, videos)
    d = ev.aggregate(rec.metric_columns(rows).join(queries.select("query_id", "modality"), "query_id"), "modality")
    run = rec.ledger(spark, sink).where("experiment = 'hybrid'")
    told = run.select("status", F.lit("overall").alias("scope"), F.col("n_queries").alias("told"), F.get_json_object("overall", "$.mrr").cast("double").alias("told_mrr"))
    d = d.select("scope", *[F.col(f"`{m}`").alias(n) for m, n in NAMES.items()], "n").join(told.drop("status"), "scope", "left")
    return d.join(F.broadcast(run.select("status")), F.lit(True))  # one row


_LANE_RUN = f"""{DENSE}, {lexical_sql()}, {B.SPANS}, {B.TRUTH}, {_EVALUABLE},
lanes AS (SELECT query_id, 'text' AS lane, segment_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT query_id, 'lexical', segment_id, rank FROM lexical WHERE rank <= 10),
hits AS (SELECT l.query_id, l.lane, CAST(l.rank AS INT) AS rank, l.segment_id, s.video_id AS video, s.start_s, s.end_s FROM lanes l JOIN spans s USING (segment_id)),
tl AS (SELECT query_id, list({{'v': video, 's': start_s, 'e': end_s}} ORDER BY start_s, end_s, video) AS t, count(*) AS n FROM truth WHERE query_id IN (SELECT query_id FROM ev) GROUP BY query_id),
seeds AS (SELECT query_id, lane, n, t FROM tl JOIN (SELECT DISTINCT query_id, lane FROM hits) USING (query_id))"""


@query(f"""WITH RECURSIVE {_LANE_RUN}, {_REL}, f AS (SELECT s.query_id, s.lane, min(CASE WHEN rel = 1 THEN rank END) AS first_rank FROM seeds s LEFT JOIN rels r ON r.query_id = s.query_id AND r.lane = s.lane GROUP BY ALL)
  SELECT query_id, lane, CAST(first_rank AS BIGINT) AS first_rank, CASE WHEN first_rank IS NULL THEN 0.0e0 ELSE 1.0e0 END AS hit10,
    first_rank IS NOT NULL AND count(first_rank) OVER (PARTITION BY query_id) = 1 AS is_unique, count(first_rank) OVER (PARTITION BY query_id) > 0 AS ceiling FROM f""")
def stored_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """How each lane did, taken out of the stored run."""
    sink, (queries, clips, videos, _) = stored_run(spark, sf)
    rows = rec.evaluated(rec.stored(spark, sink, "hybrid", "long"), queries, clips, videos)
    return rec.explode_lanes(rows).select("query_id", "lane", F.col("first_rank").cast("long").alias("first_rank"), "hit10", "is_unique", "ceiling")


@query(f"""WITH RECURSIVE {_RUN}, {_SHIFTED.replace('FROM truth', 'FROM truth WHERE query_id IN (SELECT query_id FROM ev)')}, {_BESTPOS},
 bad AS (SELECT a.query_id, a.rank, max({_IOU_ROW}) AS v FROM hits a JOIN moved b ON a.query_id = b.query_id GROUP BY ALL),
 neg AS (SELECT * FROM (SELECT l.query_id, l.segment_id, l.rank, l.score, positive_id, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS nth
    FROM hits l JOIN bp USING (query_id) LEFT JOIN bad USING (query_id, rank) WHERE l.segment_id <> positive_id AND coalesce(v, 0) <= 0.1) WHERE nth <= 5)
 SELECT query_id, segment_id, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score, positive_id, nth FROM neg""")
def stored_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives mined from the stored run; labels are moved by four seconds, as in `hard_negatives`."""
    sink, (queries, clips, videos, truth) = stored_run(spark, sf)
    rows = rec.evaluated(rec.stored(spark, sink, "hybrid", "long"), queries, clips, videos)
    moved = truth.withColumn("start_s", F.col("start_s") + 4).withColumn("end_s", F.col("end_s") + 4)
    d = rec.mine_stored(rows, moved, B.spans_only(spark, sf), ids="long")
    return rounded(d.select("query_id", "segment_id", F.col("rank").cast("long").alias("rank"), "score", "positive_id", F.col("nth").cast("long").alias("nth")), "score", digits=4)
