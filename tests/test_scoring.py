import pytest
from pyspark.sql import functions as F

from spanfinder.functions import spans as S
from spanfinder.operators import fusion as fu
from spanfinder.operators.quantiles import nearest_rank, paired_bootstrap
from spanfinder.plans import evaluation as ev
from spanfinder.plans.search import final_scores, suppress_hits
from spanfinder.config import SearchConfig

SPANS = "array<struct<video:string,start_s:double,end_s:double>>"


def lists(spark, hits, truth):
    return spark.createDataFrame([([("v", *h) if len(h) == 2 else h for h in hits], [("v", *t) for t in truth])], f"hits {SPANS}, truth {SPANS}")


def rels(spark, hits, truth):
    return lists(spark, hits, truth).select(S.relevance(F.col("hits"), F.col("truth")).alias("r")).first()["r"]


def test_each_truth_span_is_credited_once(spark):
    truth = [(20.0, 30.0)]
    assert rels(spark, [(0.0, 10.0), (28.0, 38.0), (25.0, 29.0), (32.0, 40.0)], truth) == [0, 1, 0, 0]
    assert rels(spark, [(32.0, 40.0)], truth) == [1]
    assert rels(spark, [("other", 20.0, 30.0)], truth) == [0]
    assert rels(spark, [(0.0, 1.0)], []) == [0]


def test_ir_metrics(spark):
    d = spark.createDataFrame([([0, 1, 0, 0, 1], 2), ([1, 1], 2)], "r array<int>, n int")
    m = d.select(*[c.alias(k.replace("@", "")) for k, c in S.ir_metrics(F.col("r"), F.col("n")).items()]).collect()
    assert m[0]["mrr"] == 0.5 and m[0]["recall5"] == 1 and m[0]["recall1"] == 0 and 0 < m[0]["ndcg10"] < 1
    assert m[1]["ndcg10"] == pytest.approx(1)


def one(spark, hits, truth, expr):
    return lists(spark, hits, truth).select(expr(F.col("hits"), F.col("truth")).alias("x")).first()["x"]


def test_temporal_metrics(spark):
    hits, truth = [(50.0, 60.0), (0.0, 10.0)], [(0.0, 12.0)]
    assert one(spark, hits, truth, lambda h, t: S.recall_at_iou(h, t, 1, 0.5)) == 0
    assert one(spark, hits, truth, lambda h, t: S.recall_at_iou(h, t, 5, 0.5)) == 1
    assert one(spark, hits, truth, lambda h, t: S.recall_at_iou(h, t, 5, 0.9)) == 0
    ap = lambda h, t: S.average_precision(h, t, F.lit(0.5))
    two = [(0.0, 10.0), (100.0, 110.0)]
    assert one(spark, [(0.0, 10.0), (40.0, 50.0), (100.0, 110.0)], two, ap) == pytest.approx((1 + 2 / 3) / 2)
    assert one(spark, [(0.0, 10.0), (1.0, 11.0)], two, ap) == pytest.approx(0.5)
    assert one(spark, [(0.0, 12.0)], [(0.0, 10.0)], S.mean_ap) == pytest.approx(0.7)


def lane_rows(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id bigint, lane string, segment_id string, score double").withColumns(
        {"span_start": F.lit(None).cast("double"), "span_end": F.lit(None).cast("double")}
    )


def weights(spark, **w):
    m = F.create_map(*[c for k, v in w.items() for c in (F.lit(k), F.lit(v))])
    return spark.range(1).select(F.lit(1).cast("bigint").alias("query_id"), m.alias("weights"))


def test_rrf_and_weighted_fusion(spark):
    p = weights(spark, text=1.0, visual=1.0)
    d = lane_rows(spark, [("text", "a", 0.9), ("text", "b", 0.8), ("visual", "b", 0.5), ("visual", "c", 0.4)])
    top = fu.fuse(d, p, "rrf").orderBy(F.desc("fused")).first()
    assert top["segment_id"] == "b" and set(top["signals"]) == {"text", "visual"}
    d = lane_rows(spark, [("text", "a", 0.9), ("text", "b", 0.1), ("visual", "b", 0.05), ("visual", "a", 0.01)])
    top = fu.fuse(d, weights(spark, text=1.0, visual=0.0), "weighted").orderBy(F.desc("fused")).first()
    assert top["segment_id"] == "a" and top["fused"] == 1.0


def test_visual_evidence_counts_only_with_weight(spark):
    rows = [(1, "a", 1.0, {"visual": 0.1}), (1, "b", 0.9, {"visual": 0.99})]
    for w, first in ((0.0, "a"), (1.0, "b")):
        d = spark.createDataFrame(rows, "query_id bigint, segment_id string, fused double, signals map<string,double>")
        d = final_scores(d.withColumn("weights", F.create_map(F.lit("visual"), F.lit(w))), SearchConfig().with_overrides({"rerank": False}))
        assert d.orderBy(F.desc("score")).first()["segment_id"] == first


def test_suppression(spark):
    rows = [("v1", 20, 0.9), ("v1", 30, 0.8), ("v1", 100, 0.7), ("v1", 200, 0.6), ("v1", 300, 0.5), ("v2", 0, 0.4)]
    d = spark.createDataFrame([(1, v, f"{v}-{s}", float(s), s + 10.0, x) for v, s, x in rows], "query_id bigint, video_id string, segment_id string, start_s double, end_s double, score double")
    kept = [r["segment_id"] for r in suppress_hits(d, 12.0, 3, 10).orderBy("rank").collect()]
    assert kept == ["v1-20", "v1-100", "v1-200", "v2-0"]
    lone = spark.createDataFrame([(1,)], "query_id bigint")
    assert suppress_hits(d, 12.0, 3, 10, uncapped=lone).count() == 5


def test_attribution(spark):
    truth = spark.createDataFrame([(1, "v", 20.0, 30.0)], "query_id bigint, video string, start_s double, end_s double")

    def run(rows):
        h = spark.createDataFrame([(1, lane, "v", s, s + 10.0, r) for lane, s, r in rows], "query_id bigint, lane string, video string, start_s double, end_s double, rank int")
        return ev.attribution_by_query(ev.lane_attribution(h, truth)).first()

    base = [("text", 500.0, 1), ("visual", 500.0, 1), ("ocr", 20.0, 1)]
    both = run(base + [("text", 20.0, 2)])
    assert both["ceiling"] and both["unique_lane"] is None and both["lanes"]["text"]["first_rank"] == 2
    assert run(base)["unique_lane"] == "ocr"
    assert run([("text", 20.0, 21)]) is None or not run([("text", 500.0, 1), ("text", 20.0, 21)])["ceiling"]


def test_score_queries_and_aggregate(spark):
    truth = spark.createDataFrame([("q1", "v", 0.0, 10.0), ("q2", "v", 100.0, 110.0)], "query_id string, video string, start_s double, end_s double")
    hits = spark.createDataFrame(
        [("q1", "v", 0.0, 10.0, 1), ("q2", "v", 0.0, 10.0, 1), ("q2", "v", 100.0, 110.0, 2)], "query_id string, video string, start_s double, end_s double, rank int"
    )
    scored = ev.score_queries(hits, truth).withColumn("modality", F.when(F.col("query_id") == "q1", "speech").otherwise("visual"))
    rows = {r["scope"]: r for r in ev.aggregate(scored, "modality").collect()}
    assert rows["overall"]["mrr"] == 0.75 and rows["overall"]["r1@0.5"] == 0.5 and rows["overall"]["r5@0.5"] == 1
    assert rows["modality=visual"]["mrr"] == 0.5


def test_bootstrap(spark):
    d = spark.createDataFrame([("e", i, x) for i, x in enumerate([0.1, 0.2, 0.05, 0.3, 0.15])], "experiment string, query_id bigint, delta double")
    a = paired_bootstrap(d, ["experiment"], "query_id").first()
    assert a["mean"] == pytest.approx(0.16) and a["lo"] > 0 and a["significant"]
    assert paired_bootstrap(d.repartition(7), ["experiment"], "query_id").first() == a
    assert paired_bootstrap(d.filter("false"), ["experiment"], "query_id").count() == 0


def test_nearest_rank_equals_sorting(spark):
    import random

    random.seed(3)
    rows = [(g, round(random.lognormvariate(0, 3), 3)) for g in range(4) for _ in range(37 * g + 1)]
    got = {r["g"]: r for r in nearest_rank(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}, None).collect()}
    for g in range(4):
        v = sorted(x for k, x in rows if k == g)
        assert got[g]["p50"] == v[min(len(v) - 1, int(len(v) * 0.5))] and got[g]["p95"] == v[min(len(v) - 1, int(len(v) * 0.95))]


def test_negatives(spark):
    seg = spark.createDataFrame([(f"s{i}", "v", i * 10.0, i * 10.0 + 10) for i in range(6)], "segment_id string, video_id string, start_s double, end_s double")
    truth = spark.createDataFrame([(1, "v", 22.0, 30.0)], "query_id bigint, video string, start_s double, end_s double")
    order = ["s5", "s2", "s3", "s0"]
    hits = spark.createDataFrame([(1, s, i + 1) for i, s in enumerate(order)], "query_id bigint, segment_id string, rank int").join(seg.withColumnRenamed("video_id", "video"), "segment_id")
    rows = ev.mine_negatives(hits, truth, seg, per_query=2).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 3] and {r["positive_id"] for r in rows} == {"s2"}
