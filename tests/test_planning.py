import pytest
from pyspark.sql import functions as F

from spanfinder.config import SearchConfig
from spanfinder.functions.text import highlight, terms
from spanfinder.functions.fixed_values import LANE_WEIGHTS
from spanfinder.plans.learned_router import apply_probabilities
from spanfinder.plans.query_planning import decompose
from spanfinder.plans.routing import HeuristicRouter, pin_weights


def plans(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
    return HeuristicRouter().route(decompose(q), LANE_WEIGHTS).orderBy("query_id").collect()


def test_spoken_split_and_visual_queries(spark):
    a, b, c, d = plans(
        spark,
        "Find where the professor explains B+ tree leaf nodes",
        "when the speaker mentions latency while showing an architecture diagram",
        "someone holding a red umbrella",
        'the slide titled "Transactions and WAL"',
    )
    assert a["speech_q"] == "B+ tree leaf nodes" and "speech" in a["cues"]
    assert a["terms"] == ["b+", "tree", "leaf", "nodes"]
    assert a["weights"]["visual"] < a["weights"]["text"]
    assert b["speech_q"] == "latency" and "architecture diagram" in b["visual_q"] and "split" in b["cues"]
    assert "visual" in c["cues"] and c["weights"]["visual"] > c["weights"]["text"]
    assert d["phrases"] == ["Transactions and WAL"] and "ocr" in d["cues"] and d["weights"]["ocr"] > 0.6


def test_terms_drop_stop_words(spark):
    row = spark.range(1).select(terms(F.lit("find the moment where the cat sat")).alias("t")).first()
    assert row["t"] == ["cat", "sat"]


def test_highlight_escapes_and_marks(spark):
    row = spark.range(1).select(highlight(F.lit("B+ trees <are> balanced"), F.array(F.lit("b+"), F.lit("balanced"))).alias("h")).first()
    assert row["h"] == "<mark>B+</mark> trees &lt;are&gt; <mark>balanced</mark>"


def test_long_text_is_cut_around_the_first_match(spark):
    text = "x" * 500 + " needle " + "y" * 500
    h = spark.range(1).select(highlight(F.lit(text), F.array(F.lit("needle"))).alias("h")).first()["h"]
    assert h.startswith("…") and h.endswith("…") and "<mark>needle</mark>" in h


def test_overrides_are_checked():
    cfg = SearchConfig().with_overrides({"lanes": {"visual": 0}, "rrf_k": "70"})
    assert cfg.lanes["visual"] == 0.0 and cfg.lanes["text"] == 1.0 and cfg.rrf_k == 70
    for bad, error in (({"nope": 1}, KeyError), ({"lanes": {"smell": 1}}, KeyError), ({"rerank": "yes"}, TypeError), ({"rrf_k": None}, ValueError)):
        with pytest.raises(error):
            SearchConfig().with_overrides(bad)


def test_pinned_weights_win(spark):
    q = spark.createDataFrame([(1, "cats")], "query_id bigint, text string")
    w = pin_weights(HeuristicRouter().route(decompose(q), LANE_WEIGHTS), {"visual": 0.0, "unknown": 3.0}).first()["weights"]
    assert w["visual"] == 0.0 and "unknown" not in w


def test_learned_weights_scale_and_drop(spark):
    p = spark.range(1).select(F.create_map(F.lit("text"), F.lit(0.8), F.lit("ocr"), F.lit(0.1), F.lit("visual"), F.lit(0.4)).alias("probs"))
    w = apply_probabilities(p, {"text": 1.0, "ocr": 0.6, "visual": 0.8, "caption": 0.0, "lexical": 0.8}).first()["weights"]
    assert w == pytest.approx({"text": 1.0, "ocr": 0.0, "visual": 0.4, "caption": 0.0, "lexical": 0.8})
