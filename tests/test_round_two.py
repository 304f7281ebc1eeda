"""Null keys, short labels, halves by position, options that used to be caps."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spanfinder.catalog.bindings import holds
from spanfinder.operators.ordered import positions, running
from spanfinder.operators.quantiles import nearest_rank
from spanfinder.plans.learned_router import save_router, train_router
from spanfinder.plans.proposals import window_halves
from spanfinder.plans.routing import get_router
from spanfinder.plans.segments import pending_captions
from spanfinder.session import shared_dir


def test_running_keeps_null_groups(spark):
    rows = [("a", 1, 5), ("a", 2, 7), (None, 1, 3), (None, 4, 4), ("b", None, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v long")
    got = {(r["g"], r["o"]): r["upto"] for r in running(df, ["g"], ["o"], F.floor(F.col("o") / 3), "v", "sum", "upto").collect()}
    assert got == {("a", 1): 5, ("a", 2): 12, (None, 1): 3, (None, 4): 7, ("b", None): 1}
    assert positions(df, ["g"], ["o"], F.floor(F.col("o") / 3)).count() == len(rows)


def test_percentiles_keep_null_groups(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(10)] + [("a", 1.0), ("a", 1e12)], "g string, v double")
    got = {r["g"]: (r["p50"], r["n"]) for r in nearest_rank(df, ["g"], "v", {"p50": 0.5}).collect()}
    assert got == {None: (5.0, 10), "a": (1e12, 2)}


def test_items_of_any_length_are_found(spark):
    texts = ["one two three four five six seven eight", "xone two threey", "nothing here", "two", None, ""]
    items = ["two", "o", "one two", "two three four", "one two three four five", "two three four five six seven", "", "absent", None, "four two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    got = {(r["item_id"], r["doc_id"]) for r in holds(docs, wanted).collect()}
    assert got == {(i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x is not None and t is not None and x in t}
    assert holds(docs, wanted.limit(0)).count() == 0


def test_halves_go_by_position(spark):
    df = spark.createDataFrame([("v", w) for w in (3, 10, 2000, 2001, 5000)], "video string, window long")
    got = sorted((r["half"], r["window"]) for r in window_halves(df).collect())
    assert got == [(0, 3), (0, 10), (0, 2000), (1, 2000), (1, 2001), (1, 5000)]


def test_null_captions_are_pending(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "segment_id int, caption_text string")
    assert {r["segment_id"] for r in pending_captions(df).collect()} == {1, 2}


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_a_saved_router_is_found_by_name(spark, place):
    rows = [(i, f"term{i % 7} said", [float(i % 2), 1.0], [["speech"], ["visual"], []][i % 3], ["said"], [], f"term{i % 7}", f"term{i % 7}") for i in range(40)]
    plans = spark.createDataFrame(rows, "query_id long, raw string, query_vector array<double>, cues array<string>, terms array<string>, phrases array<string>, speech_q string, visual_q string")
    labels = spark.createDataFrame([(i, lane, float((i + n) % 2)) for i in range(40) for n, lane in enumerate(("text", "visual"))] + [(i, "ocr", 0.0) for i in range(40)], "query_id long, lane string, label double")
    router = train_router(plans, labels, "v7")
    save_router(router, place)
    loaded = get_router("learned:v7", folder=place)
    base = {"text": 1.0, "visual": 0.5, "ocr": 0.4}
    want, got = ({r["query_id"]: {k: round(v, 9) for k, v in r["weights"].items()} for r in x.route(plans, base).collect()} for x in (router, loaded))
    assert want == got and loaded.priors == router.priors and loaded.name == "learned:v7"
    with pytest.raises(ValueError):
        get_router("learned:v7")
