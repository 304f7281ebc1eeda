import json
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanfinder.catalog import QUERIES, streaming_queries
from spanfinder.sources import readers as R
from spanfinder.sources import sinks as S
from spanfinder.sources import versions as VS
from spanfinder.streaming import jobs

ROWS = [
    (1, "a man walks a dog", "abc_DEF-1_210.0_360.0", [[10, 20], [40, 48]]),
    (2, "cooking pasta", "abc_DEF-1_210.0_360.0", [[100, 120]]),
    (3, "a crowd cheers", "zzz9_0.0_150.0", [[0, 6]]),
    (4, "skateboard trick", "qqq_60.0_210.0", [[70, 90]]),
]


def write_rows(place):
    lines = [json.dumps({"qid": q, "query": t, "vid": v, "relevant_windows": w}) for q, t, v, w in ROWS]
    Path(place, "val.jsonl").write_text("\n".join(lines) + "\n")


def test_jsonl_benchmark(spark, place):
    write_rows(place)
    videos, queries = R.read_jsonl_benchmark(spark, f"{place}/val.jsonl")
    v = {r["external_id"]: r for r in videos.collect()}
    assert len(v) == 3 and v["abc_DEF-1_210.0_360.0"]["source_id"] == "abc_DEF-1" and v["zzz9_0.0_150.0"]["duration_s"] == 150.0
    assert queries.filter("external_id = '1'").first()["relevant"][1]["end_s"] == 48.0


def test_import_is_idempotent_and_keeps_queries_of_a_video(spark, place):
    write_rows(place)
    for _ in range(2):
        R.import_split(spark, "jsonl", place, "val", f"{place}/lib")
    assert spark.read.parquet(f"{place}/lib/dataset_videos").count() == 3
    assert spark.read.parquet(f"{place}/lib/dataset_queries").count() == 4
    Path(place, "ids.txt").write_text("abc_DEF-1_210.0_360.0\n\n")
    R.import_split(spark, "jsonl", place, "val", f"{place}/sub", ids=R.read_ids(spark, f"{place}/ids.txt"))
    assert spark.read.parquet(f"{place}/sub/dataset_queries").count() == 2


def test_dataset_document(spark, place):
    doc = {"videos": [{"key": "k", "title": "T"}], "queries": [{"id": "q", "text": "x", "modality": "ocr", "relevant": [{"video": "k", "start_s": 1, "end_s": 2}]}]}
    Path(place, "d.json").write_text(json.dumps(doc))
    videos, queries = R.read_dataset_doc(spark, f"{place}/d.json")
    assert videos.first()["title"] == "T" and queries.first()["video_external_id"] == "k"


def test_checkpoints_of_another_model_do_not_count(spark, place):
    d = Path(place, "vid1", "chunks", "3")
    d.mkdir(parents=True)
    d.joinpath("utterances.json").write_text(json.dumps({"model": "small", "utterances": [{"start": 0, "end": 1, "text": "hi", "words": [{"w": "hi", "s": 0, "e": 1}]}]}))
    chunks = spark.createDataFrame([("vid1", 3), ("vid1", 4)], "video_id string, chunk_index int")
    assert R.untranscribed(chunks, R.read_transcripts(spark, place, "small")).collect() == [("vid1", 4)]
    assert R.untranscribed(chunks, R.read_transcripts(spark, place, "large")).count() == 2


def test_replace_writes_rows_exactly_once(spark, place):
    d = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3)], "chunk string, x int")
    for _ in range(2):
        S.replace_partitions(d, f"{place}/t", ["chunk"])
    S.replace_partitions(d.filter("chunk = 'c2'").withColumn("x", F.col("x") * 10), f"{place}/t", ["chunk"])
    assert sorted(r["x"] for r in spark.read.parquet(f"{place}/t").collect()) == [1, 2, 30]


def test_purge_writes_touched_partitions_only_and_readers_see_whole_states(spark, place):
    rows = [("a", 1, "x"), ("b", 2, "x"), ("b", 3, "y z/=%"), ("a", 4, "w"), ("b", 5, None)]
    df = spark.createDataFrame(rows, "video_id string, n int, kind string")
    VS.commit(df, f"{place}/embeddings", ["kind"])
    VS.commit(df, f"{place}/segments")
    df.write.parquet(f"{place}/topics")  # not versioned: left alone
    before = VS.state(spark, f"{place}/embeddings")
    reader = VS.read(spark, f"{place}/embeddings")
    S.purge(spark, place, spark.createDataFrame([("a",), ("gone",)], "video_id string"))
    after = VS.state(spark, f"{place}/embeddings")
    ns = lambda d: sorted(r["n"] for r in d.collect())
    assert ns(VS.read(spark, f"{place}/embeddings")) == ns(VS.read(spark, f"{place}/segments")) == [2, 3, 5]
    assert ns(reader) == ns(VS.read(spark, f"{place}/embeddings", before)) == [1, 2, 3, 4, 5]
    assert {p: v for p, v in after.parts.items() if p in before.parts and v == before.parts[p]}.keys() == before.parts.keys() - {"kind=x", "kind=w"}
    assert "kind=w" not in after.parts and after.number == 2
    with pytest.raises(RuntimeError):  # made from a state that is not the last one
        VS.commit(df, f"{place}/embeddings", ["kind"], [], before)
    VS.vacuum(spark, f"{place}/embeddings")
    assert ns(VS.read(spark, f"{place}/embeddings")) == [2, 3, 5]
    assert R.Library(spark, place).table("segments").count() == 3


def test_upsert_by_partition(spark, place):
    path = f"{place}/t"
    put = lambda rows: S.upsert(spark.createDataFrame(rows, "k string, part string, at int"), path, ["k"], "at", ["part"])
    put([("a", "p", 1), ("b", "q", 1), ("c", "r", 1)])
    put([("a", "q", 2), ("d", "s", 1), ("b", "q", 0)])  # a moves, d is new, b is older
    assert sorted(map(tuple, VS.read(spark, path).select("k", "part", "at").collect())) == [("a", "q", 2), ("b", "q", 1), ("c", "r", 1), ("d", "s", 1)]
    assert VS.state(spark, path).parts["part=r"].startswith("v000001-") and "part=p" not in VS.state(spark, path).parts


def test_stream_index_equals_batch(spark):
    from spanfinder.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    cols = ["video_id", "index", "start_s", "end_s", "text", "context_text"]
    assert sorted(QUERIES["stream_index"](spark, sf).select(*cols).collect()) == sorted(QUERIES["build_segments"](spark, sf).select(*cols).collect())


def test_experiment_end_to_end(spark, place):
    from spanfinder.config import ExperimentSpec
    from spanfinder.plans import recorded as rec
    from spanfinder.plans.evaluation import METRICS, run_experiment
    from spanfinder.plans.search import Corpus

    seg = spark.createDataFrame(
        [("s1", "v", 0.0, 10.0, "a man walks a dog"), ("s2", "v", 40.0, 50.0, "cooking pasta"), ("s3", "w", 0.0, 10.0, "a crowd cheers")],
        "segment_id string, video_id string, start_s double, end_s double, text string",
    )
    q = spark.createDataFrame([("q1", "walks dog", "speech", "v"), ("q2", "cooking pasta", "visual", "v"), ("q3", "crowd cheers", "speech", "w")], "query_id string, text string, modality string, video_id string")
    truth = spark.createDataFrame([("q1", "v", 0.0, 10.0), ("q2", "v", 40.0, 50.0), ("q3", "w", 0.0, 10.0)], "query_id string, video string, start_s double, end_s double")
    spec = ExperimentSpec("base", "demo", search={"lanes": {"text": 0, "visual": 0, "ocr": 0}})
    out = run_experiment(spec, q, truth, Corpus(seg), sink=place)
    overall = out["overall"].filter("scope = 'overall'").first()
    assert overall["mrr"] == 1.0 and overall["n"] == 3 and overall["lane_ceiling"] == 1.0
    told = rec.ledger(spark, place).first()
    assert (told["status"], told["n_queries"], json.loads(told["overall"])["mrr"]) == ("done", 3, 1.0)
    rows = rec.stored(spark, place, "base")
    cols = ["query_id", "rank", "video", "segment_id", "start_s", "end_s", "score"]
    assert sorted(map(tuple, rec.explode_hits(rows).select(*cols).collect())) == sorted(map(tuple, out["hits"].select(*cols).collect()))
    again = {r["query_id"]: r.asDict() for r in rec.metric_columns(rows).drop("experiment", "n_relevant").collect()}
    assert all(again[r["query_id"]][m] == r[m] for r in out["results"].collect() for m in METRICS)
    assert {(r["query_id"], r["lane"], r["first_rank"], r["is_unique"]) for r in rec.explode_lanes(rows).collect()} == {(f"q{i}", "lexical", 1, True) for i in (1, 2, 3)}
    videos = spark.createDataFrame([("v",)], "video_id string")  # w has left the library
    clips = spark.createDataFrame([("demo", k, k, k) for k in ("v", "w")], "dataset string, dataset_video_id string, external_id string, video_id string")
    asked = q.selectExpr("query_id", "'demo' AS dataset", "video_id AS dataset_video_id", "text", "modality")
    assert {r["query_id"] for r in rec.evaluated(rows, asked, clips, videos).collect()} == {"q1", "q2"}
    with pytest.raises(Exception):  # noqa: B017
        run_experiment(ExperimentSpec("broken", "demo"), q.drop("text"), truth, Corpus(seg), sink=place)
    assert {r["experiment"]: r["status"] for r in rec.ledger(spark, place).collect()} == {"base": "done", "broken": "failed"}


def test_open_windows_are_kept(spark, place):
    """All events lie in the last ten minutes and in one day, so no window is closed at the end; each event is counted."""
    rows = [(i, i % 7, "view" if i % 3 else "click", float(i), datetime(2024, 5, 1, 12, 0) + timedelta(seconds=5 * i)) for i in range(100)]
    names = ("event_id", "user_id", "event_type", "value", "ts")
    pq.write_table(pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))), f"{place}/events.parquet")
    for name, windows in (("stream_rate_5m", 1), ("stream_rate_sliding", 5), ("stream_quantiles", 1)):
        assert sum(r["n"] for r in QUERIES[name](spark, place).collect()) == windows * len(rows)


def test_later_batches_replace_windows(spark, place):
    """Two batches with events of one window: its last count is stored, once."""
    kind = "event_type string, ts timestamp"
    for n in (3, 4):
        spark.createDataFrame([("view", datetime(2024, 5, 1, 12, 1))] * n, kind).coalesce(1).write.mode("append").parquet(f"{place}/log")
    log = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{place}/log")
    got = streaming_queries.collected(spark, jobs.stream_rates(log, ["event_type"]), "twice", streaming_queries.WINDOW).collect()
    assert [(r["event_type"], r["n"]) for r in got] == [("view", 7)]
