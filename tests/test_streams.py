"""Streams with state: completion, late rows, chunks that arrive in parts."""

import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from spanfinder.plans import segments as sg
from spanfinder.streaming import jobs as st

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def reports(spark, place):
    """Feeds batches of reports to the completion job and returns the table of what it told."""

    def feed(*batches, state=None, **options):
        src, sink = f"{place}/reports", f"{place}/told"
        for batch in batches:
            if batch:
                spark.createDataFrame(batch, st.REPORT).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(st.REPORT).parquet(src)
            st.stream_finalize(stream, sink, state or f"{place}/state", **options).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(st.FINAL).parquet(sink).collect())

    return feed


def test_a_chunk_counts_once_whenever_it_is_reported_again(reports):
    first = [("v", 0, "pending", 2, at(0)), ("v", 0, "done", 2, at(1)), ("w", 0, "done", 1, at(1))]
    late_repeat = [("v", 0, "done", 2, at(180)), ("w", 0, "done", 1, at(600))]
    assert reports(first, late_repeat) == [("w", "ready", 0, 1)]  # chunk 1 of v was never seen
    behind = [("v", 1, "done", 2, at(2))]  # far behind the watermark that a windowed job would have
    assert reports(behind) == [("v", "ready", 0, 2), ("w", "ready", 0, 1)]


def test_a_second_try_turns_failed_into_ready(reports):
    failed = [("v", 0, "done", 2, at(1)), ("v", 1, "failed", 2, at(1))]
    assert reports(failed) == [("v", "failed", 1, 2)]
    assert reports([("v", 1, "pending", 2, at(5))], [("v", 1, "done", 2, at(6))]) == [("v", "failed", 1, 2), ("v", "ready", 0, 2)]
    # tries that end before all chunks have ended are not told
    assert reports([("w", 0, "failed", 2, at(1))], [("w", 0, "done", 2, at(2))], [("w", 1, "done", 2, at(2))])[-1] == ("w", "ready", 0, 2)
    # an older report that comes later changes nothing
    assert len(reports([("w", 0, "failed", 2, at(1))])) == 3


def test_a_replay_after_expiry_tells_nothing_twice(reports, place):
    rows = [("v", i, "done", 3, at(i)) for i in range(3)] + [("u", 0, "done", 2, at(0))]
    want = [("v", "ready", 0, 3)]
    assert reports(rows, told_ms=1) == want
    time.sleep(0.1)
    assert reports([("x", 0, "pending", 1, at(1))], told_ms=1) == want  # the timer of v goes off
    assert reports(rows, told_ms=1) == want  # all is told again to a state that has forgotten v
    assert reports(None, state=f"{place}/another") == want  # and to a new job
    assert reports([("u", 1, "done", 2, at(9))]) == [("u", "ready", 0, 2), *want]  # an open video is not forgotten


def test_nulls_are_not_chunks(reports):
    rows = [(None, 0, "done", 1, at(0)), ("v", None, "done", 1, at(0)), ("v", 0, "done", 1, None), ("v", 0, None, 1, at(0)), ("y", 0, "done", 1, at(0))]
    assert reports(rows) == [("y", "ready", 0, 1)]


def test_late_rows_are_kept_apart_and_the_raw_table_is_whole(spark, place):
    schema = "id long, ts timestamp"
    batches = [[(1, at(0)), (2, at(31))], [(3, at(22)), (4, at(19)), (5, at(16)), (6, None)], [(7, at(60))], [(8, at(44)), (9, at(51))]]
    for _ in range(2):  # the second time from a new checkpoint: the same folders, the same rows
        state = f"{place}/{uuid.uuid4().hex}"
        src = f"{place}/{uuid.uuid4().hex}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            st.stream_raw(spark.readStream.schema(schema).parquet(src), f"{place}/raw", f"{place}/late", state).awaitTermination()
        assert sorted(r["id"] for r in spark.read.schema(schema).parquet(f"{place}/raw").collect()) == list(range(1, 10))
        # at 31 minutes the windows up to 20 are closed, at 60 those up to 50
        assert sorted(r["id"] for r in spark.read.schema(schema).parquet(f"{place}/late/rows").collect()) == [4, 5, 8]
        marks = spark.read.parquet(f"{place}/late/marks").orderBy("batch").collect()
        assert [(r["n"], r["n_late"]) for r in marks] == [(2, 0), (4, 2), (1, 0), (2, 1)]


def test_a_chunk_in_two_batches_is_whole(spark, place):
    words = lambda a: [(f"w{i}", a + i / 10, a + i / 10 + 0.1) for i in range(5)]
    rows = [(v, c, 60.0 * c + 5 * i, 60.0 * c + 5 * i + 4, f"text {i}", words(60.0 * c + 5 * i)) for v in ("a", "b") for c in (0, 1) for i in range(12)]
    schema = "video_id string, chunk_index int, start_s double, end_s double, text string, words array<struct<w:string,s:double,e:double>>"
    heard = spark.createDataFrame(rows, schema)
    chunks = spark.createDataFrame([(v, c, 60.0 * c, 60.0 * c + 60) for v in ("a", "b") for c in (0, 1)], "video_id string, chunk_index int, start_s double, end_s double")
    for step in (F.col("start_s") < 30, F.col("start_s") >= 30, F.lit(False)):
        heard.where(step).write.mode("append").parquet(f"{place}/src")
        st.stream_index(spark.readStream.schema(heard.schema).parquet(f"{place}/src"), chunks, f"{place}/sink", f"{place}/state", buckets=3).awaitTermination()
    cols = ["video_id", "chunk_index", "index", "start_s", "end_s", "text", "context_text"]
    want = sg.build_segments(chunks, sg.trim_utterances(heard, chunks)).select(*cols)
    got = spark.read.parquet(f"{place}/sink/segments").select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_words_reach_a_chunk_of_another_batch(spark, place):
    """An utterance of one chunk runs into the next, which came in a batch before or comes in one after."""
    words = lambda a, n: [(f"w{a + i:g}", a + i, a + i + 0.5) for i in range(n)]
    rows = [("a", 0, 50.0, 70.0, words(50.0, 20)), ("a", 1, 80.0, 90.0, words(80.0, 10)), ("a", 1, 110.0, 130.0, words(110.0, 20)), ("a", 2, 140.0, 150.0, words(140.0, 10)), ("b", 0, 0.0, 9.0, [])]
    heard = spark.createDataFrame(rows, "video_id string, chunk_index int, start_s double, end_s double, words array<struct<w:string,s:double,e:double>>")
    chunks = spark.createDataFrame([(v, c, 60.0 * c, 60.0 * c + 60) for v in ("a", "b") for c in range(3)], "video_id string, chunk_index int, start_s double, end_s double")
    for step in ("chunk_index > 0 AND start_s <> 110", "chunk_index = 0", "start_s = 110"):
        heard.where(step).repartition(8).write.mode("append").parquet(f"{place}/src")
        st.stream_index(spark.readStream.schema(heard.schema).parquet(f"{place}/src"), chunks, f"{place}/sink", f"{place}/state", buckets=2).awaitTermination()
    cols = ["video_id", "chunk_index", "index", "start_s", "end_s", "text", "context_text"]
    named = chunks.where("video_id = 'a' OR chunk_index = 0")  # also the one without a word
    want = sg.build_segments(named, sg.trim_utterances(heard, named)).select(*cols)
    assert sorted(map(str, spark.read.parquet(f"{place}/sink/segments").select(*cols).collect())) == sorted(map(str, want.collect()))


def test_an_index_has_few_files(spark, place):
    """A bucket is written by the tasks that its rows need, not by all that read a part of it."""
    rows = [(f"v{v}", 0, 5.0 * i, 5.0 * i + 4, [("w", 5.0 * i, 5.0 * i + 1)]) for v in range(40) for i in range(12)]
    heard = spark.createDataFrame(rows, "video_id string, chunk_index int, start_s double, end_s double, words array<struct<w:string,s:double,e:double>>")
    chunks = heard.select("video_id", "chunk_index", F.lit(0.0).alias("start_s"), F.lit(60.0).alias("end_s")).distinct()
    heard.repartition(8).write.parquet(f"{place}/src")
    st.stream_index(spark.readStream.schema(heard.schema).parquet(f"{place}/src"), chunks, f"{place}/sink", f"{place}/state", buckets=2).awaitTermination()
    for table, rows_with, n in (("utterances", "words IS NOT NULL", 480), ("segments", "text IS NOT NULL", 240)):
        written = spark.read.parquet(f"{place}/sink/{table}")
        assert written.where(rows_with).count() == n
        assert len(written.inputFiles()) == 2  # a bucket's own
