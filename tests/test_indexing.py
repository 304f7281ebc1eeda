import pytest
from pyspark.sql import functions as F

from spanfinder.functions import media as M
from spanfinder.functions.numeric import hamming
from spanfinder.plans import segments as sg
from spanfinder.plans import timeline as tl


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_chunks(spark):
    ends = lambda d: [(c["start_s"], c["end_s"]) for c in value(spark, M.plan_chunks(F.lit(d)))]
    assert ends(185.0) == [(0, 60), (60, 120), (120, 185)]
    assert ends(130.0) == [(0, 60), (60, 130)]
    assert value(spark, M.plan_chunks(F.lit(0.0))) is None


def test_segments_snap_to_speech(spark):
    segs = value(spark, M.plan_segments(F.lit(0.0), F.lit(30.0), F.array(*[F.lit(x) for x in (4.0, 9.5, 18.0, 30.0)])))
    assert segs[0]["end_s"] == 9.5 and segs[-1]["end_s"] == 30.0
    assert all(a["end_s"] == b["start_s"] for a, b in zip(segs, segs[1:]))
    silent = value(spark, M.plan_segments(F.lit(60.0), F.lit(120.0), F.array().cast("array<double>")))
    assert len(silent) == 6 and silent[-1]["end_s"] == 120.0


def test_windows(spark):
    times = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: i.cast("double"))
    w = value(spark, M.sample_windows(times))
    assert len(w) == 14 and (w[0]["start_s"], w[0]["end_s"]) == (0, 8) and w[-1]["end_s"] == 60
    assert all(len(x["frames"]) == 8 for x in w)
    short = value(spark, M.sample_windows(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))))
    assert len(short) == 1 and len(short[0]["frames"]) == 8
    assert value(spark, M.sample_windows(F.array().cast("array<double>"))) is None


def test_hashes(spark):
    z, o, f = "0" * 16, "0" * 15 + "1", "f" * 16
    assert value(spark, hamming(F.lit(z), F.lit(f))) == 64 and value(spark, hamming(F.lit(z), F.lit(o))) == 1
    frames = spark.createDataFrame([([("a", z), ("b", o), ("c", f)],)], "fs array<struct<n:string,phash:string>>")
    assert [x["n"] for x in frames.select(M.pick_distinct(F.col("fs")).alias("x")).first()["x"]] == ["a", "c"]


def test_context_reaches_into_neighbours(spark):
    rows = [("v", 0, i, t) for i, t in enumerate(("alpha beta", "gamma delta", "epsilon zeta"))]
    d = sg.context_text(spark.createDataFrame(rows, "video_id string, chunk_index int, index int, text string"))
    assert d.filter("index = 1").first()["context_text"] == "alpha beta gamma delta epsilon zeta"


def heading_rows(spark, names):
    return spark.createDataFrame([("v", i, n) for i, n in enumerate(names)], "video_id string, pos bigint, heading string")


def test_heading_cuts(spark):
    d = tl.heading_cuts(heading_rows(spark, ["A", "A", None, "B", "B", "C", "B", "B"]))
    assert sorted(r["cut"] for r in d.collect()) == [3, 6]


def test_topics_respect_forced_and_drift_cuts(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("v", i, i * 10.0, i * 10.0 + 10, a if i < 6 else b, "x" if i < 3 else "y") for i in range(12)]
    d = spark.createDataFrame(rows, "video_id string, pos bigint, start_s double, end_s double, embedding array<double>, heading string")
    cuts = tl.segment_topics(d, 20.0).first()["cuts"]
    assert 3 in cuts and 6 in cuts and cuts[0] == 0


def test_blocks_do_not_change_results(spark):
    """The blocked computations equal one window over the whole group."""
    from pyspark.sql import Window

    from spanfinder.operators.ordered import neighbours, positions, running

    rows = [("g", i, (i * 37) % 101, None if i % 5 else f"h{i}") for i in range(200)]
    d = spark.createDataFrame(rows, "g string, i bigint, v bigint, h string")
    blk = F.floor(F.col("i") / 7)
    w = Window.partitionBy("g").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = running(running(running(d, ["g"], ["i"], blk, "v", "sum", "s"), ["g"], ["i"], blk, "v", "max", "m"), ["g"], ["i"], blk, "h", "last", "f")
    want = d.withColumn("s", F.sum("v").over(upto)).withColumn("m", F.max("v").over(upto)).withColumn("f", F.last("h", True).over(upto))
    cols = ["i", "s", "m", "f"]
    assert sorted(out.select(*cols).collect()) == sorted(want.select(*cols).collect())
    near = neighbours(positions(d, ["g"], ["i"], blk), ["g"], "pos", {"p": ("v", -2), "n": ("v", 3)}, rows=10)
    want = d.withColumn("p", F.lag("v", 2).over(w)).withColumn("n", F.lead("v", 3).over(w))
    key = lambda r: r["i"]
    assert sorted(near.select("i", "p", "n").collect(), key=key) == sorted(want.select("i", "p", "n").collect(), key=key)


@pytest.mark.parametrize("n", [7, 30])
def test_even_sample(spark, n):
    from spanfinder.operators.ordered import even_sample

    d = spark.createDataFrame([("v", i) for i in range(n)], "v string, i bigint")
    got = sorted(r["i"] for r in even_sample(d, ["v"], ["i"], F.floor(F.col("i") / 4), 8).collect())
    assert got == (list(range(n)) if n <= 8 else [int(i * n / 8) for i in range(8)])
