"""Streams over the event log, run to the end of what is there and read back as tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import segments as sg
from ..session import cut_lineage, shared_dir
from ..streaming import jobs as st
from . import bindings as B
from .indexing_queries import _SEGS as SEGMENTS
from .indexing_queries import _TRIM as TRIMMED
from .indexing_queries import _UTT as UTTERANCES
from .indexing_queries import chunks, utterances
from .registry import query
from .search_queries import rounded


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a stream of one file."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def collected(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str] = (), place: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over what has arrived and return the table it wrote; a job goes on where it was if `place` names its folders.

    A batch replaces its own folder, so a replay changes nothing. With `keys` the stream is in update mode: a batch holds the rows it
    changed, and the last one of each key counts, so windows that are still open are in the table.
    """
    out, state = place or (_place(spark, name), _place(spark, f"{name}-state"))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    st.run_available(df, state, write, "update" if keys else "append").awaitTermination()
    rows = spark.read.schema(df.schema).option("basePath", out).parquet(out)
    if keys:
        rest = F.struct(*[c for c in df.columns if c not in keys])
        rows = rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("_row")).select(*keys, "_row.*").select(*df.columns)
    return rows.drop("batch")


WINDOW = ("window_start", "window_end", "event_type")
_W = "epoch_us(ts) // 300000000 * 300"


@query(f"""SELECT event_type, CAST({_W} AS BIGINT) AS window_start, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM events GROUP BY ALL""")
def stream_rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute windows, those still open at the end of the log among them."""
    d = collected(spark, st.stream_rates(events_stream(spark, sf), ["event_type"]), "rates", WINDOW)
    return rounded(d.select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n", "per_second"), "per_second")


@query("""WITH w AS (SELECT event_type, value, epoch_us(ts) // 60000000 * 60 - k * 60 AS window_start FROM events, range(5) r(k)) SELECT event_type, CAST(window_start AS BIGINT) AS window_start, count(*) AS n FROM w GROUP BY ALL""")
def stream_rate_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute windows every minute."""
    d = collected(spark, st.stream_rates(events_stream(spark, sf), ["event_type"], "5 minutes", "1 minute"), "sliding", WINDOW)
    return d.select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n")


_BOUNDS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0)
_COUNTS = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BOUNDS))


def _interpolated(q: float) -> str:
    cases = []
    for i, b in enumerate(_BOUNDS):
        lower, below = (_BOUNDS[i - 1], f"b{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN b{i} >= {q}::DOUBLE * n THEN {lower} + ({b} - {lower}) * ({q}::DOUBLE * n - {below}) / (b{i} - {below})")
    return f"round(CASE {' '.join(cases)} ELSE {_BOUNDS[-1]} END, 6)"


@query(f"""WITH h AS (SELECT event_type, epoch_us(ts) // 86400000000 * 86400 AS window_start, {_COUNTS}, count(*) AS n FROM events GROUP BY ALL)
  SELECT event_type, CAST(window_start AS BIGINT) AS window_start, {_interpolated(0.5)} AS p50, {_interpolated(0.95)} AS p95, n FROM h""")
def stream_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Daily latency quantiles from mergeable buckets."""
    d = st.stream_quantiles(events_stream(spark, sf), ["event_type"], "value", _BOUNDS, {"p50": 0.5, "p95": 0.95}, "1 day", None)
    d = collected(spark, d, "quantiles", WINDOW)
    return rounded(d.select("event_type", F.unix_timestamp("window_start").alias("window_start"), "p50", "p95", "n"), "p50", "p95")


@query("SELECT min(event_id) AS event_id, user_id || ':' || event_type AS key FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Idempotent ingest: the log arrives in several micro-batches, and once more; each key is stored with its first event."""
    src, sink, state = _place(spark, "log"), _place(spark, "ingested"), _place(spark, "ingest-state")
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    for part in range(3):
        mine = e.filter(F.floor((F.col("event_id") - F.lit(low)) * 3 / F.lit((high or 0) - (low or 0) + 1)) == part)
        mine.coalesce(1).write.mode("append").parquet(src)
    log = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for place in (state, _place(spark, "again")):
        st.stream_ingest(log, sink, place, "key", order=["event_id"]).awaitTermination()
    return spark.read.parquet(sink).select("event_id", "key")


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS video_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed,
    count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS given_up FROM events GROUP BY ALL)
  SELECT video_id, CASE WHEN failed > 0 THEN 'failed' ELSE 'ready' END AS status, failed, total FROM c
  UNION ALL SELECT video_id, 'ready', 0, total FROM c WHERE failed > 0 AND given_up = 0""")
def stream_finalize(spark: SparkSession, sf: str) -> DataFrame:
    """Each user is a video, each event a chunk that reports that it is pending and then how it ended.

    The log comes in three steps: two halves, then reports of the first half again with later times, and the second tries of
    every other failed chunk. At last all of it is replayed by a job that has forgotten everything.
    """
    src, sink = _place(spark, "chunks"), _place(spark, "told")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    total = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    ended = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    own = events.join(total, "user_id").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("chunk_index"), ended.alias("ended"), "chunk_count", "ts")
    reports = own.withColumn("status", F.explode(F.array(F.lit("pending"), "ended"))).drop("ended")
    later = own.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 HOURS"))
    again = later.where("ended = 'failed' AND chunk_index % 2 = 0").withColumn("status", F.lit("done")).drop("ended")
    repeats = later.where("ended = 'done' AND chunk_index % 5 < 2").withColumnRenamed("ended", "status")
    steps = [reports.where("chunk_index % 5 < 3"), reports.where("chunk_index % 5 >= 3"), again.unionByName(repeats)]
    schema = st.REPORT
    for state in (_place(spark, "chunks-state"), _place(spark, "chunks-replay")):
        for step in steps:
            if step is not None:
                step.select(*[f.split()[0] for f in schema.split(", ")]).write.mode("append").parquet(src)
            st.stream_finalize(spark.readStream.schema(schema).parquet(src), sink, state).awaitTermination()
        steps = [None]  # the replay reads what is there
    return spark.read.schema(st.FINAL).parquet(sink).select("video_id", "status", "failed", "total")


@query(f"""WITH s AS (SELECT *, epoch_us(ts) AS us, {_W} AS window_start, CASE WHEN event_id % 7 = 3 THEN 2 WHEN ts < (SELECT median(ts) FROM events) THEN 0 ELSE 1 END AS step FROM events),
  m AS (SELECT step, max(us) // 1000 * 1000 AS us FROM s GROUP BY step),
  w AS (SELECT s.*, coalesce((window_start + 300) * 1000000 <= (SELECT max(m.us) FROM m WHERE m.step < s.step) - 600000000, false) AS late FROM s)
  SELECT event_type, CAST(window_start AS BIGINT) AS window_start, count(*) AS n_raw, count(*) FILTER (NOT late) AS n_counted, count(*) FILTER (late) AS n_late FROM w GROUP BY ALL""")
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """A log that comes in three steps, the last one of stragglers from all over it: rows in the raw table, rows that the
    windows counted, and rows that came after their window was closed."""
    src, raw, late, state = (_place(spark, n) for n in ("late-src", "late-raw", "late-rows", "late-state"))
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.agg(F.expr("timestamp_micros(CAST(floor(percentile(unix_micros(ts), 0.5)) AS BIGINT))").alias("m")).first()["m"]
    straggler, early = F.col("event_id") % 7 == 3, F.col("ts") < F.lit(middle)
    out = None
    for step in (~straggler & early, ~straggler & ~early, straggler):
        events.where(step).write.mode("append").parquet(src)
        log = spark.readStream.schema(events.schema).parquet(src)
        st.stream_raw(log, raw, late, f"{state}-raw").awaitTermination()
        out = collected(spark, st.stream_rates(log, ["event_type"]), "late-windows", WINDOW, place=(f"{state}-out", f"{state}-windows"))
    start = F.unix_timestamp(F.window("ts", "5 minutes")["start"]).alias("window_start")
    n = lambda path, name: spark.read.schema(events.schema).parquet(path).groupBy("event_type", start).agg(F.count(F.lit(1)).alias(name))
    counted = out.select("event_type", F.unix_timestamp("window_start").alias("window_start"), F.col("n").alias("n_counted"))
    keys = ["event_type", "window_start"]
    joined = n(raw, "n_raw").join(counted, keys, "left").join(n(f"{late}/rows", "n_late"), keys, "left")
    return joined.select(*keys, "n_raw", F.coalesce("n_counted", F.lit(0)).alias("n_counted"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), e AS (SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id, max(epoch_us(ts)) AS us FROM events GROUP BY user_id)
  SELECT user_id AS id, CASE WHEN event_id % 4 >= 3 THEN 'dead' ELSE 'queued' END AS outcome, us AS last_beat_us FROM e
  WHERE event_type IN ('view', 'click', 'signup') AND us // 1000 + 3600000 < (SELECT max(epoch_us(ts)) FROM events) // 1000 - 60000""")
def stream_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Workers silent for an hour at the end of the log; their last report decides between queued and dead."""
    e = events_stream(spark, sf)
    status = F.when(F.col("event_type").isin("view", "click", "signup"), "running").otherwise("succeeded")
    beats = e.select(F.col("user_id").alias("id"), status.alias("status"), (F.col("event_id") % 4).alias("attempts"), F.lit(3).cast("bigint").alias("max_attempts"), "ts")
    return collected(spark, st.stream_stale(beats, 3600), "stale")


_SESS = """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, sid"""


@query(f"SELECT * FROM ({_SESS}) WHERE end_us <= (SELECT max(epoch_us(ts)) FROM events) - 600000000")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Worker sessions with a two-hour gap; sessions still open at the watermark are not emitted."""
    d = collected(spark, st.stream_sessions(events_stream(spark, sf), "user_id", "2 hours"), "sessions")
    return d.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""SELECT a.user_id AS video_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 6) AS seconds FROM events a JOIN events b ON a.user_id = b.user_id
  AND a.event_type = 'signup' AND b.event_type = 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""")
def stream_stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Upload to first searchable, here signup to view, within two hours."""
    a = events_stream(spark, sf).filter("event_type = 'signup'").select(F.col("user_id").alias("video_id"), "ts")
    b = events_stream(spark, sf).filter("event_type = 'view'").select(F.col("user_id").alias("video_id"), "ts")
    return rounded(collected(spark, st.stage_latency(a, b, within="2 hours"), "stage").select("video_id", "seconds"), "seconds")


@query(f"""WITH RECURSIVE {UTTERANCES}, {TRIMMED}, {SEGMENTS} SELECT conv_id AS video_id, chunk_index, chunk_index * 10000 + idx AS index, s AS start_s, e AS end_s, array_to_string(l, ' ') AS text,
  trim(array_to_string(list_concat(list_concat(coalesce(lag(l) OVER p, [])[-15:], l), coalesce(lead(l) OVER p, [])[:15]), ' ')) AS context_text
  FROM full_seg WINDOW p AS (PARTITION BY conv_id, chunk_index ORDER BY idx)""")
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """Segments indexed from a transcript that comes in two steps, so that most chunks are spread over both."""
    src, sink, state = _place(spark, "utt"), _place(spark, "segs"), _place(spark, "segs-state")
    c = cut_lineage(chunks(spark, sf))
    placed = cut_lineage(sg.trim_utterances(utterances(spark, sf), c))
    for step in (0, 1):
        placed.where(F.pmod(F.floor(F.col("start_s")), F.lit(2)) == step).write.mode("append").parquet(src)
        stream = spark.readStream.schema(placed.schema).parquet(src)
        st.stream_index(stream, c, sink, state).awaitTermination()
    number = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "index")]
    return spark.read.parquet(f"{sink}/segments").select("video_id", *number, "start_s", "end_s", "text", "context_text")
