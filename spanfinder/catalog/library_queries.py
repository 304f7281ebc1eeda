"""Joins, library questions, sinks and operational analytics on the shared tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import tables as table_functions
from ..functions.text import uppered
from ..operators.intervals import asof_join, overlap_join as overlapping, point_in_interval
from ..operators.quantiles import histogram as bucket_counts
from ..operators.quantiles import histogram_quantile as bucket_quantile
from ..operators.quantiles import nearest_rank
from ..operators.ordered import positions
from ..operators.topk import topk
from ..plans import library as lib
from ..plans import operations as ops
from ..plans.segments import pending_backfill
from ..sources import readers, sinks, versions
from ..session import shared_dir
from . import bindings as B
from .registry import query
from .search_queries import rounded

NOW = datetime(2024, 1, 31)

# --- jobs: one per event ---------------------------------------------------------------------


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = F.col("event_type")
    status = F.when(t == "error", "dead").when(t == "signup", "running").when(t == "purchase", "queued").otherwise("succeeded")
    kind = F.when(t == "view", "extract_chunk").when(t == "signup", "encode_temporal").when(t == "purchase", "build_timeline").otherwise("index_chunk")
    ended = F.when(t.isin("click", "view", "error"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1e6).cast("bigint")))
    return e.select(
        F.col("event_id").alias("id"),
        kind.alias("type"),
        F.element_at(F.array(F.lit("cpu"), F.lit("ml"), F.lit("vision")), (F.col("user_id") % 3 + 1).cast("int")).alias("queue"),
        status.alias("status"),
        (F.col("event_id") % 4).alias("attempts"),
        F.lit(3).cast("bigint").alias("max_attempts"),
        F.concat(F.lit("w"), (F.col("user_id") % 20).cast("string")).alias("locked_by"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("started_at"),
        F.when(t == "signup", F.col("ts")).alias("heartbeat_at"),
        ended.alias("finished_at"),
        F.when(t == "error", F.concat(F.lit("error "), F.col("props"))).alias("last_error"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("video_id"),
        F.col("value"),
    )


JOBS = """jobs AS (SELECT event_id AS id,
  CASE event_type WHEN 'view' THEN 'extract_chunk' WHEN 'signup' THEN 'encode_temporal' WHEN 'purchase' THEN 'build_timeline' ELSE 'index_chunk' END AS type,
  ['cpu', 'ml', 'vision'][user_id % 3 + 1] AS queue,
  CASE event_type WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'queued' ELSE 'succeeded' END AS status,
  event_id % 4 AS attempts, 3 AS max_attempts, 'w' || (user_id % 20) AS locked_by, epoch_us(ts) AS started,
  CASE WHEN event_type = 'signup' THEN epoch_us(ts) END AS heartbeat,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT) END AS finished,
  CASE WHEN event_type = 'error' THEN 'error ' || props END AS last_error, 'src' || (user_id % 20) AS video_id, value FROM events)"""
NOW_US = "epoch_us(TIMESTAMP '2024-01-31 00:00:00')"


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Document = chunk; its labels give the status, the event of the same id the finishing time."""
    lab = B.table(spark, sf, "labels").select(F.col("doc_id").alias("segment_id"), "quality", "toxic")
    ev = B.table(spark, sf, "events").select(F.col("event_id").alias("segment_id"), F.col("ts").cast("timestamp").alias("done_at"))
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").otherwise("pending")
    return B.spans_only(spark, sf).join(lab, "segment_id", "left").join(ev, "segment_id", "left").select("video_id", F.col("segment_id").alias("chunk_index"), "start_s", "end_s", status.alias("status"), "done_at", F.lit(None).cast("string").alias("error"))


CHUNKS = f"""{B.SPANS}, chunks AS (SELECT s.video_id, s.segment_id AS chunk_index, s.start_s, s.end_s, epoch_us(e.ts) AS done_at,
  CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'done' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status
  FROM spans s LEFT JOIN labels l ON l.doc_id = s.segment_id LEFT JOIN events e ON e.event_id = s.segment_id)"""

# --- joins -----------------------------------------------------------------------------------


@query(f"WITH {JOBS}, j AS (SELECT id, video_id, (started // 1000) % 1500000 / 1000.0::DOUBLE AS t FROM jobs), {B.SPANS} SELECT id, segment_id FROM j JOIN spans USING (video_id) WHERE t >= start_s AND t < end_s")
def assign_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points in media time to the segment that holds them."""
    t = (F.floor(F.unix_micros("started_at") / 1000) % 1_500_000) / 1000.0
    pts = jobs(spark, sf).select("id", "video_id", t.alias("t"))
    return point_in_interval(pts, B.spans_only(spark, sf), ["video_id"], "t").select("id", "segment_id")


@query(f"""WITH {B.SPANS}, probe AS (SELECT segment_id AS probe_id, video_id, start_s + 30 AS a, start_s + 90 AS b FROM spans WHERE segment_id % 2 = 0)
  SELECT probe_id, segment_id FROM probe p JOIN spans s USING (video_id) WHERE p.a < s.end_s + 3 AND p.b > s.start_s - 3""")
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    s = B.spans_only(spark, sf)
    probe = s.filter("segment_id % 2 = 0").select(F.col("segment_id").alias("probe_id"), "video_id", (F.col("start_s") + 30).alias("start_s"), (F.col("start_s") + 90).alias("end_s"))
    return overlapping(probe, s, ["video_id"], pad_s=3.0).select("probe_id", "segment_id")


@query(f"""WITH {JOBS}, p AS (SELECT id, video_id, started AS t FROM jobs WHERE status = 'running'), r AS (SELECT max(id) AS run_id, video_id, started AS rt FROM jobs WHERE status = 'succeeded' GROUP BY video_id, started)
  SELECT p.id, r.run_id FROM p ASOF LEFT JOIN r ON p.video_id = r.video_id AND p.t >= r.rt""")
def asof_utterance(spark: SparkSession, sf: str) -> DataFrame:
    """Last row at or before a time, per video."""
    j = jobs(spark, sf).withColumn("t", F.unix_micros("started_at") / 1e6)
    pts = j.filter("status = 'running'").select("video_id", "id", "t")
    rows = j.filter("status = 'succeeded'").select("video_id", F.col("t").alias("rt"), F.col("id").alias("run_id"))
    return asof_join(pts, rows, ["video_id"], "t", "rt", ["run_id"]).select("id", "run_id")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT 'src' || (item_id % 7) FROM benchmark)")
def scope_semi(spark: SparkSession, sf: str) -> DataFrame:
    ids = B.table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("source"))
    return lib.restrict_ids(B.table(spark, sf, "documents").select("doc_id", "source"), "source", ids).select("doc_id")


@query(f"WITH {CHUNKS} SELECT video_id, chunk_index FROM chunks WHERE status = 'done' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = chunk_index AND e.label < 5)")
def backfill_anti(spark: SparkSession, sf: str) -> DataFrame:
    emb = B.table(spark, sf, "embeddings").filter("label < 5").join(B.spans_only(spark, sf).select(F.col("segment_id").alias("vec_id"), "video_id"), "vec_id")
    have = emb.select("video_id", F.col("vec_id").alias("chunk_index"), F.lit("temporal").alias("kind"), F.lit("v2").alias("model_key"))
    return pending_backfill(chunk_rows(spark, sf), have, "temporal", "v2")


_LIBVID = "libvid AS (SELECT doc_id AS video_id, CASE doc_id % 3 WHEN 0 THEN 'bench' WHEN 1 THEN 'upload' ELSE 'other' END AS source, 'title ' || (doc_id // 2) AS title, CASE WHEN n_chars % 2 = 0 THEN 'ready' ELSE 'processing' END AS status FROM documents)"


def library_videos(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents")
    src = F.when(F.col("doc_id") % 3 == 0, "bench").when(F.col("doc_id") % 3 == 1, "upload").otherwise("other")
    return d.select(F.col("doc_id").alias("video_id"), src.alias("source"), F.concat(F.lit("title "), F.floor(F.col("doc_id") / 2).cast("string")).alias("title"), F.when(F.col("n_chars") % 2 == 0, "ready").otherwise("processing").alias("status"))


@query(f"""WITH {_LIBVID}, dv AS (SELECT vec_id, 'title ' || vec_id AS external_id, 'title ' || (vec_id + 1) AS meta_title FROM embeddings),
  a AS (SELECT title, min(video_id) AS v, arg_min(status, video_id) AS s FROM libvid WHERE source = 'bench' GROUP BY title), b AS (SELECT title, min(video_id) AS v, arg_min(status, video_id) AS s FROM libvid WHERE source = 'upload' GROUP BY title)
  SELECT vec_id, coalesce(a.v, b.v) AS video_id, CASE WHEN coalesce(a.v, b.v) IS NULL THEN 'pending' WHEN CASE WHEN a.v IS NOT NULL THEN a.s ELSE b.s END = 'ready' THEN 'indexed' ELSE 'fetched' END AS status
  FROM dv LEFT JOIN a ON a.title = external_id LEFT JOIN b ON b.title = meta_title""")
def library_link(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("title "), c.cast("string"))
    dv = B.table(spark, sf, "embeddings").select("vec_id", name(F.col("vec_id")).alias("external_id"), name(F.col("vec_id") + 1).alias("meta_title"), F.lit("pending").alias("status"), F.lit(None).cast("bigint").alias("video_id"))
    return lib.link_library(dv, library_videos(spark, sf), "bench").select("vec_id", "video_id", "status")


@query("""WITH want AS (SELECT item_id AS key, CASE WHEN item_id % 2 = 0 THEN text ELSE upper(text) END AS title FROM benchmark), l AS (SELECT item_id AS video_id, text AS title FROM benchmark),
  ex AS (SELECT key, min(video_id) AS video_id FROM want JOIN l USING (title) GROUP BY key)
  SELECT * FROM ex UNION ALL SELECT key, min(video_id) FROM want w JOIN l ON starts_with(lower(l.title), substring(lower(w.title), 1, 40)) WHERE key NOT IN (SELECT key FROM ex) GROUP BY key""")
def title_prefix(spark: SparkSession, sf: str) -> DataFrame:
    b = B.table(spark, sf, "benchmark")
    want = b.select(F.col("item_id").alias("key"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(uppered(F.col("text"))).alias("title"))
    return lib.resolve_titles(want, b.select(F.col("item_id").alias("video_id"), F.col("text").alias("title")))


# --- library ---------------------------------------------------------------------------------


@query(f"""WITH {CHUNKS}, c AS (SELECT video_id, count(*) AS chunk_count, count(*) FILTER (status = 'done') AS chunks_done, count(*) FILTER (status = 'failed') AS chunks_failed FROM chunks GROUP BY video_id),
  t AS (SELECT 'src' || (vec_id % 15) AS video_id, count(*) AS topic_count FROM embeddings GROUP BY ALL)
  SELECT c.video_id, chunks_done, chunks_failed, coalesce(topic_count, 0) AS topic_count, round(chunks_done / chunk_count::DOUBLE, 6) AS progress FROM c LEFT JOIN t USING (video_id)""")
def library_overview(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_rows(spark, sf)
    videos = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    topics = B.table(spark, sf, "embeddings").select(F.concat(F.lit("src"), (F.col("vec_id") % 15).cast("string")).alias("video_id"))
    return rounded(lib.library_overview(videos, c, topics).drop("chunk_count"), "progress")


@query(f"""WITH {CHUNKS}, small AS (SELECT video_id || '/' || (chunk_index // 40) AS video_id, status FROM chunks), c AS (SELECT video_id, count(*) AS n, count(*) FILTER (status = 'done') AS d, count(*) FILTER (status = 'failed') AS f FROM small GROUP BY ALL)
  SELECT video_id, CASE WHEN f > 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN f > 0 THEN f || ' of ' || n || ' chunks failed' END AS error FROM c WHERE d + f = n""")
def finalize_videos(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_rows(spark, sf)
    return lib.finalize(c.withColumn("video_id", F.concat_ws("/", "video_id", F.floor(F.col("chunk_index") / 40).cast("string"))))


@query(f"""WITH {CHUNKS}, {JOBS}, dead AS (SELECT video_id, id AS chunk_index, last_error FROM jobs WHERE status = 'dead' AND type IN ('extract_chunk', 'index_chunk'))
  SELECT c.video_id, c.chunk_index, CASE WHEN d.chunk_index IS NOT NULL AND c.status <> 'done' THEN 'failed' ELSE c.status END AS status,
   CASE WHEN d.chunk_index IS NOT NULL AND c.status <> 'done' THEN d.last_error END AS error FROM chunks c LEFT JOIN dead d ON d.video_id = c.video_id AND d.chunk_index = c.chunk_index""")
def propagate_dead(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs(spark, sf).withColumn("chunk_index", F.col("id"))
    return lib.propagate_dead(j, chunk_rows(spark, sf)).select("video_id", "chunk_index", "status", "error")


@query("""WITH dv AS (SELECT lang AS split, CASE WHEN toxic = 1 THEN 'unavailable' WHEN quality = 1 THEN 'indexed' WHEN quality = 0 THEN 'fetched' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)),
  q AS (SELECT ['en', 'de', 'fr'][item_id % 3 + 1] AS split, count(*) AS queries FROM benchmark GROUP BY ALL)
  SELECT split, status, count(*) AS n, coalesce(any_value(queries), 0) AS queries FROM dv LEFT JOIN q USING (split) GROUP BY split, status""")
def dataset_status(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "unavailable").when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "fetched").otherwise("pending")
    dv = B.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split")).join(B.table(spark, sf, "labels"), "doc_id", "left").withColumn("status", status)
    langs = F.array(F.lit("en"), F.lit("de"), F.lit("fr"))
    q = B.table(spark, sf, "benchmark").select(F.element_at(langs, (F.col("item_id") % 3 + 1).cast("int")).alias("split"))
    return lib.dataset_status(dv, q)


@query("SELECT doc_id, text FROM documents WHERE contains(lower(text), 'the')")
def grep_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return lib.grep_transcript(B.documents(spark, sf).select("doc_id", "text"), "The")


# --- operations ------------------------------------------------------------------------------


@query(f"WITH {JOBS} SELECT queue, status, count(*) AS n FROM jobs GROUP BY GROUPING SETS ((queue, status), (status))")
def job_counts_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ops.job_counts(jobs(spark, sf))


@query(f"""WITH {JOBS}, s AS (SELECT *, coalesce(finished, heartbeat, started) AS seen FROM jobs)
  SELECT locked_by, max(seen) AS last_seen, count(*) AS jobs, count(*) FILTER (status = 'running') AS running FROM s WHERE seen >= {NOW_US} - 86400000000 GROUP BY locked_by""")
def worker_activity(spark: SparkSession, sf: str) -> DataFrame:
    return ops.worker_activity(jobs(spark, sf), 1440, NOW).withColumn("last_seen", F.unix_micros("last_seen"))


def _rank_sql(value: str, p: float) -> str:
    return f"round(list_sort(list({value}))[CAST(least(count({value}) - 1, CAST(floor(count({value}) * {p}::DOUBLE) AS BIGINT)) AS BIGINT) + 1], 1)"


@query(f"WITH {JOBS} SELECT type, {_rank_sql('value', 0.5)} AS p50, {_rank_sql('value', 0.95)} AS p95, count(*) AS n FROM jobs GROUP BY type")
def latency_pct(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles per job type."""
    return nearest_rank(jobs(spark, sf), ["type"], "value", {"p50": 0.5, "p95": 0.95})


_SAMPLES = "smp AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'infer.text' WHEN 'view' THEN 'infer.ocr' WHEN 'signup' THEN 'job.index_chunk' WHEN 'purchase' THEN 'search.total' ELSE 'other.x' END AS name, value, ts FROM events)"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    name = F.when(t == "click", "infer.text").when(t == "view", "infer.ocr").when(t == "signup", "job.index_chunk").when(t == "purchase", "search.total").otherwise("other.x")
    return B.table(spark, sf, "events").select(F.col("event_id").alias("id"), name.alias("name"), "value", F.lit("api").alias("source"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"""WITH {_SAMPLES}, r AS (SELECT * FROM smp WHERE epoch_us(ts) >= {NOW_US} - 86400000000)
  SELECT string_split(name, '.')[1] AS kind, regexp_replace(name, '^[^.]*\\.', '') AS name, {_rank_sql('value', 0.5)} AS p50, {_rank_sql('value', 0.95)} AS p95, count(*) AS n FROM r WHERE name <> 'other.x' GROUP BY r.name""")
def sample_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sample_summary(samples(spark, sf), 1440, NOW)


@query(f"""WITH {CHUNKS}, {JOBS}, d AS (SELECT coalesce(sum(end_s - start_s), 0) AS s, min(done_at) AS a, max(done_at) AS b, count(*) AS n FROM chunks WHERE status = 'done' AND done_at >= {NOW_US} - 86400000000),
  y AS (SELECT coalesce(sum((finished - started) / 1e6), 0) AS busy FROM jobs WHERE status = 'succeeded' AND finished >= {NOW_US} - 86400000000 AND type IN ('extract_chunk', 'index_chunk'))
  SELECT round(s, 1) AS indexed_video_seconds, n AS chunks, round(busy, 1) AS worker_busy_seconds, CASE WHEN busy > 0 THEN round(s / busy, 2) END AS realtime_factor,
   CASE WHEN n > 1 AND b > a THEN round((b - a) / 1e6, 1) END AS wall_seconds, CASE WHEN busy > 0 AND s > 0 THEN round(3600 / (s / busy), 0) END AS seconds_to_index_one_hour FROM d, y""")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    return ops.throughput(chunk_rows(spark, sf), jobs(spark, sf), 1440, NOW)


_VIDTIMES = """vt AS (SELECT user_id, min(epoch_us(ts)) AS up, max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) AS firsts, max(epoch_us(ts)) AS done, sum(value) AS dur FROM events GROUP BY user_id),
  m AS (SELECT 'first_searchable' AS measure, (firsts - up) / 1e6 AS v FROM vt WHERE firsts IS NOT NULL UNION ALL SELECT 'index_wall', (done - up) / 1e6 FROM vt UNION ALL SELECT 'per_hour', (done - up) / 1e6 / dur * 3600 FROM vt)"""


@query(f"WITH {_VIDTIMES} SELECT measure, {_rank_sql('v', 0.5)} AS p50, {_rank_sql('v', 0.95)} AS p95, count(*) AS n FROM m GROUP BY measure")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    v = e.groupBy(F.col("user_id").alias("video_id")).agg(F.min("ts").alias("upload_completed_at"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("first_searchable_at"), F.max("ts").alias("completed_at"), F.sum("value").alias("duration_s"), F.lit("ready").alias("status"))
    return ops.latency_summary(v)


@query(f"WITH {JOBS} SELECT CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries FROM jobs")
def retries_total(spark: SparkSession, sf: str) -> DataFrame:
    return ops.retries_total(jobs(spark, sf))


@query(f"WITH {JOBS} SELECT id, last_error FROM jobs WHERE last_error IS NOT NULL ORDER BY coalesce(finished, started) DESC, id LIMIT 10")
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recent_failures(jobs(spark, sf)).select("id", "last_error")


@query(f"WITH {JOBS} SELECT id FROM jobs WHERE status = 'dead' ORDER BY started DESC, id DESC LIMIT 50")
def job_log(spark: SparkSession, sf: str) -> DataFrame:
    return ops.job_log(jobs(spark, sf), "dead", 50).select("id")


@query(f"""WITH {JOBS}, s AS (SELECT *, status = 'running' AND heartbeat < {NOW_US} - 864000000000 AS silent FROM jobs)
  SELECT id, CASE WHEN silent THEN CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'queued' END ELSE status END AS status,
   CASE WHEN silent THEN 'lease expired: worker ' || locked_by || ' went silent' ELSE last_error END AS last_error, CASE WHEN coalesce(silent, false) THEN NULL ELSE locked_by END AS locked_by FROM s""")
def reap_stale(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reap_stale(jobs(spark, sf), NOW, 864_000).select("id", "status", "last_error", "locked_by")


_B = V.JOB_BOUNDS
_HIST = " UNION ALL ".join([f"SELECT type, {float(b)}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS cumulative FROM jobs GROUP BY type" for b in _B] + ["SELECT type, NULL::DOUBLE, count(*) FROM jobs GROUP BY type"])


@query(f"WITH {JOBS} {_HIST}")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return bucket_counts(jobs(spark, sf), ["type"], "value", _B)


@query(f"""WITH {JOBS}, h AS ({_HIST}), o AS (SELECT *, lag(cumulative, 1, 0) OVER p AS below, coalesce(lag(le) OVER p, 0) AS lower, max(cumulative) OVER (PARTITION BY type) * 0.95::DOUBLE AS rank
    FROM h WINDOW p AS (PARTITION BY type ORDER BY le NULLS LAST)), f AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY le NULLS LAST) AS r FROM o WHERE cumulative >= rank)
  SELECT type, round(CASE WHEN le IS NULL THEN {float(_B[-1])} ELSE lower + (le - lower) * (rank - below) / (cumulative - below) END, 6) AS quantile FROM f WHERE r = 1""")
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bucket_quantile(bucket_counts(jobs(spark, sf), ["type"], "value", _B), ["type"], _B, 0.95), "quantile")


# --- sinks -----------------------------------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """First event per (user, type); the second import of the same rows adds nothing."""
    path = _fresh(spark, "inserted")
    e = B.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for _ in range(2):
        sinks.insert_if_absent(e, path, ["user_id", "event_type"], [F.col("event_id").asc()])
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event per user after two partial merges."""
    path = _fresh(spark, "merged")
    e = B.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    for part in (1, 0):
        sinks.upsert(e.filter(F.col("event_id") % 2 == part), path, ["user_id"], "at")
    return versions.read(spark, path).select("user_id", "event_type", "event_id")


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN event_id + 1 ELSE event_id END) AS BIGINT) AS ids FROM events GROUP BY event_type")
def replace_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """One partition is written again with changed rows; the others stay."""
    path = _fresh(spark, "replaced")
    e = B.table(spark, sf, "events").select("event_id", "event_type")
    sinks.replace_partitions(e, path, ["event_type"])
    sinks.replace_partitions(e.filter("event_type = 'click'").withColumn("event_id", F.col("event_id") + 1), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'dead' AND video_id IN ('src1', 'src2') THEN 'queued' ELSE status END AS status, CASE WHEN status = 'dead' AND video_id IN ('src1', 'src2') THEN 0 ELSE attempts END AS attempts FROM jobs")
def reset_failed(spark: SparkSession, sf: str) -> DataFrame:
    v = B.table(spark, sf, "documents").select(F.col("source").alias("video_id")).distinct().filter(F.col("video_id").isin("src1", "src2"))
    return sinks.reset_jobs(jobs(spark, sf), v).select("id", "status", "attempts")


@query("""WITH t AS (SELECT 'documents' AS part, doc_id AS id, source AS video_id, 1 AS state FROM documents
  UNION ALL SELECT 'label=' || coalesce(CAST(label AS VARCHAR), 'none'), vec_id, 'src' || (vec_id % 20), CASE WHEN label IN (SELECT label FROM embeddings WHERE vec_id % 20 IN (1, 2) AND vec_id % 3 = 0) THEN 2 ELSE 1 END FROM embeddings WHERE vec_id % 3 = 0)
  SELECT part, id, CASE WHEN part = 'documents' THEN 2 ELSE state END AS written_by FROM t WHERE video_id NOT IN ('src1', 'src2')""")
def purge_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Two videos are purged from two tables of a library, one partitioned: the rows that are left, and which commit wrote each."""
    root = _fresh(spark, "library")
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("video_id"))
    vectors = B.table(spark, sf, "embeddings").where("vec_id % 3 = 0")
    vectors = vectors.select(F.col("vec_id").alias("id"), F.concat(F.lit("src"), F.col("vec_id") % 20).alias("video_id"), F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"))
    versions.commit(docs, f"{root}/segments")
    versions.commit(vectors, f"{root}/embeddings", ["label"])
    sinks.purge(spark, root, docs.select("video_id").distinct().where(F.col("video_id").isin("src1", "src2")))
    number = F.regexp_extract("_metadata.file_path", "/v0*([0-9]+)-[^/]*/", 1).cast("int").alias("written_by")
    out = None
    for name, part in (("segments", F.lit("documents")), ("embeddings", F.concat(F.lit("label="), F.regexp_extract("_metadata.file_path", "label=([^/]+)/", 1)))):
        at = versions.state(spark, f"{root}/{name}")
        for folder, version in at.parts.items():
            rows = spark.read.parquet(f"{root}/{name}/{version}/{folder}").select(part.alias("part"), "id", number)
            out = rows if out is None else out.unionByName(rows)
    return out


# --- sources: files derived from the tables, written and read back -----------------------------


@query("""SELECT item_id, 'clip_' || (item_id % 7) AS source_id, item_id % 7 * 10.0::DOUBLE AS clip_start_s, item_id % 7 * 10.0::DOUBLE + 150 AS clip_end_s, 150.0::DOUBLE AS duration_s, text,
    round(item_id % 5 * 2.0::DOUBLE, 1) AS start_s, round(item_id % 5 * 2.0::DOUBLE + 4, 1) AS end_s FROM benchmark WHERE item_id % 7 <> 3""")
def import_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as a JSONL annotation file: imported by the adapter twice, all clips but one from an id list."""
    root, lib = _fresh(spark, "annotations"), _fresh(spark, "imported")
    n = F.col("item_id") % 7
    vid = F.concat(F.lit("clip_"), n, F.lit("_"), (n * 10.0).cast("string"), F.lit("_"), (n * 10.0 + 150).cast("string"))
    at = F.col("item_id") % 5 * 2.0
    windows = F.array(F.array(at, at + 4))
    sinks.export_jsonl(B.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), vid.alias("vid"), windows.alias("relevant_windows")), f"{root}/val.jsonl")
    ids = B.table(spark, sf, "benchmark").where(n != 3).select(vid.alias("value")).distinct()
    ids.unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(f"{root}/ids")
    for _ in range(2):
        readers.import_split(spark, "jsonl", root, "val", lib, ids=readers.read_ids(spark, f"{root}/ids"))
    videos, queries = spark.read.parquet(f"{lib}/dataset_videos"), spark.read.parquet(f"{lib}/dataset_queries")
    d = queries.select(F.col("external_id").cast("long").alias("item_id"), "text", F.inline("relevant"), F.col("video_external_id").alias("vid"))
    return d.join(videos.withColumnRenamed("external_id", "vid"), "vid").select("item_id", "source_id", "clip_start_s", "clip_end_s", "duration_s", "text", "start_s", "end_s")


@query("SELECT item_id, 'video ' || (item_id // 10) AS title, text, item_id % 10 * 1.0::DOUBLE AS start_s, item_id % 10 + 2.0::DOUBLE AS end_s FROM benchmark")
def dataset_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested dataset documents of ten items each, a file each, read as clips and queries; windows of other clips do not count."""
    path = _fresh(spark, "documents")
    items = B.table(spark, sf, "benchmark").withColumn("d", F.floor(F.col("item_id") / 10))
    key, at = F.concat(F.lit("v"), F.col("d")), (F.col("item_id") % 10).cast("double")
    span = lambda k, a: F.struct(k.alias("video"), a.alias("start_s"), (a + 2).alias("end_s"))
    asked = F.struct(F.col("item_id").cast("string").alias("id"), "text", F.lit("speech").alias("modality"), F.array(span(key, at), span(F.lit("other"), at)).alias("relevant"))
    docs = items.groupBy("d").agg(F.array(F.struct(F.first(key).alias("key"), F.concat(F.lit("video "), F.first("d")).alias("title"))).alias("videos"), F.collect_list(asked).alias("queries"))
    docs.write.partitionBy("d").json(path)
    videos, queries = readers.read_dataset_doc(spark, f"{path}/d=*")
    d = queries.join(videos.withColumnRenamed("external_id", "video_external_id"), "video_external_id")
    return d.select(F.col("external_id").cast("long").alias("item_id"), "title", "text", F.inline("relevant"))


@query("SELECT source AS video_id, CAST(doc_id % 8 AS INTEGER) AS chunk_index, doc_id * 40 / 1000.0::DOUBLE AS t_s, 'k' || doc_id AS key, substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS phash FROM documents")
def manifest_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame manifests, a JSON file a chunk, read back as frames: sources are videos, eight chunks each."""
    path = _fresh(spark, "manifests")
    d = B.table(spark, sf, "documents").select(F.col("source").alias("video_id"), (F.col("doc_id") % 8).alias("chunk_index"), "doc_id")
    frame = F.struct((F.col("doc_id") * 40).alias("t_ms"), F.concat(F.lit("k"), "doc_id").alias("key"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16).alias("phash"))
    d.groupBy("video_id", "chunk_index").agg(F.to_json(F.collect_list(frame)).alias("value")).write.partitionBy("video_id", "chunk_index").text(path)
    return readers.read_manifests(spark, path)


@query("""WITH d AS (SELECT source AS video_id, CAST(doc_id % 8 AS INTEGER) AS chunk_index, doc_id, text FROM documents)
  SELECT video_id, chunk_index, doc_id * 1.0::DOUBLE AS start_s, text, false AS pending FROM d WHERE chunk_index % 3 <> 0
  UNION ALL SELECT DISTINCT video_id, chunk_index, NULL, NULL, true FROM d WHERE chunk_index % 3 = 0""")
def transcript_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts, a JSON file a chunk, of two speech models: utterances of the wanted model, and the chunks still to do."""
    path = _fresh(spark, "transcripts")
    d = B.table(spark, sf, "documents").select(F.col("source").alias("video_id"), (F.col("doc_id") % 8).cast("int").alias("chunk_index"), "doc_id", "text")
    at = F.col("doc_id").cast("double")
    said = F.struct(at.alias("start"), (at + 0.5).alias("end"), "text", F.array(F.struct(F.lit("w").alias("w"), at.alias("s"), at.alias("e"))).alias("words"))
    model = F.when(F.col("chunk_index") % 3 == 0, "large").otherwise("small").alias("model")
    d.groupBy("video_id", "chunk_index", model).agg(F.collect_list(said).alias("utterances")).write.partitionBy("video_id", "chunk_index").json(path)
    heard = readers.read_transcripts(spark, path, "small")
    todo = readers.untranscribed(d.select("video_id", "chunk_index").distinct(), heard)
    rows = heard.select("video_id", "chunk_index", "start_s", "text", F.lit(False).alias("pending"))
    return rows.unionByName(todo.withColumn("pending", F.lit(True)), allowMissingColumns=True)


@query("SELECT event_type AS name, value, CAST(user_id AS VARCHAR) AS source, epoch_us(ts) AS us FROM events")
def library_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Timing samples appended in two steps, read with the library's types; tables that are not there are empty."""
    root = _fresh(spark, "library")
    e = B.table(spark, sf, "events").select(F.col("event_type").alias("name"), "value", F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for part in (0, 1):
        sinks.append_samples(e.where(F.col("event_id") % 2 == part), f"{root}/metric_samples")
    library = readers.Library(spark, root)
    return library["metric_samples"].select("name", "value", "source", F.unix_micros("ts").alias("us")).join(library["videos"].select(F.col("video_id").alias("source")), "source", "left_anti")


@query("""WITH d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
  SELECT 'ask ' || source AS query, max(CASE WHEN n = 1 THEN text END) AS positive, list_sort(list(text) FILTER (n BETWEEN 2 AND 5)) AS negatives FROM d GROUP BY source""")
def export_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Training pairs exported as JSONL, a record a query, and read back: a source's first document against its next four."""
    path = _fresh(spark, "passages")
    d = B.table(spark, sf, "documents").select("doc_id", "source", "text")
    first = topk(d, ["source"], [F.col("doc_id").asc()], 5, "n")
    pairs = first.select(F.col("source").alias("query_id"), F.concat(F.lit("ask "), "source").alias("query"), F.col("text").alias("passage"), F.when(F.col("n") == 1, 1.0).otherwise(0.0).alias("label"))
    sinks.export_jsonl(sinks.passages_records(pairs), path)
    return spark.read.schema("query string, positive string, negatives array<string>").json(path)


# --- table functions from SQL -------------------------------------------------------------------


@query("""WITH v AS (SELECT source AS video_id, sum(n_chars)::DOUBLE / 100 AS d FROM documents GROUP BY source),
  n AS (SELECT *, greatest(1, CAST(floor(d / 60) AS BIGINT)) AS whole FROM v WHERE d > 0), m AS (SELECT *, whole + CASE WHEN d - whole * 60 >= 15 THEN 1 ELSE 0 END AS n FROM n)
  SELECT video_id, i AS chunk_index, i * 60.0::DOUBLE AS start_s, CASE WHEN i = n - 1 THEN round(d, 3) ELSE (i + 1) * 60.0::DOUBLE END AS end_s FROM m, LATERAL (SELECT unnest(range(n)) AS i)""")
def sql_plan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks planned in SQL, a lateral call for every video."""
    table_functions.register(spark)
    B.table(spark, sf, "documents").groupBy("source").agg((F.sum("n_chars") / 100.0).alias("duration_s")).createOrReplaceTempView("_videos")
    return spark.sql("SELECT v.source AS video_id, c.chunk_index, c.start_s, c.end_s FROM _videos v, LATERAL plan_chunks(v.duration_s) c")


@query("""WITH o AS (SELECT o_custkey AS video_id, o_orderkey AS chunk_index, CAST(o_orderkey % 50 AS DOUBLE) AS a, CAST(o_orderkey % 50 + 5 + o_orderkey % 40 AS DOUBLE) AS b FROM orders),
  w AS (SELECT *, greatest(1, CAST(ceil(b - a) AS BIGINT)) AS n FROM o), k AS (SELECT *, unnest(range(greatest(0, CAST(ceil((n - 8) / 4.0) AS BIGINT)) + 1)) AS k FROM w)
  SELECT video_id, chunk_index, k AS window_index, a + k * 4 AS start_s, least(a + k * 4 + 8, a + n) AS end_s, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, k) - 1 AS in_video FROM k""")
def sql_sample_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows planned in SQL over a table partitioned by video: orders stand for chunks, customers for videos."""
    table_functions.register(spark)
    length = F.lit(5) + F.col("o_orderkey") % 40
    at = (F.col("o_orderkey") % 50).cast("double")
    B.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("video_id"), F.col("o_orderkey").cast("long").alias("chunk_index"), at.alias("start_s"), (at + length).alias("end_s")).createOrReplaceTempView("_chunks")
    return spark.sql("SELECT * FROM sample_windows(TABLE(SELECT * FROM _chunks) PARTITION BY video_id ORDER BY chunk_index)")


@query("SELECT source AS video_id, doc_id AS label_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents")
def number_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Running number of every label of a video, a block of labels at a time, so that no video is gathered."""
    d = B.table(spark, sf, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("label_id"))
    placed = positions(d, ["video_id"], ["label_id"], F.floor(F.col("label_id") / B.DOC_BLOCK))
    return placed.select("video_id", "label_id", (F.col("pos") + 1).alias("number"))
