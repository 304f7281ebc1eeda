"""Small operations of the library on the shared tables: captions, on-screen lines, registry, reviews, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as tx
from ..operators.ordered import spaced_sample as spaced
from ..operators.pooling import mean_pool
from ..plans import evaluation as ev
from ..plans import library as lib
from ..plans import proposals as pr
from ..plans import segments as sg
from ..plans import timeline as tl
from ..plans.search import apply_span_mode, version_filter
from ..session import cut_lineage
from ..sources import sinks
from . import bindings as B
from .evaluation_queries import _with_modality, both_runs
from .registry import ORACLES, query


@query(f"""WITH c AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN 'Arafed ' ELSE '' END || text, {B.sql_text('(?i)' + V.CAPTION_ARTIFACTS)}, '', 'g'), ' ') AS t FROM documents)
  SELECT doc_id, md5(lower(substr(t, 1, 1)) || substr(t, 2)) AS caption FROM c""")
def clean_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions without the model's artifacts; every other text begins with one."""
    d = B.documents(spark, sf)
    caption = F.concat(F.when(F.col("doc_id") % 2 == 0, "Arafed ").otherwise(""), "text")
    return d.select("doc_id", F.md5(tx.clean_caption(caption)).alias("caption"))


@query("""WITH w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
  b AS (SELECT doc_id, t, i // 5 * 13.0::DOUBLE AS y, i * 37 % 100 * 1.0::DOUBLE AS x FROM w WHERE length(t) % 10 >= 5 AND length(trim(t, ' ')) >= 2)
  SELECT d.doc_id, md5(coalesce(string_agg(t, chr(10) ORDER BY round_even(y / 12, 0), x, t), '')) AS lines FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id""")
def screen_lines(spark: SparkSession, sf: str) -> DataFrame:
    """On-screen boxes, here a box for each word, without unsure and short ones, in reading order."""
    box = lambda t, i: F.struct(
        t.alias("t"), (F.length(t) % 10 / 10.0).alias("c"), F.array(F.array((i * 37 % 100).cast("double"), F.floor(i / 5) * 13.0)).alias("b")
    )
    boxes = F.transform(F.split("text", " "), box)
    return B.documents(spark, sf).select("doc_id", F.md5(F.coalesce(tx.lines_to_text(tx.filter_ocr_lines(boxes)), F.lit(""))).alias("lines"))


@query("""WITH f AS (SELECT doc_id // 4 AS segment_id, doc_id AS t, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS caption FROM documents),
  g AS (SELECT segment_id, arg_min(caption, t) AS caption, min(t) AS t FROM f WHERE length(trim(caption, ' ')) > 0 GROUP BY segment_id, lower(trim(caption, ' ')))
  SELECT segment_id, string_agg(caption, '. ' ORDER BY t) AS caption_text FROM g GROUP BY segment_id""")
def screen_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of a segment's frames, in order, repeats dropped whatever their case."""
    d = B.table(spark, sf, "documents").withColumn("caption", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")))
    frames = d.select(F.floor(F.col("doc_id") / 4).alias("segment_id"), F.col("doc_id").alias("t_s"), F.lit("").alias("ocr_text"), "caption")
    return sg.segment_screen_text(frames).select("segment_id", "caption_text")


_CLIPS = "clips AS (SELECT 'd' || doc_id AS external_id, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'test' END AS split, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'indexed' ELSE 'failed' END AS status FROM documents)"


def _clips(spark: SparkSession, sf: str) -> DataFrame:
    d, n = B.table(spark, sf, "documents"), F.col("doc_id")
    status = F.when(n % 3 == 0, "pending").when(n % 3 == 1, "indexed").otherwise("failed")
    return d.select(F.concat(F.lit("d"), n).alias("external_id"), F.when(n % 4 == 0, "val").otherwise("test").alias("split"), status.alias("status"), n.alias("created_at"))


@query(f"WITH {_CLIPS} SELECT external_id, split FROM clips WHERE status = 'pending' AND split = 'val'")
def pending_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of a split that are still to be fetched."""
    return lib.pending_fetches(_clips(spark, sf), "val").select("external_id", "split")


@query("SELECT 'type=' || coalesce(lang, '') AS type, CASE WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed candidates by type and status."""
    d = B.table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 3 == 0, "rejected").otherwise("approved").alias("status")
    return pr.review_counts(d.select(F.concat(F.lit("type="), F.coalesce("lang", F.lit(""))).alias("type"), status))


@query("""SELECT event_type AS kind, 'm' || (user_id % 5) AS model_key, count(*) AS dim, 'active' AS status, max(epoch_us(ts)) AS created_us FROM events
  WHERE NOT (event_type = 'view' AND user_id % 5 = 1) GROUP BY ALL""")
def version_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Model versions after one was retired."""
    e = B.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_key"), F.col("ts").cast("timestamp").alias("ts"))
    registry = e.groupBy("kind", "model_key").agg(F.count(F.lit(1)).alias("dim"), F.lit("active").alias("status"), F.max("ts").alias("created_at"))
    left = lib.versions(lib.retire(registry, "view", "m1"))
    return left.select("kind", "model_key", "dim", "status", F.unix_micros("created_at").alias("created_us"))


@query("SELECT DISTINCT o_custkey AS video_id FROM orders")
def distinct_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Videos that a set of queries refers to; orders stand for queries, customers for videos."""
    return lib.distinct_videos(B.table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id")))


@query("""SELECT source AS video_id, doc_id AS chunk_index, CASE WHEN doc_id % 3 = 2 AND source IN ('src1', 'src2') THEN 'pending' WHEN doc_id % 3 = 2 THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN doc_id % 3 = 2 AND source NOT IN ('src1', 'src2') THEN 'broken' END AS error FROM documents""")
def reset_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Failed chunks of two videos go back to pending."""
    failed = F.col("doc_id") % 3 == 2
    d = B.table(spark, sf, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_index"), F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, "broken").alias("error"))
    return sinks.reset_chunks(d, d.select("video_id").distinct().where(F.col("video_id").isin("src1", "src2")))


@query(f"""WITH l AS ({ORACLES['experiment_lanes']}) SELECT scope, min(lane) AS lane, hit10 FROM l WHERE hit10 = (SELECT max(hit10) FROM l u WHERE u.scope = l.scope) GROUP BY scope, hit10""")
def strongest_lane(spark: SparkSession, sf: str) -> DataFrame:
    """The lane with the best hit@10 overall and by modality."""
    truth = cut_lineage(B.truth(spark, sf))
    per_lane = ev.lane_attribution(both_runs(spark, sf), truth)
    lanes = ev.aggregate_lanes(per_lane, _with_modality(truth.select("query_id").distinct()), "modality")
    return ev.strongest_lane(lanes).select("scope", "lane", F.col("hit@10").alias("hit10"))


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
  SELECT source, doc_id FROM p WHERE n <= 7 OR list_contains(list_transform(range(7), lambda i: CAST(round_even(i * (n - 1) / 6.0::DOUBLE, 0) AS BIGINT)), pos)""")
def spaced_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Seven documents of every source at even distances, both ends among them."""
    d = B.table(spark, sf, "documents").select("source", "doc_id")
    return spaced(d, ["source"], ["doc_id"], F.floor(F.col("doc_id") / B.DOC_BLOCK), 7).select("source", "doc_id")


@query("""WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
  m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL)
  SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Unit-length mean vector of every label."""
    means = mean_pool(B.table(spark, sf, "embeddings").select("label", "embedding"), ["label"])
    return means.select("label", F.posexplode("centroid").alias("at", "x")).select("label", (F.col("at") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""WITH v AS (SELECT source AS video_id, doc_id // 100 AS part, coalesce(lang, '?') || (doc_id % 3) AS title, sum(doc_id * 7 % 11 + 1.0::DOUBLE) AS h, min(doc_id) AS t FROM documents GROUP BY ALL)
  SELECT video_id, part, title AS heading FROM (SELECT *, row_number() OVER (PARTITION BY video_id, part ORDER BY h DESC, t, title) AS r FROM v) WHERE r = 1""")
def slide_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The title with the greatest summed height in every stretch of a video; a document is a frame with one title."""
    d = B.table(spark, sf, "documents").select(F.col("source").alias("video_id"), "doc_id", "lang")
    title = F.concat(F.coalesce("lang", F.lit("?")), F.col("doc_id") % 3)
    votes = d.select("video_id", F.col("doc_id").cast("double").alias("t_s"), title.alias("title"), (F.col("doc_id") * 7 % 11 + 1.0).alias("height"))
    part = F.floor(F.col("doc_id") / 100)
    spans = d.select("video_id", part.alias("part")).distinct().select("video_id", "part", (F.col("part") * 100.0).alias("start_s"), (F.col("part") * 100.0 + 100).alias("end_s"))
    return tl.slide_heading(votes, spans, ["video_id", "part"])


@query("""WITH t AS (SELECT source AS video_id, doc_id // 100 AS index, min(doc_id) * 1.0::DOUBLE AS a, max(doc_id) + 0.5::DOUBLE AS e FROM documents GROUP BY ALL)
  SELECT video_id, index, coalesce(lag(e) OVER (PARTITION BY video_id ORDER BY index), 0) AS start_s, e AS end_s FROM t""")
def contiguous_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that leave no gap: the first starts at 0, each other where the one before ends."""
    d = B.table(spark, sf, "documents").withColumn("index", F.floor(F.col("doc_id") / 100))
    topics = d.groupBy(F.col("source").alias("video_id"), "index").agg((F.min("doc_id") * F.lit(1.0)).alias("start_s"), (F.max("doc_id") + 0.5).alias("end_s"))
    return tl.make_contiguous(topics).select("video_id", "index", "start_s", "end_s")


@query("SELECT vec_id AS window_id FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 3 <> 0")
def windows_of_version(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of one kind and model version."""
    n = F.col("vec_id")
    windows = B.table(spark, sf, "embeddings").select(n.alias("window_id"), F.when(n % 2 == 1, "temporal").otherwise("frame").alias("kind"), F.when(n % 3 == 0, "other").otherwise("meanpool").alias("model_key"))
    return version_filter(windows, "temporal", "local/models/meanpool/").select("window_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 2.0::DOUBLE ELSE doc_id * 1.0::DOUBLE END AS start_s, CASE WHEN doc_id % 2 = 0 THEN doc_id + 4.0::DOUBLE ELSE doc_id + 10.0::DOUBLE END AS end_s FROM documents")
def window_spans(spark: SparkSession, sf: str) -> DataFrame:
    """In window mode the best window's span takes the place of the segment's; every other document has a window."""
    n = F.col("doc_id")
    span = F.create_map(F.lit("temporal"), F.struct((n + 2.0).alias("span_start"), (n + 4.0).alias("span_end")))
    rows = B.table(spark, sf, "documents").select("doc_id", (n * F.lit(1.0)).alias("start_s"), (n + 10.0).alias("end_s"), F.when(n % 2 == 0, span).alias("spans"))
    return apply_span_mode(rows, "window").select("doc_id", "start_s", "end_s")
