"""Questions about the library: videos, chunks, datasets, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lowered
from ..operators.sizing import BROADCAST_ROWS, at_most
from ..operators.topk import topk


def chunk_counts(chunks: DataFrame) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return chunks.groupBy("video_id").agg(n("done").alias("chunks_done"), n("failed").alias("chunks_failed"), F.count(F.lit(1)).alias("chunks_seen"))


def topic_counts(topics: DataFrame) -> DataFrame:
    return topics.groupBy("video_id").agg(F.count(F.lit(1)).alias("topic_count"))


def library_overview(videos: DataFrame, chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """Every video with done and failed chunks, progress and topic count."""
    d = videos.join(chunk_counts(chunks).drop("chunks_seen"), "video_id", "left").join(topic_counts(topics), "video_id", "left")
    d = d.fillna({"chunks_done": 0, "chunks_failed": 0, "topic_count": 0})
    return d.withColumn("progress", F.coalesce(F.try_divide("chunks_done", "chunk_count"), F.lit(0.0)))


def video_detail(video_id, videos: DataFrame, chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """One video's overview with its chunks as an ordered list."""
    mine = lambda t: t.filter(F.col("video_id") == F.lit(video_id))
    listed = mine(chunks).groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "start_s", "end_s", "status"))).alias("chunks")
    )
    return library_overview(mine(videos), mine(chunks), mine(topics)).join(listed, "video_id", "left")


def transcript(video_id, utterances: DataFrame, contains: str | None = None) -> DataFrame:
    """Utterances of a video in time order, optionally those with a text part, whatever its case."""
    d = utterances.filter(F.col("video_id") == F.lit(video_id))
    return (grep_transcript(d, contains) if contains else d).orderBy("start_s")


def grep_transcript(utterances: DataFrame, part: str) -> DataFrame:
    return utterances.filter(F.contains(F.lower("text"), F.lit(part.lower())))


def timeline(video_id, topics: DataFrame) -> DataFrame:
    return topics.filter(F.col("video_id") == F.lit(video_id)).orderBy("index")


def finalize(chunks: DataFrame) -> DataFrame:
    """Status of every video whose chunks are all terminal: failed when any failed, else ready."""
    c = chunk_counts(chunks).filter(F.col("chunks_done") + F.col("chunks_failed") == F.col("chunks_seen"))
    bad = F.col("chunks_failed") > 0
    message = F.concat(F.col("chunks_failed").cast("string"), F.lit(" of "), F.col("chunks_seen").cast("string"), F.lit(" chunks failed"))
    return c.select("video_id", F.when(bad, "failed").otherwise("ready").alias("status"), F.when(bad, message).alias("error"))


CHUNK_JOBS = ("extract_chunk", "index_chunk")


def propagate_dead(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of dead extract or index jobs fail, unless they are done. jobs: (video_id, chunk_index, type, status, last_error, finished_at)."""
    dead = jobs.filter((F.col("status") == "dead") & F.col("type").isin(*CHUNK_JOBS))
    last = dead.groupBy("video_id", "chunk_index").agg(F.max_by("last_error", F.struct("finished_at", "last_error")).alias("_why"), F.lit(True).alias("_dead"))
    d = chunks.join(last, ["video_id", "chunk_index"], "left")
    hit = F.col("_dead").isNotNull() & (F.col("status") != "done")
    d = d.withColumn("error", F.when(hit, F.coalesce("_why", F.lit("job reaped as dead"))).otherwise(F.col("error")))
    return d.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("_why", "_dead")


def link_library(dataset_videos: DataFrame, videos: DataFrame, dataset: str) -> DataFrame:
    """Unlinked dataset videos matched by (source = dataset, title = external id), else by uploaded title."""
    v = videos.select("video_id", "source", "title", F.col("status").alias("_vs"))
    own = topk(v.filter(F.col("source") == dataset), ["title"], [F.col("video_id").asc()], 1, "_r")
    up = topk(v.filter(F.col("source") == "upload"), ["title"], [F.col("video_id").asc()], 1, "_r")
    a = own.select(F.col("title").alias("external_id"), F.col("video_id").alias("_a"), F.col("_vs").alias("_as"))
    b = up.select(F.col("title").alias("meta_title"), F.col("video_id").alias("_b"), F.col("_vs").alias("_bs"))
    d = dataset_videos.join(a, "external_id", "left").join(b, "meta_title", "left")
    d = d.withColumn("_v", F.coalesce("_a", "_b")).withColumn("_s", F.when(F.col("_a").isNotNull(), F.col("_as")).otherwise(F.col("_bs")))
    fresh = F.col("video_id").isNull() & F.col("_v").isNotNull()
    status = F.when(fresh, F.when(F.col("_s") == "ready", "indexed").otherwise("fetched")).otherwise(F.col("status"))
    return d.withColumn("status", status).withColumn("video_id", F.coalesce("video_id", "_v")).drop("_a", "_b", "_as", "_bs", "_v", "_s")


PREFIX = 40


def resolve_titles(wanted: DataFrame, videos: DataFrame) -> DataFrame:
    """(key, title) to (key, video_id): exact title, else a library title that starts with its first 40 characters.

    Prefixes meet by equality: library titles are expanded to the prefix lengths that are asked for.
    """
    v = videos.select("video_id", F.col("title").alias("_lib"))
    first = lambda d: d.groupBy("key").agg(F.min("video_id").alias("video_id"))
    exact = first(wanted.join(v, wanted["title"] == v["_lib"]))
    rest = wanted.join(exact, "key", "left_anti").withColumn("_p", F.substring(lowered(F.col("title")), 1, PREFIX)).withColumn("_n", F.length("_p"))
    lengths = F.broadcast(rest.select("_n").distinct())  # at most 40 values
    lib = v.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(PREFIX)))).join(lengths, "_n").withColumn("_p", lowered(F.col("_lib")).substr(F.lit(1), F.col("_n")))
    return exact.unionByName(first(rest.join(lib, ["_p", "_n"])))


def dataset_status(dataset_videos: DataFrame, queries: DataFrame) -> DataFrame:
    """Counts by split and status with the number of queries per split."""
    q = queries.groupBy("split").agg(F.count(F.lit(1)).alias("queries"))
    return dataset_videos.groupBy("split", "status").agg(F.count(F.lit(1)).alias("n")).join(q, "split", "left").fillna({"queries": 0})


def pending_fetches(dataset_videos: DataFrame, split: str | None = None, limit: int | None = None) -> DataFrame:
    d = dataset_videos.filter("status = 'pending'")
    if split:
        d = d.filter(F.col("split") == split)
    d = d.orderBy("created_at", "external_id")
    return d.limit(limit) if limit else d


def versions(registry: DataFrame) -> DataFrame:
    """Model versions that are not retired, newest first per kind."""
    return registry.filter("status != 'retired'").orderBy("kind", F.col("created_at").desc())


def retire(registry: DataFrame, kind: str, model_key: str) -> DataFrame:
    hit = (F.col("kind") == kind) & (F.col("model_key") == model_key)
    return registry.withColumn("status", F.when(hit, "retired").otherwise(F.col("status")))


def restrict_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is listed; the list is broadcast when it is checked to be small."""
    listed = ids.select(key).distinct()
    return df.join(F.broadcast(listed) if at_most(listed, BROADCAST_ROWS) else listed, key, "left_semi")


def pending(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")


def distinct_videos(queries: DataFrame) -> DataFrame:
    return queries.select("video_id").distinct()
