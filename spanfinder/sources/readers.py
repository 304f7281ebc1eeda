"""Readers for the library tables and for benchmark, transcript and manifest files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import versions
from .sinks import table_exists


@dataclass
class Library:
    """Lazily read tables of one root folder; a table that does not exist yet is empty."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        schema = schemas.TABLES[name]
        path = f"{self.root}/{name}"
        if not table_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        if versions.state(self.spark, path) is not None:
            return versions.read(self.spark, path)
        return self.spark.read.schema(schema).parquet(path)

    __getitem__ = table


CLIP_ID = r"^(.*)_([^_]*)_([^_]*)$"


def parse_vid(vid: Column) -> Column:
    """Struct (source_id, start_s, end_s) of a clip id, split from the right: the source id may hold underscores."""
    part = lambda i: F.regexp_extract(vid, CLIP_ID, i)
    return F.struct(part(1).alias("source_id"), part(2).cast("double").alias("start_s"), part(3).cast("double").alias("end_s"))


def _spans(windows: Column) -> Column:
    return F.transform(windows, lambda w: F.struct(F.get(w, F.lit(0)).alias("start_s"), F.get(w, F.lit(1)).alias("end_s")))


def read_jsonl_benchmark(spark: SparkSession, path: str, split: str = "val") -> tuple[DataFrame, DataFrame]:
    """Clips and queries of a JSONL annotation file; one clip per distinct vid.

    A clip's rows agree in its duration, or fall back to the span in its id, so which row is kept does not matter.
    """
    rows = spark.read.schema(schemas.ANNOTATION).json(path).filter("vid IS NOT NULL").withColumn("_c", parse_vid(F.col("vid")))
    span = F.col("_c.end_s") - F.col("_c.start_s")
    duration = F.coalesce(F.when(F.col("duration") != 0, F.col("duration")), span)
    videos = rows.groupBy("vid").agg(F.first("_c").alias("_c"), F.max(duration).alias("duration_s")).select(
        F.col("vid").alias("external_id"),
        F.lit(split).alias("split"),
        "duration_s",
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("_c.source_id")).alias("source_url"),
        F.col("_c.source_id").alias("source_id"),
        F.col("_c.start_s").alias("clip_start_s"),
        F.col("_c.end_s").alias("clip_end_s"),
    )
    queries = rows.select(
        F.col("qid").cast("string").alias("external_id"),
        F.col("vid").alias("video_external_id"),
        F.lit(split).alias("split"),
        F.col("query").alias("text"),
        _spans(F.col("relevant_windows")).alias("relevant"),
        "saliency_scores",
    )
    return videos, queries


def read_dataset_doc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Clips and queries of a {videos, queries} document; the first relevant clip owns a query."""
    doc = spark.read.schema(schemas.DATASET_DOC).option("multiLine", True).json(path)
    videos = doc.select(F.inline("videos")).select(F.col("key").alias("external_id"), "title", "file", "url", "license")
    q = doc.select(F.inline("queries"))
    owner = F.get("relevant", F.lit(0))["video"]
    own = F.filter("relevant", lambda r: r["video"] == owner)
    queries = q.select(
        F.col("id").alias("external_id"),
        owner.alias("video_external_id"),
        "text",
        "modality",
        "author",
        "notes",
        F.transform(own, lambda r: F.struct(r["start_s"].alias("start_s"), r["end_s"].alias("end_s"))).alias("relevant"),
    )
    return videos, queries


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter(F.length("id") > 0)


PLACE = r"/(?:video_id=)?([^/=]+)/(?:chunks/|chunk_index=)(\d+)/[^/]*$"


def _place(part: int) -> Column:
    """Video (1) or chunk (2) of the file a row was read from: .../<video>/chunks/<index>/<file>, or the folders of a partitioned write."""
    return F.regexp_extract(F.input_file_name(), PLACE, part)


def parse_manifest(col: Column) -> Column:
    """Array of (t_s, key, phash) from a frame manifest."""
    rows = F.from_json(col, schemas.MANIFEST)
    return F.transform(rows, lambda f: F.struct((f["t_ms"] / 1000.0).alias("t_s"), f["key"].alias("key"), f["phash"].alias("phash")))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all chunk manifests below a path, one file a chunk."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    d = docs.select(
        _place(1).alias("video_id"),
        _place(2).cast("int").alias("chunk_index"),
        parse_manifest(F.col("value")).alias("frames"),
    )
    return d.select("video_id", "chunk_index", F.inline("frames"))


def read_transcripts(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Checkpointed utterances written by the wanted speech model; other models' checkpoints do not count."""
    raw = spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    d = raw.select(
        _place(1).alias("video_id"),
        _place(2).cast("int").alias("chunk_index"),
        "model",
        "utterances",
    ).filter(F.col("model") == model)
    return d.select("video_id", "chunk_index", F.inline_outer("utterances")).select(
        "video_id", "chunk_index", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text", "words"
    )


def untranscribed(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Chunks without a usable checkpoint."""
    done = transcripts.select("video_id", "chunk_index").distinct()
    return chunks.join(done, ["video_id", "chunk_index"], "left_anti")


# --- benchmark adapters ----------------------------------------------------------------------

Adapter = Callable[[SparkSession, str, str], tuple[DataFrame, DataFrame]]

ADAPTERS: dict[str, Adapter] = {
    "jsonl": lambda spark, root, split: read_jsonl_benchmark(spark, f"{root}/{split}.jsonl", split),
    "document": lambda spark, root, split: read_dataset_doc(spark, root),
}


def register_adapter(name: str, adapter: Adapter) -> None:
    ADAPTERS[name] = adapter


def import_split(
    spark: SparkSession, adapter: str, root: str, split: str, sink: str, *, ids: DataFrame | None = None, limit: int | None = None, seed: int = 0
) -> None:
    """Write a split's clips and queries once; every query of a chosen clip comes along."""
    from ..operators.ordered import seeded_subset
    from .sinks import insert_if_absent

    videos, queries = ADAPTERS[adapter](spark, root, split)
    if ids is not None:
        videos = videos.join(ids.select(F.col("id").alias("external_id")).distinct(), "external_id", "left_semi")
    elif limit is not None:
        videos = seeded_subset(videos, "external_id", limit, seed)
    tag = lambda d: d.withColumn("dataset", F.lit(adapter)).withColumn("split", F.lit(split))
    kept = queries.join(videos.select(F.col("external_id").alias("video_external_id")), "video_external_id", "left_semi")
    insert_if_absent(tag(videos), f"{sink}/dataset_videos", ["dataset", "external_id"])
    insert_if_absent(tag(kept), f"{sink}/dataset_queries", ["dataset", "external_id"])
