"""Transcripts to retrieval segments, for all chunks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import plan_chunks, plan_segments, sample_windows
from ..functions.text import merge_captions, merge_lines
from ..operators.intervals import assign_to_intervals, overlap_join

CONTEXT_WORDS = 15
CHUNK_STRIDE = 10_000


def chunk_table(videos: DataFrame, chunk_s: float = 60.0, min_tail_s: float = 15.0) -> DataFrame:
    """videos(video_id, duration_s) -> (video_id, chunk_index, start_s, end_s)."""
    return videos.select("video_id", F.inline(plan_chunks(F.col("duration_s"), chunk_s, min_tail_s))).withColumnRenamed("index", "chunk_index")


def trim_utterances(utterances: DataFrame, chunks: DataFrame) -> DataFrame:
    """Utterances cut to the chunks they reach into: words that start inside, span and text rebuilt.

    utterances: (video_id, start_s, end_s, words); an utterance without words in a chunk is dropped there.
    """
    u = utterances.select("video_id", "start_s", "end_s", "words")
    met = overlap_join(u, chunks.select("video_id", "chunk_index", "start_s", "end_s"), ["video_id"])
    inside = lambda w: (w["s"] >= F.col("r_start_s")) & (w["s"] < F.col("r_end_s"))
    cut = met.filter(F.exists("words", inside)).withColumn("words", F.filter("words", inside))
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    return cut.select(
        "video_id",
        "chunk_index",
        first["s"].alias("start_s"),
        F.greatest(last["e"], first["s"] + 0.2).alias("end_s"),
        F.array_join(F.col("words.w"), " ").alias("text"),
        "words",
    )


def _words_upto(ends: Column, times: Column) -> Column:
    """How many words there are up to the end of each segment: a word is in the first segment that ends after it starts, else in
    the last one. Words are in order of time, so a segment's are a slice."""
    n = F.size(times)
    return F.transform(ends, lambda e, j: F.when(j == F.size(ends) - 1, n).otherwise(n - F.size(F.filter(times, lambda s: s >= e))))


def build_segments(chunks: DataFrame, utterances: DataFrame) -> DataFrame:
    """Segments of every chunk with text and context.

    utterances: trimmed (video_id, chunk_index, start_s, end_s, words). A chunk's transcript is bounded
    by its length, so it is handled as one row; silent chunks get fixed windows.
    """
    timed = F.arrays_zip(F.col("words.s"), F.col("words.w")).cast("array<struct<s:double,w:string>>")
    speech = utterances.groupBy("video_id", "chunk_index").agg(
        F.collect_list("end_s").alias("ends"), F.sort_array(F.flatten(F.collect_list(timed))).alias("words")
    )
    d = chunks.select("video_id", "chunk_index", "start_s", "end_s").join(speech, ["video_id", "chunk_index"], "left")
    ends = F.coalesce("ends", F.array().cast("array<double>"))
    words = F.coalesce("words", F.array().cast("array<struct<s:double,w:string>>"))
    d = d.select(
        "video_id", "chunk_index", plan_segments(F.col("start_s"), F.col("end_s"), ends).alias("segs"), words.alias("words")
    )
    d = d.select("video_id", "chunk_index", "segs", F.col("words.w").alias("said"), _words_upto(F.col("segs.end_s"), F.col("words.s")).alias("upto"))
    from_to = lambda lo, hi: F.trim(F.array_join(F.slice("said", lo + 1, hi - lo), " "))

    def segment(s: Column, i: Column) -> Column:
        upto = lambda k: F.coalesce(F.get("upto", k), F.lit(0))
        lo, hi, last = upto(i - 1), upto(i), F.coalesce(F.get("upto", i + 1), F.get("upto", i))
        context = from_to(F.greatest(upto(i - 2), lo - CONTEXT_WORDS), F.least(last, hi + CONTEXT_WORDS))
        return F.struct(
            (F.col("chunk_index") * CHUNK_STRIDE + i).alias("index"),
            s["start_s"].alias("start_s"),
            s["end_s"].alias("end_s"),
            from_to(lo, hi).alias("text"),
            context.alias("context_text"),
        )

    return d.select("video_id", "chunk_index", F.inline(F.transform("segs", segment)))


def context_text(segments: DataFrame, words: int = CONTEXT_WORDS) -> DataFrame:
    """Neighbour context from a table of finished segments; a chunk is a bounded group."""
    w = Window.partitionBy("video_id", "chunk_index").orderBy("index")
    tokens = F.filter(F.split("text", " "), lambda t: F.length(t) > 0)
    d = segments.withColumn("_t", tokens)
    prev, after = F.lag("_t").over(w), F.lead("_t").over(w)
    none = F.array().cast("array<string>")
    d = d.withColumn("_p", F.coalesce(prev, none)).withColumn("_n", F.coalesce(after, none))
    tail = F.slice("_p", F.greatest(F.lit(1), F.size("_p") - words + 1), words)
    return d.withColumn("context_text", F.array_join(F.concat(tail, "_t", F.slice("_n", 1, words)), " ")).drop("_t", "_p", "_n")


def segment_screen_text(frames: DataFrame) -> DataFrame:
    """On-screen text and caption per segment from its frames: (segment_id, t_s, ocr_text, caption)."""
    lists = frames.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("t_s", "ocr_text", "caption"))).alias("f"))
    return lists.select(
        "segment_id",
        merge_lines(F.transform("f", lambda x: F.coalesce(x["ocr_text"], F.lit("")))).alias("ocr_text"),
        merge_captions(F.transform("f", lambda x: F.coalesce(x["caption"], F.lit("")))).alias("caption_text"),
    )


def window_table(chunks: DataFrame, window_s: float = 8.0, stride_s: float = 4.0, n_frames: int = 8) -> DataFrame:
    """Sampling windows over one frame per second of every chunk."""
    count = F.greatest(F.lit(1), F.ceil(F.col("end_s") - F.col("start_s")).cast("int"))
    times = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("start_s") + i)
    return chunks.select("video_id", "chunk_index", F.posexplode(sample_windows(times, window_s, stride_s, n_frames)).alias("window_index", "w")).select(
        "video_id", "chunk_index", "window_index", "w.start_s", "w.end_s", "w.frames"
    )


def assign_windows(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment of every window by its centre, else the nearest segment of the chunk."""
    centred = windows.withColumn("_c", (F.col("start_s") + F.col("end_s")) / 2)
    return assign_to_intervals(centred, segments, ["video_id", "chunk_index"], "_c", "window_index", "segment_id").drop("_c")


def pending_backfill(chunks: DataFrame, embeddings: DataFrame, kind: str, model_key: str, force: bool = False) -> DataFrame:
    """Finished chunks without rows for a model version; all finished chunks when forced."""
    done = chunks.filter("status = 'done'").select("video_id", "chunk_index")
    if force:
        return done
    have = embeddings.filter((F.col("kind") == kind) & (F.col("model_key") == model_key)).select("video_id", "chunk_index").distinct()
    return done.join(have, ["video_id", "chunk_index"], "left_anti")


def pending_captions(segments: DataFrame, force: bool = False) -> DataFrame:
    return segments if force else segments.filter(F.coalesce(F.col("caption_text"), F.lit("")) == "")
