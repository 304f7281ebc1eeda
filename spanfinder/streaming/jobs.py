"""Streaming twins: ingest, indexing, completion, stale workers, rates, quantiles, stage latency, sessions.

Late rows: a ten-minute watermark; rows behind it leave the windows, the raw table still gets them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.quantiles import quantile_of_bins
from ..plans.segments import build_segments, trim_utterances
from ..session import cut_lineage
from ..sources.sinks import insert_if_absent, replace_partitions, table_exists

LATENESS = "10 minutes"


def with_lateness(df: DataFrame, ts: str = "ts", delay: str = LATENESS) -> DataFrame:
    """Event time as a timestamp with the watermark every windowed job uses."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_available(df: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop; restarts continue from the checkpoint."""
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each_batch).start()
    )


INDEX_BUCKETS = 64


def stream_index(transcripts: DataFrame, chunks: DataFrame, sink: str, checkpoint: str, buckets: int = INDEX_BUCKETS) -> StreamingQuery:
    """Index chunks as their transcripts arrive, a chunk's in one batch or in several.

    transcripts: (video_id, chunk_index, start_s, end_s, words). Utterances, cut once to the chunks they reach into, and segments lie
    in `buckets` partitions by video, whatever the number of chunks. A batch builds the chunks it touches anew from all of their
    utterances so far, and replaces its buckets in one commit, so a search sees all or none of a chunk's rows and a replayed batch
    leaves identical ones.
    """
    spark, heard, built = transcripts.sparkSession, f"{sink}/utterances", f"{sink}/segments"
    key = ["video_id", "chunk_index"]
    at = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int").alias("bucket")

    def write(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        # a chunk that is named without words in it is built too
        rows = trim_utterances(batch, chunks).unionByName(batch.select(*key).distinct(), allowMissingColumns=True)
        rows = rows.select("*", at, F.lit(n).cast("long").alias("batch"))
        replace_partitions(rows, heard, ["batch", "bucket"])
        upto = spark.read.schema(rows.schema).parquet(heard).where(F.col("batch") <= n)
        touched = cut_lineage(upto.where(F.col("batch") == n).select("bucket", *key).distinct())
        mine = F.broadcast(touched.select("bucket").distinct())
        heard_there = upto.join(mine, "bucket", "left_semi").join(touched, key, "left_semi")
        fresh = build_segments(chunks.join(touched, key, "left_semi"), heard_there).select("*", at)
        if table_exists(spark, built):
            old = spark.read.schema(fresh.schema).parquet(built).join(mine, "bucket", "left_semi")
            fresh = fresh.unionByName(old.join(touched, key, "left_anti"))
        replace_partitions(fresh, built, ["bucket"])

    return run_available(transcripts, checkpoint, write)


def stream_ingest(df: DataFrame, sink: str, checkpoint: str, key: str = "idempotency_key", ts: str = "ts", order: Sequence[str] = ()) -> StreamingQuery:
    """Each key is stored once, whatever batch its repeats come in: the sink takes the first by `order` of a batch, and none
    that it has. Without an order any repeat will do, and those inside the watermark are dropped before."""
    once = with_lateness(df, ts)
    if not order:
        once = once.dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, sink, [key], [F.col(c) for c in order])

    return run_available(once, checkpoint, write)


def rates(events: DataFrame, by: Sequence[str], window: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count and per-second rate by label over tumbling or sliding windows. Works on streams and tables."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    d = events.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"))
    length = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return d.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", (F.col("n") / length).alias("per_second"))


def stream_rates(events: DataFrame, by: Sequence[str], window: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    return rates(with_lateness(events, ts), by, window, slide, ts)


def quantiles(samples: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float], qs: dict[str, float], window: str = "5 minutes", slide: str | None = "1 minute", ts: str = "ts") -> DataFrame:
    """Quantiles from fixed buckets per window: the state is one counter per bucket, whatever the volume."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    d = samples.groupBy(w, *by).agg(*counts, F.count(F.col(value)).alias("n"))
    cumulative = F.array(*[F.col(f"b{i}") for i in range(len(bounds))], F.col("n"))
    cols = [quantile_of_bins(bounds, cumulative, q).alias(name) for name, q in qs.items()]
    return d.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *cols, "n")


def stream_quantiles(samples: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float], qs: dict[str, float], window: str = "5 minutes", slide: str | None = "1 minute", ts: str = "ts") -> DataFrame:
    return quantiles(with_lateness(samples, ts), by, value, bounds, qs, window, slide, ts)


def stage_latency(first: DataFrame, second: DataFrame, key: str = "video_id", within: str = "1 hour", delay: str | None = LATENESS) -> DataFrame:
    """Seconds between two stages of a key, joined within a time bound so that state can be dropped.

    Both sides: (key, ts). Pass delay=None for tables.
    """
    a, b = first.select(F.col(key).alias("_a"), F.col("ts").alias("from_ts")), second.select(F.col(key).alias(key), F.col("ts").alias("to_ts"))
    if delay:
        a, b = a.withWatermark("from_ts", delay), b.withWatermark("to_ts", delay)
    cond = F.expr(f"_a = {key} AND to_ts >= from_ts AND to_ts <= from_ts + INTERVAL {within}")
    return a.join(b, cond).select(key, "from_ts", "to_ts", ((F.unix_micros("to_ts") - F.unix_micros("from_ts")) / 1e6).alias("seconds"))


def sessions(events: DataFrame, worker: str, gap: str = "90 seconds", ts: str = "ts") -> DataFrame:
    """Stretches of activity of a worker without a pause of `gap` or more."""
    d = events.groupBy(F.session_window(ts, gap), worker).agg(F.count(F.lit(1)).alias("n"))
    return d.select(worker, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_sessions(events: DataFrame, worker: str, gap: str = "90 seconds", ts: str = "ts") -> DataFrame:
    return sessions(with_lateness(events, ts), worker, gap, ts)


# --- late rows --------------------------------------------------------------------------------


def stream_raw(events: DataFrame, raw: str, late: str, checkpoint: str, window: str = "5 minutes", delay: str = LATENESS, ts: str = "ts") -> StreamingQuery:
    """Keep every row in `raw`, and in `late`/rows those whose window was closed when they came.

    A window is closed when its end is not after the watermark, the latest event time of all batches before less `delay`: these
    rows are the ones a windowed count with the same watermark leaves out. `late`/marks has a row a batch: latest
    time, rows, late rows. Each batch has a folder of its own in all three, so a replay changes nothing.
    """
    spark = events.sparkSession
    marks = "latest_us long, n long, n_late long, batch long"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{raw}/batch={n}")
        rows = spark.read.schema(batch.schema).parquet(f"{raw}/batch={n}")
        before = None
        if n and table_exists(spark, f"{late}/marks"):
            before = spark.read.schema(marks).parquet(f"{late}/marks").where(F.col("batch") < n).agg(F.max("latest_us")).first()[0]
        level = F.timestamp_millis(F.floor(F.lit(before).cast("long") / 1000)) - F.expr(f"INTERVAL {delay}")
        behind = rows.withColumn("_end", F.window(F.col(ts), window)["end"]).where(F.col("_end") <= level).drop("_end")
        behind.write.mode("overwrite").parquet(f"{late}/rows/batch={n}")
        n_late = spark.read.schema(batch.schema).parquet(f"{late}/rows/batch={n}").agg(F.count(F.lit(1)).alias("n_late"))
        sums = rows.agg(F.max(F.unix_micros(ts)).alias("latest_us"), F.count(F.lit(1)).alias("n"))
        sums.crossJoin(n_late).write.mode("overwrite").parquet(f"{late}/marks/batch={n}")  # one row each

    return run_available(events.withColumn(ts, F.col(ts).cast("timestamp")), checkpoint, write)


# --- stateful: completion and stale heartbeats -----------------------------------------------

REPORT = "video_id string, chunk_index long, status string, chunk_count long, ts timestamp"
FINAL = "video_id string, status string, failed bigint, total bigint"
TOLD_MS = 24 * 3600 * 1000
OPEN_MS = 30 * 24 * 3600 * 1000
_ORDER = {"failed": 1, "done": 2}  # of reports at the same time; any other status comes first
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Completion(StatefulProcessor):
    """A video's chunks by their latest report, in packed blocks, and sums over them, so that the reports of a batch cost one
    look-up a block.

    blocks: block -> sorted (chunk, time, order) records, kept OPEN_MS after a block last changed. Chunks are dealt over a power of two
    of blocks by hash; it doubles when they would hold more than BLOCK_CHUNKS each. sums: done and failed chunks, known ones and
    those expected, the outcome told last, the number of blocks, and when to forget. A video that was told is forgotten
    `told_ms` after its last report: its one timer is set again if reports came since.
    """

    def __init__(self, told_ms: int, open_ms: int):
        self.told_ms, self.open_ms = told_ms, open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "chunks binary", self.open_ms)
        self.sums = handle.getValueState("sums", "done long, failed long, known long, total long, told string, n_blocks long, forget_ms long", self.open_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.sums.get()
        done, failed, known, total, told, n_blocks, forget = before or (0, 0, 0, 0, None, 1, None)
        ended, held = np.array([done, failed, known]), []
        for pdf in rows:
            total = max(total, int(pdf["chunk_count"].max()))
            held.append(_reports(pdf))
            if sum(map(len, held)) >= HELD_REPORTS:
                n_blocks, ended, held = *self._fold(held, n_blocks, ended), []
        if held:
            n_blocks, ended = self._fold(held, n_blocks, ended)
        done, failed, known = (int(n) for n in ended)
        outcome = ("failed" if failed else "ready") if 0 < total <= done + failed else None
        tell = outcome is not None and outcome != told
        told = outcome or told
        if told:
            armed, forget = forget is not None, timerValues.getCurrentProcessingTimeInMs() + self.told_ms
            if not armed:
                self.handle.registerTimer(forget)
        self.sums.update((done, failed, known, total, told, n_blocks, forget))
        if tell:
            yield pd.DataFrame({"video_id": [key[0]], "status": [outcome], "failed": [failed], "total": [total]})

    def _fold(self, held: list[np.ndarray], n_blocks: int, ended: np.ndarray) -> tuple[int, np.ndarray]:
        """Take reports into the blocks; how many blocks there are then, and the sums."""
        fresh, old_blocks = _latest(np.concatenate(held)), n_blocks
        while n_blocks * BLOCK_CHUNKS < ended[2] + len(fresh):
            n_blocks *= 2
        if n_blocks > old_blocks and ended[2]:
            kept = [np.frombuffer(bytes(packed), CHUNK) for (packed,) in self.blocks.values()]
            self.blocks.clear()
            for at, part in _dealt(np.concatenate(kept) if kept else fresh[:0], n_blocks):
                self.blocks.updateValue((at,), (part.tobytes(),))
        for at, part in _dealt(fresh, n_blocks):
            stored = self.blocks.getValue((at,)) if ended[2] else None
            old = np.frombuffer(bytes(stored[0]), CHUNK) if stored else fresh[:0]
            new = _latest(np.concatenate([old, part]))
            if not np.array_equal(new, old):
                self.blocks.updateValue((at,), (new.tobytes(),))
                ended = ended + _ended(new) - _ended(old)
        return n_blocks, ended

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sums = self.sums.get()
        if sums and sums[-1] is not None and sums[-1] > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(sums[-1])
            return iter(())
        self.blocks.clear()
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


CHUNK = np.dtype([("chunk", "<i8"), ("at", "<i8"), ("turn", "i1")])
BLOCK_CHUNKS, HELD_REPORTS = 512, 1 << 20


def _reports(pdf: pd.DataFrame) -> np.ndarray:
    """Latest reports of the chunks of a batch."""
    out = np.empty(len(pdf), CHUNK)
    out["chunk"], out["at"], out["turn"] = pdf["chunk_index"].to_numpy(), pdf["at_us"].to_numpy(), pdf["turn"].to_numpy()
    return _latest(out)


def _latest(reports: np.ndarray) -> np.ndarray:
    """One record a chunk, the last by time and order; sorted by chunk."""
    rows = reports[np.lexsort((reports["turn"], reports["at"], reports["chunk"]))]
    last = np.ones(len(rows), bool)
    last[:-1] = rows["chunk"][1:] != rows["chunk"][:-1]
    return rows[last]


def _dealt(chunks: np.ndarray, n_blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Records by block, each block's sorted by chunk as they came."""
    if n_blocks == 1:
        if len(chunks):
            yield 0, chunks
        return
    mixed = chunks["chunk"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = (mixed >> np.uint64(65 - n_blocks.bit_length())).astype(np.int64)
    order = np.argsort(block, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(part):
            yield int(block[part[0]]), chunks[part]


def _ended(chunks: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(chunks["turn"] == _ORDER["done"]), np.count_nonzero(chunks["turn"] == _ORDER["failed"]), len(chunks)])


def completions(chunks: DataFrame, told_ms: int = TOLD_MS, open_ms: int = OPEN_MS) -> DataFrame:
    """One row when all chunks of a video are terminal, and another only if second tries turn its outcome.

    chunks: reports (video_id, chunk_index, status, chunk_count, ts) in any order, repeats included. A chunk is as its latest
    report says, done before failed before others at the same time; no report is too late to count.
    """
    d = chunks.where("video_id IS NOT NULL AND chunk_index IS NOT NULL AND ts IS NOT NULL").withColumn("at_us", F.unix_micros("ts"))
    turn = F.when(F.col("status") == "done", _ORDER["done"]).when(F.col("status") == "failed", _ORDER["failed"]).otherwise(0)
    d = d.select("video_id", "chunk_index", turn.cast("int").alias("turn"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "at_us")
    return d.groupBy("video_id").transformWithStateInPandas(_Completion(told_ms, open_ms), FINAL, "Append", "ProcessingTime")


def stream_finalize(chunks: DataFrame, sink: str, checkpoint: str, told_ms: int = TOLD_MS, open_ms: int = OPEN_MS) -> StreamingQuery:
    """Tell the outcome of every video once: `completions` written where (video_id, status) is absent, so that a replay after
    the state has expired, or from a new checkpoint, adds nothing."""
    spark = chunks.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, sink, ["video_id", "status"], [F.col("failed"), F.col("total")])

    # with timers of processing time a job over what has arrived would go on with empty batches for ever
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)  # the query takes a copy of the settings when it starts
    try:
        return run_available(completions(chunks, told_ms, open_ms), checkpoint, write)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


STALE = "id bigint, outcome string, last_beat_us bigint"
STALE_STATE = "last_us bigint, attempts bigint, max_attempts bigint, running boolean"


def _stale(timeout_s: int):
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, attempts, most, running = state.get
            state.remove()
            if running:
                yield pd.DataFrame({"id": [key[0]], "outcome": ["dead" if attempts >= most else "queued"], "last_beat_us": [last]})
            return
        last, attempts, most, running = state.get if state.exists else (-1, 0, 0, False)
        for pdf in batches:
            newest = pdf.loc[pdf["beat_us"].idxmax()]
            if int(newest["beat_us"]) >= last:
                last, attempts, most = int(newest["beat_us"]), int(newest["attempts"]), int(newest["max_attempts"])
                running = newest["status"] == "running"
        if not running:
            if state.exists:
                state.remove()
            return
        state.update((last, attempts, most, running))
        deadline = max(last // 1000 + timeout_s * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(deadline)

    return step


def stream_stale(beats: DataFrame, timeout_s: int = 90, delay: str = "1 minute") -> DataFrame:
    """Running jobs that stay silent for `timeout_s` of event time: queued again, or dead at the last attempt.

    beats: (id, status, attempts, max_attempts, ts). A job that reports another status leaves the state.
    """
    d = with_lateness(beats, "ts", delay).withColumn("beat_us", F.unix_micros("ts"))
    return d.groupBy("id").applyInPandasWithState(_stale(timeout_s), STALE, STALE_STATE, "append", "EventTimeTimeout")
