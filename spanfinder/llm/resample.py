"""Resampling of documents towards a target: gains of hashed features, Gumbel keys and a distributed quickselect.

A feature is a run of words; its bucket is a checksum modulo the number of buckets. A bucket's gain compares how common it is
in the target and in the corpus, a document's weight is the mean gain of its features, and adding Gumbel noise to the weight
turns a draw without replacement in proportion to exp(weight / 1000) into a choice of the k greatest scores.

The k-th greatest is found by quickselect: random pivots split the rows that are left into ranges, one aggregation counts every
range and every pivot exactly, and only the range with the k-th key goes on. Only the rows up to that key are sorted, each range
of them in its own task, and ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import blocks, rows_of, starts_of
from .arrays import words as words_of
from .tables import keep, small_batches

PIVOTS = 24
RANK_ROWS = 100_000
LONG_SPAN = 64
# ascending: best score, smaller id (null ids last), hash of the text, and a number that tells repeated rows apart
KEY = ["_score", "_none", "_id", "_hash", "_row"]
_PLAIN = np.full(256, 0x20, np.uint8)  # bytes of words, lower-cased; all others are blanks
for _lo, _hi, _up in ((0x30, 0x3A, 0), (0x41, 0x5B, 0x20), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
    _PLAIN[_lo:_hi] = np.arange(_lo, _hi) + _up
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)  # register change by low byte


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each byte span, byte by byte over all spans at once; the few long spans one by one."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG_SPAN))  # spans over LONG_SPAN come first
    live = order[long:]
    lengths = size[live]
    for i in range(int(lengths[0]) if len(live) else 0):
        live = live[: int(np.searchsorted(-lengths, -i))]
        reg = out[live]
        out[live] = _CRC[(reg ^ data[start[live] + i]) & np.uint32(0xFF)] ^ (reg >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for j in order[:long]:
        out[j] = zlib.crc32(data[start[j] : end[j]].tobytes())
    return out


def features(data: np.ndarray, off: np.ndarray, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a block of texts, and the number of words of each row.

    Words are runs of digits, letters a to z and bytes from 0x80; A to Z count as a to z. A feature is a run of 1 to `words`
    words of one row, joined by one space.
    """
    data = _PLAIN[data]
    start, end, woff = words_of(data, off)
    # the words again, each with one space behind it
    size = end - start + 1
    to = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[to + size - 1] = False
    joined[inside] = data[np.repeat(start - to, size)[inside] + np.flatnonzero(inside)]
    row, rows, at = rows_of(woff), [], []
    for n in range(1, words + 1):
        first = starts_of(woff, n)
        rows.append(row[first])
        at.append(crc32_of(joined, to[first], (to + size - 1)[first + n - 1]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(at).astype(np.int64), np.diff(woff)


def bucket_counts(texts: DataFrame, words: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends its counts once, at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                n += np.bincount(features(data, off, words, buckets)[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares in the target and the corpus)."""
    b = len(corpus)
    s_all, t_all = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, doc_id: str) -> int:
    """floor(1000 x standard Gumbel noise) that the seed and the id fix."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighted(docs: DataFrame, gain: np.ndarray, words: int, seed: int) -> DataFrame:
    """docs(_text, _name, others): _text and _name give way to n_words, n_features, weight, score."""
    others = [c for c in docs.columns if c not in ("_text", "_name")]
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    new = ["n_words", "n_features", "weight", "score"]
    out = T.StructType([docs.schema[c] for c in others] + [T.StructField(c, T.LongType()) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, data, off in blocks(batch.column("_text")):
                row, bucket, n_words[lo:hi] = features(data, off, words, len(gain))
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                total[lo:hi] = np.bincount(row, weights=gain[bucket], minlength=hi - lo).astype(np.int64)  # whole numbers, exact
            weight = total // np.maximum(n, 1)
            score = weight + np.array([gumbel(seed, i or "") for i in batch.column("_name").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(x) for x in (n_words, n, weight, score)], [*others, *new])

    return docs.mapInArrow(run, out)


def _literal(row, df: DataFrame) -> Column:
    return F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in KEY])


def kth_key(keys: DataFrame, k: int, seed: int = 0):
    """The k-th smallest row of keys(KEY), k from 1 to the number of rows; keys are unique.

    A round draws PIVOTS random rows, counts the rows before, at and between them, and keeps the range that holds the k-th as a
    table, so a round reads about 1 / PIVOTS of the one before.
    """
    key, n_round = F.struct(*KEY), 0
    while True:
        drawn = keys.orderBy(F.xxhash64(F.lit(seed), F.lit(n_round), *KEY), *KEY).limit(PIVOTS)
        pivots = sorted(drawn.select(*KEY).collect(), key=lambda r: tuple((r[c] is not None, r[c]) for c in KEY))
        marks = F.array(*[_literal(p, keys) for p in pivots])
        place = 2 * F.size(F.filter(marks, lambda p: p < key)) + F.exists(marks, lambda p: p == key).cast("int")  # 2 j: between pivots, 2 j + 1: at one
        counted = {r["place"]: r["count"] for r in keys.select(place.alias("place")).groupBy("place").count().collect()}
        for at in sorted(counted):
            if k <= counted[at]:
                break
            k -= counted[at]
        if at % 2:
            return pivots[at // 2]
        keys, n_round = keep(keys.where(place == at), "select"), n_round + 1


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    words: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    num: int = 10,
    den: int = 100,
    least_words: int = 20,
) -> DataFrame:
    """Every document with n_words, n_features, weight, score and, if drawn, its rank -> (id_col, `carry`, these).

    floor(num / den x N) documents of the N with at least `least_words` words are drawn by highest score; ties go to the smaller
    id, null ids last, then to the hash of the text, and repeated rows count one by one. Null and empty texts have no features
    and weight 0. With an empty target all gains come from the corpus alone; an empty table gives an empty result. Columns of
    docs that are not asked for are dropped, so their names cannot clash; a carried one must not have a name of the result.
    """
    clash = {*carry} & {id_col, "n_words", "n_features", "weight", "score", "rank", *KEY}
    if clash:
        raise ValueError(f"carried columns would clash: {sorted(clash)}")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gain = gains(bucket_counts(docs.select(text.alias("_text")), words, buckets), bucket_counts(target.select(text.alias("_text")), words, buckets))
    named = docs.select(F.col(id_col), *carry, F.xxhash64(F.col(id_col), text).alias("_hash"), F.col(id_col).cast("string").alias("_name"), text.alias("_text"))
    scored = _weighted(named, gain, words, seed).withColumns(
        {"_score": -F.col("score"), "_none": F.col(id_col).isNull(), "_id": F.col(id_col), "_row": F.monotonically_increasing_id()}
    )
    scored = keep(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = num * able.count() // den
    shown = [id_col, *carry, "n_words", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*shown, unranked)
    last = _literal(kth_key(able.select(*KEY), k, seed), scored)
    won = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= last)
    return ranked(scored.where(won), -(-k // RANK_ROWS)).select(*shown, "rank").unionAll(scored.where(~won).select(*shown, unranked))


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """`rank` from 1 in the order of KEY: ranges are sorted apart and written, then numbered on from the sizes of those before."""
    at = rows.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    at = at.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    at = keep(at, "ranges")
    sizes = sorted(at.groupBy("_part").count().collect())  # a row for each range
    before = np.cumsum([0, *[r["count"] for r in sizes]])
    base = at.sparkSession.createDataFrame([(r["_part"], int(b)) for r, b in zip(sizes, before, strict=False)], "_part int, _base long")
    return at.join(F.broadcast(base), "_part").withColumn("rank", F.col("_base") + F.col("_at") + 1)
