"""Quality rules: statistics that rules use, an isolation forest over them, and a threshold from labelled rows.

Each tree isolates a sample of PSI documents by random splits of random statistics. A document that few splits set apart,
averaged over all trees, is anomalous. Trees are grown by separate Spark tasks from separate samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import keep, small_batches

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30

TREES, PSI, DEPTH = 96, 256, 8
KEEP_GOOD = 0.995
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_odd_ends"]
FEATURES = ["word_length", "symbols", "line_words", "distinct", "odd_ends"]
CLEAR = 0.25  # a share from which a statistic counts as plain

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_ODD = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!~^=+_@\\/{}[]", np.uint8))


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][off])


def statistics(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of every text, exact."""
    start, end, woff = A.words(data, off)
    n_words = np.diff(woff)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    in_word = np.cumsum(inside)[:-1] > 0
    word_chars = _per_row(in_word & ((data & 0xC0) != 0x80), off)
    run = A.prefix(data)
    h = A.span_hash(run, start, end)
    row = A.rows_of(woff)
    first, w = A.windows(h, woff, WINDOW)
    wrow = row[first]
    order = np.lexsort((w, wrow))
    same = (w[order][1:] == w[order][:-1]) & (wrow[order][1:] == wrow[order][:-1])
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    n_repeat = _per_row(np.cumsum(cover)[:-1] > 0, woff)
    # lines: each text is cut at its line feeds; lines without a word do not count as repeats
    cut = np.flatnonzero(data == 10)
    crow = np.searchsorted(off, cut, side="right") - 1
    lrow = np.sort(np.r_[np.arange(len(off) - 1), crow], kind="stable")
    lstart = np.sort(np.r_[off[:-1], cut + 1], kind="stable")
    lend = np.sort(np.r_[off[1:], cut], kind="stable")
    has_word = np.searchsorted(start, lend) > np.searchsorted(start, lstart)
    again = has_word & ~A.row_first(A.span_hash(run, lstart, lend), lrow)
    dups = np.bincount(lrow[again], minlength=len(off) - 1)
    lines = np.bincount(lrow[has_word], minlength=len(off) - 1)
    distinct = np.bincount(row[A.row_first(h, row)], minlength=len(off) - 1)
    odd = _per_row(_ODD[data[end - 1]] if len(end) else np.zeros(0, bool), woff)
    return [n_words, word_chars, _per_row(_SYMBOL[data], off), dups, n_repeat, lines, distinct, odd]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in A.blocks(batch["text"]):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in statistics(data, off))], ["doc_id", *COUNTS])


def _features(c: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of each row; shares beyond CLEAR count alike, so that a split at random parts plain cases from the crowd."""
    n, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    shares = {"symbols": c["n_symbols"] / n, "odd_ends": c["n_odd_ends"] / n}
    rest = {"word_length": c["word_chars"] / n, "line_words": np.log1p(n / lines), "distinct": c["n_distinct"] / n * (1 + np.log1p(n)) / 8}
    return np.stack([np.minimum(shares[f], CLEAR) if f in shares else rest[f] for f in FEATURES], 1)


def _depth_left(n: float) -> float:
    """Mean depth of an unsuccessful search among n points: what a tree leaves unsplit."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(group: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree as node arrays, from at most PSI rows of its sample."""
    group = group.sort_values("draw").head(PSI)
    x = _features({c: group[c].to_numpy() for c in COUNTS})
    rng = np.random.default_rng(int(group["tree"].iloc[0]))
    feature, value, left, depth = [-1], [0.0], [0], [0.0]
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, rows, d = open_nodes.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        free = np.flatnonzero(high > low)
        if d == DEPTH or len(rows) < 2 or not len(free):
            depth[node] = d + _depth_left(len(rows))
            continue
        f = int(rng.choice(free))
        at = rng.uniform(low[f], high[f])
        feature[node], value[node], left[node] = f, at, len(feature)
        small = x[rows, f] < at
        for side in (rows[small], rows[~small]):
            open_nodes.append((len(feature), side, d + 1))
            feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
            if not len(side):
                open_nodes.pop()
                depth[-1] = d + 1
    return pd.DataFrame({"tree": group["tree"].iloc[:1], "n": [len(x)], "feature": [feature], "value": [value], "left": [left], "depth": [depth]})


def scores(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """2 ** -(mean path length / expected length): near 1 for anomalies, under 0.5 for the crowd."""
    total = np.zeros(len(x))
    for t in trees:
        feature, value, left, depth = (np.asarray(t[k]) for k in ("feature", "value", "left", "depth"))
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            inner = f >= 0
            step = left[node] + (x[np.arange(len(x)), np.maximum(f, 0)] >= value[node])
            node = np.where(inner, step, node)
        total += depth[node] / max(_depth_left(t["n"]), 1.0)
    return 2.0 ** -(total / max(len(trees), 1))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every whole text; null texts have no words."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_measure, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS)]))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_good: float = KEEP_GOOD) -> DataFrame:
    """Rule statistics, anomaly score and verdict of every document.

    Each of TREES trees is fitted on PSI documents, drawn by hash from all. The threshold is the least score that
    keeps `keep_good` of the rows labelled quality = 1 that pass the base rules, and among thresholds at or above it the one
    with the largest gap between the shares of low- and good-quality rows caught. Without labels of both kinds nothing is
    anomalous. Returns doc_id, COUNTS, base_failed, anomaly (double) and kept. Rows with a null or repeated id are kept as
    rows; labels that are null or contradict each other are not used. Empty tables give empty results.
    """
    counts = keep(measure(docs, id_col, text_col), "rule-counts")
    n = counts.count()
    limit = np.uint64(min(1.0, 1.25 * PSI / max(n, 1)) * (2**63 - 1024) * 2)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].to_numpy().view(np.uint64)
            for tree in range(TREES):
                u = A.mix(h ^ A.mix(np.array([tree + 1], np.uint64)))
                at = pa.array(np.flatnonzero(u <= limit))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(A.signed(u)).take(at), *(batch[c].take(at) for c in COUNTS)], ["tree", "draw", *COUNTS])

    longs = ", ".join(f"{c} long" for c in COUNTS)
    drawn = counts.withColumn("h", F.xxhash64("doc_id", *COUNTS)).drop("doc_id").mapInArrow(draw, f"tree int, draw long, {longs}")
    schema = "tree int, n int, feature array<int>, value array<double>, left array<int>, depth array<double>"
    trees = [r.asDict() for r in drawn.groupBy("tree").applyInPandas(_grow, schema).collect()]  # at most TREES rows
    forest = docs.sparkSession.sparkContext.broadcast(sorted(trees, key=lambda t: t["tree"]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features({c: batch[c].to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(x, forest.value))], [*batch.schema.names, "anomaly"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rated = keep(counts.mapInArrow(rate, f"{kinds}, anomaly double").withColumn("base_failed", failed), "rule-scores")
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("q")).where("doc_id IS NOT NULL AND q IN (0, 1)").groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("q1")).where("q = q1").drop("q1")
    bins = rated.where("NOT base_failed").join(known, "doc_id").groupBy("q", F.floor(F.col("anomaly") * 2000).alias("bin")).count().collect()  # at most 4 000 rows
    limit = threshold([(r["q"], r["bin"], r["count"]) for r in bins], keep_good)
    return rated.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * 2000) < limit))


def threshold(bins: list[tuple[int, int, int]], keep_good: float) -> int:
    """First bin that is anomalous."""
    good, bad = np.zeros(2002), np.zeros(2002)
    for q, at, n in bins:
        (good if q else bad)[at] += n
    if not good.sum() or not bad.sum():
        return 2001
    kept = np.r_[0, np.cumsum(good)] / good.sum()
    caught = 1 - np.r_[0, np.cumsum(bad)] / bad.sum()
    fit = np.where(kept >= keep_good, kept + caught, -1)
    return int(np.argmax(fit))
