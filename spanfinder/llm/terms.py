"""Hashed terms of texts, and fitting on a bounded sample of labelled rows.

A text's terms are its distinct runs of letters, digits and non-ASCII bytes, A-Z lower-cased, as 64-bit hashes. A model
keeps only terms whose presence goes with the label beyond chance (a G test), so what it learns is what labels have in common,
not the words of single documents. A model of pairs also keeps terms that go with the label where another term is present, as a
group's name may beside an insult, even if they do not go with it alone. Its size is bounded by the sample's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import keep

MOST_LABELLED = 24_000
MIN_TEXTS, SIGNIFICANT = 4, 16.0
PAIR_TERMS = 2048  # most frequent terms of the sample whose pairs are tested
SHARDS, ROUNDS, PASSES, BATCH = 4, 6, 5, 64
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(flags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of true bytes, cut at rows."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(flags) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(flags & (np.r_[True, ~flags[:-1]] | edge[:-1]))
    end = np.flatnonzero(flags & (np.r_[~flags[1:], True] | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def terms(data: np.ndarray, off: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the terms of all texts, repeats included. With `marks`, runs of other signs are terms as well."""
    low = _LOWER[data]
    run = A.prefix(low)
    core = _CORE[data]
    start, end, row = _runs(core, off)
    h = A.span_hash(run, start, end)
    if marks:
        s, e, r = _runs(~core & ~_SPACE[data], off)
        h, row = np.r_[h, A.span_hash(run, s, e)], np.r_[row, r]
    return h, row


class Vocabulary:
    """Sorted term hashes with a small filter in front; `find` drops unknown terms and repeats within a row."""

    def __init__(self, h: np.ndarray):
        self.h = np.sort(h)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.h >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, row), distinct, by row."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        h, row = h[at], row[at]
        place = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[place] == h
        both = np.unique(row[hit] * len(self.h) + place[hit])
        return both % len(self.h), both // len(self.h)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, learn: str, most: int) -> DataFrame:
    """(text, y, h) of about `most` labelled rows at the utmost, drawn by hash; labels that contradict each other are left out."""
    known = labels.selectExpr("doc_id", f"CAST({grade} AS INT) AS y").where(f"doc_id IS NOT NULL AND y IS NOT NULL AND {learn}")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").drop("y1")
    known = known.withColumn("h", F.xxhash64("doc_id"))
    n = known.count()
    drawn = known.where(F.pmod("h", F.lit(1 << 30)) < min(1.0, most / max(n, 1)) * (1 << 30))
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # `most` rows, three numbers each
    once = found.groupBy(F.md5(F.col("text").cast("binary")).alias("m"), "y").agg(F.min("h").alias("h"))  # copies teach once
    return found.join(once.select("m", "h"), "h").dropDuplicates(["h"]).select("text", "y", "h")


def _g_test(counts: dict[int, int]) -> Column:
    """G statistic of a term's presence against the label, from columns n and n<label>."""
    total, terms = sum(counts.values()), [F.lit(0.0)]
    for y, m in counts.items():
        for have, all_ in ((F.col(f"n{y}"), F.col("n")), (m - F.col(f"n{y}"), total - F.col("n"))):
            terms.append(F.when(have > 0, 2 * have * F.log(have * total / (all_ * float(m)))).otherwise(0.0))
    return sum(terms[1:], terms[0])


def _pair_terms(rows: DataFrame, known: DataFrame, classes: list[int]) -> np.ndarray:
    """Terms among the PAIR_TERMS most frequent that go with the label in the texts that have some other term.

    Each part of the sample counts its texts by (term, other term, label) as products of its incidence matrix; the counts are added
    up per term. The bar rises with the number of pairs tested, so that chance alone hardly ever passes it.
    """
    often = known.where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "t").limit(PAIR_TERMS).select("t").toArrow()["t"].to_numpy()
    frequent = Vocabulary(often.astype(np.int64).view(np.uint64))
    size = len(frequent.h)
    bar = SIGNIFICANT + 4 * np.log(max(size, 1))
    given = rows.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(classes), size, size), np.float32)  # exact below 2^24 texts
        for batch in batches:
            lists = batch["terms"]
            off = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
            term, doc = given.value.find(values, A.rows_of(off - off[0]))
            present, y = np.zeros((batch.num_rows, size), np.float32), batch["y"].to_numpy()
            present[doc, term] = 1
            for i, c in enumerate(classes):
                own = present[y == c]
                both[i] += own.T @ own
        for term in range(size):
            counts = both[:, term].astype(np.int32)
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([term], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["term", "counts"])

    def test(group: pa.Table) -> pa.Table:
        term = group["term"][0].as_py()
        n = sum(np.frombuffer(c.as_py(), np.int32).astype(np.float64) for c in group["counts"]).reshape(len(classes), size)
        mine = n[:, term]  # texts with the term, by label
        texts, total = n.sum(0), mine.sum()
        g = np.zeros(size)
        with np.errstate(divide="ignore", invalid="ignore"):
            for own, m in zip(n, mine, strict=True):
                for have, all_ in ((own, texts), (m - own, total - texts)):
                    g += np.where(have > 0, 2 * have * np.log(have * total / (all_ * m)), 0.0)
        return pa.table({"other": pa.array(np.flatnonzero(g >= bar).astype(np.int32))})

    counted = rows.withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int")).repartitionByRange(SHARDS, "shard").select("y", "terms").mapInArrow(count, "term int, counts binary")
    found = counted.groupBy("term").applyInArrow(test, "other int").distinct().toArrow()["other"].to_numpy()  # PAIR_TERMS rows at most
    return frequent.h[found]


def fit(sample: DataFrame, start: Callable[[int, np.ndarray], dict], step: Callable, marks: bool, extra: Callable | None = None, pairs: bool = False) -> tuple[Vocabulary, dict]:
    """Fit by stochastic gradients on SHARDS parts of the sample at once, averaging the parts' parameters after each round.

    `start(terms, y counts)` gives the first parameters; `step(params, term, doc, y)` changes them by a batch of documents.
    With `pairs`, terms that go with the label beside another term are kept as well.
    """
    spark = sample.sparkSession

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in A.blocks(batch["text"]):
                h, row = terms(data, off, marks)
                if extra:
                    h, row = (np.r_[x, y] for x, y in zip((h, row), extra(data, off, h, row), strict=True))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
                at = np.searchsorted(row[once], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch["h"].slice(lo, hi - lo), batch["y"].slice(lo, hi - lo), A.lists(A.signed(h[once]), at)], ["h", "y", "terms"])

    rows = keep(sample.mapInArrow(featured, "h long, y int, terms array<long>"), "labelled")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    known = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), *(F.sum((F.col("y") == y).cast("long")).alias(f"n{y}") for y in counts))
    alone = known.where((F.col("n") >= MIN_TEXTS) & (_g_test(counts) >= SIGNIFICANT)).select("t").toArrow()
    kept = alone["t"].to_numpy().astype(np.int64).view(np.uint64)
    if pairs and counts:
        kept = np.union1d(kept, _pair_terms(rows, known, sorted(counts)))
    vocabulary = Vocabulary(kept)
    params = start(len(vocabulary.h), counts)
    names = sorted(params)
    shards = rows.withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int"))
    given = spark.sparkContext.broadcast(vocabulary)
    for turn in range(ROUNDS if counts else 0):
        now = spark.sparkContext.broadcast(params)

        def train(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if table is None or not table.num_rows:
                return
            own = {k: v.copy() for k, v in now.value.items()}
            lists = table["terms"].combine_chunks()
            row = A.rows_of(lists.offsets.to_numpy().astype(np.int64))
            term, doc = given.value.find(lists.values.to_numpy().view(np.uint64), row)
            y, off = table["y"].to_numpy(), np.searchsorted(doc, np.arange(table.num_rows + 1))
            # the order depends on content, not on which task wrote which row
            by_content, rng = np.argsort(table["h"].to_numpy(), kind="stable"), np.random.default_rng(turn)
            for _ in range(PASSES):
                for at in np.array_split(rng.permutation(by_content), max(1, table.num_rows // BATCH)):
                    own_terms = [term[off[d] : off[d + 1]] for d in at]
                    step(own, np.concatenate(own_terms), np.repeat(np.arange(len(at)), [len(x) for x in own_terms]), y[at])
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64()), *(pa.array([own[k].astype(np.float32).tobytes()], pa.binary()) for k in names)], ["n", *names])

        parts = shards.repartitionByRange(SHARDS, "shard").select("h", "y", "terms").mapInArrow(train, ", ".join(["n long", *(f"{k} binary" for k in names)])).collect()  # SHARDS rows
        total = sum(p["n"] for p in parts)
        params = {k: sum(np.frombuffer(p[k], np.float32).astype(np.float64) * (p["n"] / total) for p in parts).reshape(params[k].shape) for k in names}
    return vocabulary, params


def apply(docs: DataFrame, vocabulary: Vocabulary, score: Callable, columns: str, marks: bool, extra: Callable | None = None) -> DataFrame:
    """doc_id and the columns that `score(term, doc, n)` gives for every whole text."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in A.blocks(batch["text"]):
                h, row = terms(data, off, marks)
                if extra:
                    h, row = (np.r_[x, y] for x, y in zip((h, row), extra(data, off, h, row), strict=True))
                out = score(*given.value.find(h, row), hi - lo)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *(pa.array(x) for x in out)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")
