"""Benchmark decontamination: BM25 search of every training passage in an inverted index of the test items.

A passage is a window of words, twice as long as the longest item and half overlapping, so each item-long stretch lies in
one. Scores are shares of what the item scores against its own text; all items at or above a share are retrieved.
Postings carry the largest share of each block of items (block-max). A passage is dropped once the sum of its terms' largest
shares, over all blocks and then in each block, cannot reach the threshold; only blocks that can are scored in full. Hits
are verified by the words of the item's question and answer parts that common n-grams cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import keep, small_batches

K1, B = 1.2, 0.75
RETRIEVE = 0.5
NGRAM, QUESTION, ANSWER = 4, 0.8, 0.6
ANSWER_PART = 0.25
BLOCK_ITEMS, SHARD_ITEMS, SHARD_WORDS = 16, 4096, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[data]
    start, end, woff = A.words(low, off)
    return A.word_hash(low, start, end), woff


def _itemise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in A.blocks(batch["text"]):
            h, woff = _word_hashes(data, off)
            yield pa.RecordBatch.from_arrays([batch["item_id"].slice(lo, hi - lo), A.lists(A.signed(h), woff)], ["item_id", "words"])


class Index:
    """Inverted index of one shard of items; its size is bounded by SHARD_ITEMS and SHARD_WORDS."""

    def __init__(self, items: list[tuple[int, np.ndarray]], df: dict[int, int], n_items: int, mean_words: float):
        items = sorted(items, key=lambda i: (len(i[1]), i[0]))
        self.ids = np.array([i for i, _ in items])
        self.words = [w.view(np.uint64) for _, w in items]
        self.longest = max(len(w) for w in self.words)
        post = []
        for at, w in enumerate(self.words):
            t, tf = np.unique(w, return_counts=True)
            n = np.array([df[x] for x in A.signed(t).tolist()])
            share = np.log1p((n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_words))
            post.append((t, np.full(len(t), at), share / share.sum()))
        term, item, share = (np.concatenate(x) for x in zip(*post, strict=True))
        self.terms, number = np.unique(term, return_inverse=True)
        order = np.lexsort((item, number))
        self.item, self.share = item[order], share[order].astype(np.float32)
        self.first = np.searchsorted(number[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.share, self.first[:-1])
        cell = number[order] * (int(item.max()) // BLOCK_ITEMS + 1) + self.item // BLOCK_ITEMS
        self.cell, start = np.unique(cell, return_index=True)
        self.cell_most = np.maximum.reduceat(self.share, start)
        self.n_blocks = int(item.max()) // BLOCK_ITEMS + 1
        self.cell_first = np.searchsorted(self.cell, np.arange(len(self.terms) + 1) * self.n_blocks)
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.terms >> np.uint64(46)).astype(np.int64)] = True
        self.grams = [_grams(w) for w in self.words]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, term number) of the words that are in the index."""
        at = np.flatnonzero(self.sieve[(h >> np.uint64(46)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        hit = self.terms[place] == h[at]
        return at[hit], place[hit]

    def search(self, passage: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, share) of all pairs that reach `least`, from distinct terms sorted by passage."""
        limit = least - 1e-4  # sums of float32 shares
        n = int(passage[-1]) + 1 if len(passage) else 0
        able = np.bincount(passage, self.most[term], n) >= limit
        keep_it = able[passage]
        passage, term = passage[keep_it], term[keep_it]
        if not len(term):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        of, cell = _ranges(self.cell_first, term)
        block = passage[of] * self.n_blocks + self.cell[cell] % self.n_blocks
        able_blocks, number = np.unique(block, return_inverse=True)
        able_blocks = able_blocks[np.bincount(number, self.cell_most[cell]) >= limit]
        if not len(able_blocks):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        some = np.isin(passage, able_blocks // self.n_blocks)
        of, at = _ranges(self.first, term[some])
        own, item = passage[some][of], self.item[at]
        inside = np.isin(own * self.n_blocks + item // BLOCK_ITEMS, able_blocks)
        pair, number = np.unique(own[inside] * len(self.ids) + item[inside], return_inverse=True)
        total = np.bincount(number, self.share[at[inside]].astype(np.float64))
        good = total >= least - 1e-6
        return pair[good] // len(self.ids), pair[good] % len(self.ids), total[good]

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question words and answer words that n-grams of the passage cover."""
        own, g = self.words[item], min(NGRAM, len(self.words[item]))
        hit = np.isin(self.grams[item], _grams(passage, g))
        cover = np.zeros(len(own) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(hit), 1)
        np.add.at(cover, np.flatnonzero(hit) + g, -1)
        covered = np.cumsum(cover)[:-1] > 0
        cut = len(own) - max(1, round(ANSWER_PART * len(own))) if len(own) > 1 else 0
        return float(covered[:cut].mean()) if cut else 1.0, float(covered[cut:].mean())


def _grams(w: np.ndarray, g: int | None = None) -> np.ndarray:
    g = g or min(NGRAM, len(w))
    n = len(w) - g + 1
    return A.sequence_hash(A.run_of_words(w), np.arange(n), np.arange(n) + g) if n > 0 else np.zeros(0, np.uint64)


def _ranges(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its postings: (which of the terms, place)."""
    size = first[term + 1] - first[term]
    of = np.repeat(np.arange(len(term)), size)
    return of, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[term][of]


def _find(index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        half = ix.longest
        for batch in batches:
            for lo, hi, data, off in A.blocks(batch["text"]):
                h, woff = _word_hashes(data, off)
                at, term = ix.lookup(h)
                row = np.searchsorted(woff, at, side="right") - 1
                step = (at - woff[row]) // half
                # passage s of a text has its steps s and s + 1; numbers are unique over the block
                base = np.r_[0, np.cumsum((np.diff(woff) + half - 1) // half + 1)]
                own = np.r_[base[row] + step, base[row] + np.maximum(step - 1, 0)]
                both = np.unique(own * len(ix.terms) + np.r_[term, term])
                passage, item, share = ix.search(both // len(ix.terms), both % len(ix.terms), least)
                out = []
                for p, i, s in zip(passage.tolist(), item.tolist(), share.tolist(), strict=True):
                    r = int(np.searchsorted(base, p, side="right")) - 1
                    a = int(woff[r]) + (p - int(base[r])) * half
                    q, answer = ix.overlap(i, h[a : min(a + 2 * half, int(woff[r + 1]))])
                    out.append((lo + r, int(ix.ids[i]), a - int(woff[r]), s, q, answer))
                rows, ids, start, share, q, answer = zip(*out, strict=True) if out else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(start, pa.int64()), *(pa.array(x, pa.float64()) for x in (share, q, answer))],
                    ["doc_id", "item_id", "first_word", "bm25_share", "question_overlap", "answer_overlap"],
                )

    return run


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = RETRIEVE) -> DataFrame:
    """All verified occurrences of test items in documents, one row per (doc_id, item_id) with its best passage.

    Returns doc_id, item_id, first_word, bm25_share, question_overlap, answer_overlap. An item's last quarter of words is its
    answer. Items without words or with a null id or text are never found; items that repeat are found each. Null and empty
    documents match nothing. Rows that share a doc_id are reported together; null ids too. Other columns are not read.
    Items are searched in shards of bounded size, each of which is broadcast; statistics are those of all items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = items.selectExpr("CAST(item_id AS LONG) AS item_id", "CAST(text AS STRING) AS text").where("item_id IS NOT NULL").mapInArrow(_itemise, "item_id long, words array<long>")
    words = keep(words.where(F.size("words") > 0).distinct(), "benchmark-words")
    about = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("most")).first()
    schema = f"doc_id {kind}, item_id long, first_word long, bm25_share double, question_overlap double, answer_overlap double"
    if not about["n"]:
        return spark.createDataFrame([], schema)
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n_shards = -(-max(about["n"] * 5 // 4, about["n"] + 64) // SHARD_ITEMS) if about["n"] > SHARD_ITEMS else 1
    n_shards = max(n_shards, -(-int(about["n"] * about["mean"]) // SHARD_WORDS))
    hits = []
    for shard in range(n_shards):
        part = words.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == shard)
        own = part.collect()  # a bounded shard of test items, not of documents
        if not own:
            continue
        terms = part.select(F.explode("words").alias("term")).distinct().join(df, "term").collect()
        index = Index([(r["item_id"], np.array(r["words"], np.int64)) for r in own], {r["term"]: r["df"] for r in terms}, about["n"], about["mean"])
        hits.append(docs.mapInArrow(_find(spark.sparkContext.broadcast(index), least), schema))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionAll(more)
    sure = found.where((F.col("question_overlap") >= QUESTION) & (F.col("answer_overlap") >= ANSWER))
    best = F.max(F.struct(F.col("question_overlap") + F.col("answer_overlap"), "bm25_share", -F.col("first_word"), "question_overlap", "answer_overlap"))
    out = sure.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.col3")).alias("first_word"), "b.bm25_share", "b.question_overlap", "b.answer_overlap")
