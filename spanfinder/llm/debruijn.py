"""Repeated word spans, found by compacting the de Bruijn graph of the corpus.

An edge is a window of k words. Edges that follow each other in a text and share their minimizer (the least m-word hash in
the window) form a path piece. All occurrences of an edge have the same minimizer, so occurrences meet by joining on it:

* where every piece at a minimizer has the same words, the path there does not branch; it stays one row per text;
* where pieces differ, a text enters, leaves or varies, so the path branches there and is split into its edges.

Each path or edge keeps as its source the smallest id that has it. A text then checks its own edges against the rows
that name it, by content hash and coordinate, and joins those that touch into long spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .bitmaps import among, bitmap_of
from .tables import keep, small_batches

K, M = 20, 8
LAST = (1 << 63) - 1


class Paths:
    """Edges of a block of texts and the path pieces they form."""

    def __init__(self, data: np.ndarray, off: np.ndarray, k: int, m: int):
        self.start, self.end, self.woff = A.words(data, off)
        h = A.word_hash(data, self.start, self.end)
        self.run, self.k = A.run_of_words(h), k
        self.edge = A.starts_of(self.woff, k)
        self.row = A.rows_of(self.woff)[self.edge]
        if not len(self.edge):
            self.first = self.last = self.h = self.piece = np.zeros(0, np.int64)
            return
        grams = A.sequence_hash(self.run, np.arange(len(h) - m + 1), np.arange(m, len(h) + 1))
        at = A.minimizers(grams, k - m + 1)[self.edge]
        new = np.r_[True, (at[1:] != at[:-1]) | (self.edge[1:] != self.edge[:-1] + 1) | (self.row[1:] != self.row[:-1])]
        self.piece = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.last = np.r_[self.first[1:], len(new)] - 1
        self.at, self.h = at[self.first], grams[at[self.first]]

    def content(self) -> np.ndarray:
        """Hash of each piece's words and of the minimizer's place in it."""
        lo, hi = self.edge[self.first], self.edge[self.last] + self.k
        return A.mix(A.sequence_hash(self.run, lo, hi) ^ A.mix((self.at - lo).astype(np.uint64)))

    def edges(self) -> np.ndarray:
        return A.sequence_hash(self.run, self.edge, self.edge + self.k)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).cast("string").alias("text"))


def _pieces(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc"].to_numpy()
            for lo, _, data, off in A.blocks(batch["text"]):
                p = Paths(data, off, k, m)
                s = p.content() if len(p.first) else np.zeros(0, np.uint64)
                row = p.row[p.first]
                once = A.row_first(s, row)
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(p.h[once].astype(np.uint64))), pa.array(A.signed(s[once])), pa.array(ids[lo + row[once]])], ["h", "s", "doc"])

    return run


def _candidates(k: int, m: int, whole, split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc"].to_numpy()
            for lo, _, data, off in A.blocks(batch["text"]):
                p = Paths(data, off, k, m)
                if not len(p.first):
                    continue
                hit = among(whole.value, p.h)
                row = p.row[p.first][hit]
                h = p.h[hit]
                once = A.row_first(h, row)
                e = among(split.value, p.h)[p.piece]
                w, wrow = p.edges()[e], p.row[e]
                wonce = A.row_first(w, wrow)
                h, w = h[once], w[wonce]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([False, True], [len(h), len(w)])),
                        pa.array(A.signed(np.r_[h, w])),
                        pa.array(ids[lo + np.r_[row[once], wrow[wonce]]]),
                    ],
                    ["edge", "h", "doc"],
                )

    return run


def _cut(k: int, m: int):
    """Words of each text that a repeated edge covers, and the rest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests, spans, n_words, n_removed = [], [], [], []
            found = batch["found"]
            foff = found.offsets.to_numpy().astype(np.int64)
            item = found.values
            f_edge, f_h, f_src = (item.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            some = ~found.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, off in A.blocks(batch["text"]):
                p = Paths(data, off, k, m)
                edges = p.edges() if len(p.edge) else np.zeros(0, np.uint64)
                gone = ~A.row_first(edges, p.row)
                src = np.where(gone, batch["doc"].to_numpy()[lo + p.row], LAST) if len(edges) else np.zeros(0, np.int64)
                eoff = np.searchsorted(p.row, np.arange(hi - lo + 1))
                poff = np.searchsorted(p.row[p.first], np.arange(hi - lo + 1)) if len(edges) else np.zeros(hi - lo + 1, int)
                for i in range(hi - lo):
                    a, b = foff[lo + i], foff[lo + i + 1]
                    if not some[lo + i] or a == b or eoff[i] == eoff[i + 1]:
                        continue
                    of = f_edge[a:b]
                    for own, named in ((p.h[poff[i] : poff[i + 1]], ~of), (edges[eoff[i] : eoff[i + 1]], of)):
                        keys, sources = f_h[a:b][named].view(np.uint64), f_src[a:b][named]
                        if not len(keys):
                            continue
                        order = np.argsort(keys)
                        keys, sources = keys[order], sources[order]
                        where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        hit, source = keys[where] == own, sources[where]
                        if named is not of:
                            local = p.piece[eoff[i] : eoff[i + 1]] - poff[i]
                            hit, source = hit[local], source[local]
                        at = slice(eoff[i], eoff[i + 1])
                        gone[at] |= hit
                        src[at] = np.where(hit, np.minimum(src[at], source), src[at])
                cover = np.zeros(len(p.start) + 1, np.int64)
                np.add.at(cover, p.edge[gone], 1)
                np.add.at(cover, p.edge[gone] + k, -1)
                dead = np.cumsum(cover)[:-1] > 0
                raw = data.tobytes()
                for i in range(hi - lo):
                    a, b = p.woff[i], p.woff[i + 1]
                    d = dead[a:b]
                    word = raw[off[i] : off[i + 1]].split()
                    n_words.append(b - a)
                    n_removed.append(int(d.sum()))
                    own = []
                    if n_removed[-1]:
                        e = slice(eoff[i], eoff[i + 1])
                        starts, sources = p.edge[e][gone[e]] - a, src[e][gone[e]]
                        new = np.flatnonzero(np.r_[True, (starts[1:] > starts[:-1] + k) | (sources[1:] != sources[:-1])])
                        last = np.r_[new[1:], len(starts)] - 1
                        own = [{"start": int(starts[x]), "end": int(starts[y]) + k, "source": int(sources[x])} for x, y in zip(new, last, strict=True)]
                        word = [word[j] for j in np.flatnonzero(~d)]
                    rests.append(b" ".join(word).decode())
                    spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(rests, pa.string()), pa.array(spans, kind)], ["doc", "n_words", "n_removed", "rest", "spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """Every text without the words that lie in a window of `k` words which starts earlier as well.

    Earlier is a smaller id, or an earlier place in the same text. Returns doc_id, n_words, n_removed, rest (kept words
    joined by one space) and spans (word ranges with the smallest id that has their windows). Null texts have no words. A
    null id counts as larger than all others. Rows that share an id do not remove each other's words. Other columns are
    not read. An empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col)
    pieces = texts.mapInArrow(_pieces(k, m), "h long, s long, doc long")
    paths = keep(
        pieces.groupBy("h")
        .agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("doc").alias("source"), F.max("doc").alias("last"))
        .where("source < last")
        .select("h", "source", (F.col("s0") == F.col("s1")).alias("whole")),
        "debruijn-paths",
    )
    whole, branching = paths.where("whole"), paths.where("NOT whole")
    named = keep(texts.mapInArrow(_candidates(k, m, bitmap_of(whole, "h"), bitmap_of(branching, "h")), "edge boolean, h long, doc long"), "debruijn-named")
    edges = named.where("edge")
    shared = keep(edges.groupBy("h").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source < last").drop("last"), "debruijn-edges")
    later = [
        rows.join(sources, "h").where("doc > source").select("doc", F.struct("edge", "h", "source").alias("f"))
        for rows, sources in ((named.where("NOT edge"), whole.select("h", "source")), (edges, shared))
    ]
    found = later[0].unionAll(later[1]).groupBy("doc").agg(F.collect_list("f").alias("found"))
    cut = texts.join(found, "doc", "left").mapInArrow(_cut(k, m), "doc long, n_words long, n_removed long, rest string, spans array<struct<start:int,end:int,source:long>>")
    return cut.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "rest", "spans")
