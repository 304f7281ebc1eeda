"""Full-text matching of a table of queries against a table of texts.

rank = 0.1 x matching positions (an exact phrase counts once per adjacent match), score = rank / (rank + 1).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.fixed_values import TERM
from ..functions.text import SUFFIXES, stem, term_tokens
from .sizing import BROADCAST_ROWS, at_most, lookup_join
from .topk import best_first, topk

POSITION_WEIGHT = 0.1
COUNTS_HELD = 1 << 19  # counts of (text, query) that a task holds at once
TOKENS_HELD = 1 << 16  # stripped tokens that a task remembers, whatever the vocabulary
TEXTS_HELD = 64  # texts that a task has as Python strings; the rest of a batch stays in Arrow
MARKS = ".'-"  # stripped from the end of a token
_STRIPPED = re.compile(f"{TERM}(?<![{MARKS}])")


def query_items(plans: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    """One row per token of every search item: (query_id, item, width, at, token).

    A term is an item of width 1, a phrase an item of as many adjacent tokens.
    """
    term_items = F.transform("terms", lambda t: F.array(normalise(t)))
    phrase_items = F.transform("phrases", lambda p: F.transform(term_tokens(p), normalise))
    items = F.filter(F.array_distinct(F.concat(term_items, phrase_items)), lambda i: F.size(i) > 0)
    return (
        plans.select("query_id", F.posexplode(items).alias("item", "tokens"))
        .select("query_id", "item", F.size("tokens").alias("width"), F.posexplode("tokens").alias("at", "token"))
    )


def lexical_hits(items: DataFrame, texts: DataFrame, text: str, normalise: Callable[[Column], Column]) -> DataFrame:
    """All matching (query_id, segment_id, score).

    The query vocabulary is broadcast when its size is checked, so documents are scanned once and only
    matches, already counted per document in the scanning task, are shuffled.
    """
    # trimming and stemming happen on exploded rows, inside generated code
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))
    plain = normalise(F.rtrim(F.col("token"), F.lit(".'-")))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("width"), F.lit(0)).alias("w")).first()
    is_small = size["n"] <= BROADCAST_ROWS
    single = items.filter("width = 1").select("query_id", "token")
    # term frequency per document, inside the row: no shuffle before the match
    located = texts.select("segment_id", F.explode(tokens).alias("token")).withColumn("token", plain)
    counted = lookup_join(located, single, ["token"], ["segment_id"], is_small).groupBy("query_id", "segment_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    if size["w"] > 1:
        wide = items.filter("width > 1")
        placed = texts.select("segment_id", F.posexplode(tokens).alias("pos", "token")).withColumn("token", plain)
        # tokens of one adjacent match share the same start position
        starts = (
            lookup_join(placed, wide, ["token"], ["segment_id"], is_small)
            .groupBy("query_id", "segment_id", "item", "width", (F.col("pos") - F.col("at")).alias("start"))
            .agg(F.count(F.lit(1)).alias("m"))
            .filter("m = width")
        )
        adjacent = starts.groupBy("query_id", "segment_id").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(adjacent).groupBy("query_id", "segment_id").agg(F.sum("n").alias("n"))
    rank = F.col("n") * POSITION_WEIGHT
    return counted.select("query_id", "segment_id", (rank / (rank + 1)).alias("score"))


class _Vocabulary:
    """Tokens of a table of queries: which queries a token belongs to, and the phrases that start with it."""

    def __init__(self, rows: list, suffixes: Sequence[str], allowed: dict | None, ids: Sequence = ()):
        self.ids = sorted({r["query_id"] for r in rows} | set(ids))
        place = {q: i for i, q in enumerate(self.ids)}
        single: dict[str, set[int]] = {}
        wide: dict[tuple[int, int], list[str]] = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            if r["width"] == 1:
                single.setdefault(r["token"], set()).add(place[r["query_id"]])
            else:
                wide.setdefault((place[r["query_id"]], r["item"]), []).append(r["token"])
        self.single = {t: np.array(sorted(q)) for t, q in single.items()}
        self.phrases: dict[str, list[tuple[int, list[str]]]] = {}
        for (q, _), tokens in sorted(wide.items()):
            self.phrases.setdefault(tokens[0], []).append((q, tokens))
        self.suffixes = suffixes
        self.allowed = None if allowed is None else {v: np.array(sorted(place[q] for q in qs if q in place), np.int64) for v, qs in allowed.items()}
        self.known: dict[str, str] = {}
        # every spelling without marks at its end that is stripped to a token of the queries
        self.spelt = {w: t for t in {*self.single, *self.phrases} for w in (t, *(t + s for s in suffixes)) if self.plain(w) == t}
        self.known = {}

    def plain(self, raw: str) -> str:
        found = self.known.get(raw)
        if found is None:
            found = raw.rstrip(MARKS)
            for s in self.suffixes:
                if found.endswith(s) and len(found) >= len(s) + 3:
                    found = found[: -len(s)]
                    break
            if len(self.known) >= TOKENS_HELD:
                self.known.clear()
            self.known[raw] = found
        return found

    def visible(self, videos: list) -> np.ndarray:
        """Which queries may see a text of each of these videos."""
        seen = np.zeros((len(videos), len(self.ids)), bool)
        for i, v in enumerate(videos):
            seen[i, self.allowed.get(v, ())] = True
        return seen

    def counts(self, text: str) -> np.ndarray:
        """Matching positions of every query in a lower-cased text."""
        n = np.zeros(len(self.ids), np.int64)
        met = Counter(self.met(text))
        single = [t for t in met if t in self.single]
        if single:  # once a text, not once a token
            asked = [self.single[t] for t in single]
            n += np.bincount(np.concatenate(asked), np.repeat([met[t] for t in single], [len(q) for q in asked]), len(n)).astype(np.int64)
        if not self.phrases.keys().isdisjoint(met):
            n += self.phrase_counts(text)
        return n

    def asked(self, string: str) -> tuple[np.ndarray, bool] | None:
        """Queries with the tokens of a string, once a token, and whether a phrase begins with one; None if it has no token of the queries."""
        met = self.met(string)
        if not met:
            return None
        queries = [self.single[t] for t in met if t in self.single]
        return np.concatenate(queries) if queries else np.empty(0, np.int64), not self.phrases.keys().isdisjoint(met)

    def met(self, text: str) -> list[str]:
        """Tokens of the queries in a lower-cased text."""
        return [t for t in map(self.spelt.get, _STRIPPED.findall(text)) if t is not None]

    def phrase_counts(self, text: str) -> np.ndarray:
        n = np.zeros(len(self.ids), np.int64)
        tokens = [self.plain(t) for t in _STRIPPED.findall(text)]
        for i, t in enumerate(tokens):
            for q, wanted in self.phrases.get(t, ()):
                n[q] += tokens[i : i + len(wanted)] == wanted
        return n


def few_texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row, texts from there on), a few texts at a time."""
    for at in range(0, len(batch), TEXTS_HELD):
        yield at, batch[column].slice(at, TEXTS_HELD).to_pylist()


class Leaders:
    """The best k rows per query that a task has met, ties to the smaller segment."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.most = k, max(10_000, 2 * k * n_queries)
        self.held: list[pd.DataFrame] = []
        self.size = 0
        self.floor = np.zeros(n_queries)  # scores below cannot be among the best; it may lag behind

    def raise_floor(self, scores: np.ndarray) -> None:
        """Scores that rows to come have at least."""
        if len(scores) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])

    def offer(self, segments: np.ndarray, scores: np.ndarray) -> None:
        """Scores of rows (texts x queries); 0 is no match."""
        keep = (scores > 0) & (scores >= self.floor)
        if len(scores) > self.k:  # below the k-th of these rows
            keep &= scores >= np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        d, q = np.nonzero(keep)
        self.held.append(pd.DataFrame({"q": q, "segment_id": segments[d], "score": scores[d, q]}))
        self.size += len(d)
        if self.size > self.most:
            self.rows()

    def rows(self) -> pd.DataFrame:
        every = pd.concat(self.held).sort_values(["q", "score", "segment_id"], ascending=[True, False, True])
        nth = every.groupby("q").cumcount()
        last = every[nth == self.k - 1]
        of = last["q"].to_numpy()
        self.floor[of] = np.maximum(self.floor[of], last["score"].to_numpy())
        found = every[nth < self.k]
        self.held, self.size = [found], len(found)
        return found


def lexical_topk(items: DataFrame, texts: DataFrame, text: str, k: int, suffixes: Sequence[str], scope: DataFrame | None = None) -> DataFrame | None:
    """Best k (query_id, segment_id, score) per query, or None if the queries or their scopes are too many to hold.

    Every text is counted where it is read, and a task sends its k best per query; no pair is shuffled before that. With `scope`
    (query_id, video_id) a text, which then has a video_id, is matched with the queries that may see it only.
    """
    if not at_most(items, BROADCAST_ROWS) or scope is not None and not at_most(scope, BROADCAST_ROWS):
        return None
    allowed = None
    if scope is not None:
        allowed = {}
        for r in scope.select("query_id", "video_id").distinct().collect():
            allowed.setdefault(r["video_id"], set()).add(r["query_id"])
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(_Vocabulary(items.collect(), suffixes, allowed))
    rows = texts.select("segment_id", *(["video_id"] if scope is not None else []), F.lower(F.col(text)).alias("_text")).filter(F.length("_text") > 0)
    ids = to_arrow_type(items.schema["query_id"].dataType)
    out = T.StructType([items.schema["query_id"], rows.schema["segment_id"], T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        best = Leaders(len(words.ids), k)
        schema = None
        for batch in batches:
            schema = schema or batch.schema
            step = max(k + 1, COUNTS_HELD // max(1, len(words.ids)))
            for part in (batch.slice(at, step) for at in range(0, len(batch), step)):
                counts = np.zeros((len(part), len(words.ids)), np.int64)
                for at, texts in few_texts(part, "_text"):
                    for i, text in enumerate(texts, at):
                        counts[i] = words.counts(text)
                if words.allowed is not None:
                    counts[~words.visible(part["video_id"].to_pylist())] = 0
                best.offer(part["segment_id"].to_numpy(zero_copy_only=False), counts)
        if schema is not None:
            found = best.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array([words.ids[i] for i in found["q"]], ids), pa.array(found["segment_id"], schema.field("segment_id").type), pa.array(found["score"], pa.int64())],
                names=out.names,
            )

    rank = F.col("n") * POSITION_WEIGHT
    found = rows.mapInArrow(run, out).select("query_id", "segment_id", (rank / (rank + 1)).alias("score"))
    return topk(found, ["query_id"], best_first(), k)


def lexical_lane(plans: DataFrame, segments: DataFrame, k: int, text: str = "text", scope: DataFrame | None = None) -> DataFrame:
    """Stemmed OR query of terms and phrases; a query without either yields nothing. `scope` holds (query_id, video_id)."""
    items = query_items(plans, stem)
    found = lexical_topk(items, segments, text, k, SUFFIXES, scope)
    if found is not None:
        return found
    hits = lexical_hits(items, segments, text, stem)
    if scope is not None:
        hits = hits.join(segments.select("segment_id", "video_id"), "segment_id")
        hits = hits.join(scope.select("query_id", "video_id").distinct(), ["query_id", "video_id"], "left_semi").drop("video_id")
    return topk(hits, ["query_id"], best_first(), k)
