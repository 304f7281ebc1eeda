"""Keyphrases of a table of texts: frequent n-grams, diversified by similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..operators.lexical import few_texts
from ..operators.encoders import Encoder, HashingEncoder
from ..operators.pooling import mean_pool
from ..operators.topk import topk
from ..session import cut_lineage

MAX_CANDIDATES = 200
PHRASES_HELD = 1 << 16  # phrases that a task gathers, and those of one more text, before they leave it
_TOKEN = re.compile(V.PHRASE_TOKEN)


def phrase_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(V.PHRASE_TOKEN), F.lit(0))


def ngram_counts(texts: DataFrame, key: list[str], tokens: Column, starts: Column | None = None, max_n: int = 3) -> DataFrame:
    """Counts of the admissible 1..3-grams per key; partial counts combine before the shuffle.

    `starts` limits where a gram may begin, so that a piece may carry the first tokens of the next one. A row is made for every
    place where one may begin, with the tokens that follow; texts are spread first, as that is most of the work.
    """
    d = texts.select(*key, tokens.alias("_t"), (F.size(tokens) if starts is None else starts).alias("_s")).filter("_s > 0")
    words = [f"_{i}" for i in range(max_n)]
    shifted = [F.slice("_t", i + 1, F.col("_s")).alias(w) for i, w in enumerate(words)]
    places = d.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select(*key, F.inline(F.arrays_zip(*shifted)).alias(*words))
    edge = lambda w: (F.length(w) >= 3) & ~F.col(w).isin(list(V.PHRASE_STOP_WORDS))
    grams, inner = [F.when(F.length("_0") >= 4, F.col("_0"))], F.lit(True)
    for i, w in enumerate(words[1:], 1):
        fresh = F.length(w) >= 3
        for earlier in words[:i]:
            fresh = fresh & (F.col(w) != F.col(earlier))
        inner = inner & fresh
        grams.append(F.when(inner & edge(w), F.concat_ws(" ", *words[: i + 1])))
    rows = places.filter(edge("_0")).select(*key, F.explode(F.array(*grams)).alias("phrase"))
    return rows.filter("phrase IS NOT NULL").groupBy(*key, "phrase").agg(F.count(F.lit(1)).alias("n"))


def ngram_candidates(counts: DataFrame, key: list[str], most: int = MAX_CANDIDATES) -> DataFrame:
    """The `most` most frequent, then longest, phrases per key (alphabetical on ties); the number defines the result."""
    return topk(counts, key, [F.col("n").desc(), F.length("phrase").desc(), F.col("phrase").asc()], most)


def document_ngrams(texts: DataFrame, key: str, text: str, max_n: int = 3) -> DataFrame:
    """(key, phrase, n) of all admissible phrases where a row is a whole document: counted inside the row, nothing is shuffled."""
    rows = texts.select(key, F.lower(F.col(text)).alias("_text")).filter("_text IS NOT NULL")
    out = T.StructType([texts.schema[key], T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])
    stop = frozenset(V.PHRASE_STOP_WORDS)

    def grams(doc: str) -> Counter[str]:
        inner = [t if len(t) >= 3 else None for t in _TOKEN.findall(doc)]
        edge = [None if t in stop else t for t in inner]
        found = Counter(t for t in edge if t and len(t) >= 4)
        for n in range(2, max_n + 1):
            runs = zip(edge, *(inner[i:] for i in range(1, n - 1)), edge[n - 1 :], strict=False)
            found.update([" ".join(run) for run in runs if None not in run and len(set(run)) == n])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the phrases of a whole batch would be many times its texts
            for first, docs in few_texts(batch, "_text"):
                held: list[tuple[int, Counter[str]]] = []
                for i, doc in enumerate(docs, first):
                    held.append((i, grams(doc)))
                    if i == first + len(docs) - 1 or sum(len(c) for _, c in held) >= PHRASES_HELD:
                        keys = batch[key].take(pa.array(np.repeat([i for i, _ in held], [len(c) for _, c in held])))
                        phrases = pa.array([p for _, c in held for p in c], pa.string())
                        counts = pa.array([n for _, c in held for n in c.values()], pa.int64())
                        yield pa.RecordBatch.from_arrays([keys, phrases, counts], names=out.names)
                        held = []

    return rows.mapInArrow(run, out)


def _mmr(top_k: int, diversity: float):
    @F.pandas_udf("array<int>")
    def pick(doc: pd.Series, n: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for d, rows, vecs in zip(doc, n, vectors):
            if not rows or d is None:
                out.append([])
                continue
            v = np.asarray(vecs, dtype=float).reshape(rows, len(d))
            sims = np.round(v @ np.asarray(d, dtype=float), 9)
            chosen = [int(np.argmax(sims))]
            left = np.ones(rows, dtype=bool)
            left[chosen] = False
            redundancy = np.round(v @ v[chosen[0]], 9)
            while len(chosen) < min(top_k, rows):
                score = np.where(left, (1 - diversity) * sims - diversity * redundancy, -np.inf)
                nxt = int(np.argmax(score))
                chosen.append(nxt)
                left[nxt] = False
                redundancy = np.maximum(redundancy, np.round(v @ v[nxt], 9))
            out.append(chosen)
        return pd.Series(out)

    return pick


def rank_phrases(candidates: DataFrame, documents: DataFrame, key: list[str], encoder: Encoder, top_k: int, diversity: float = 0.6) -> DataFrame:
    """Maximal marginal relevance over at most 200 candidates per key. documents: (key..., vector).

    Candidates are counted once. A phrase is hashed wherever it stands, as that costs less than to join its vector; a model sees
    every phrase once.
    """
    if isinstance(encoder, HashingEncoder):
        coded = encoder.add(candidates, "phrase", "_v")
    else:
        candidates = cut_lineage(candidates)
        coded = candidates.join(encoder.add(candidates.select("phrase").distinct(), "phrase", "_v"), "phrase")
    listed = coded.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "phrase", "_v"))).alias("_c"))
    rows = listed.join(documents, key)
    blank = F.array_repeat(F.lit(0.0), F.size("vector"))
    vectors = F.flatten(F.transform("_c", lambda c: F.coalesce(c["_v"], blank)))
    picked = rows.select(*key, F.transform("_c", lambda c: c["phrase"]).alias("_p"), _mmr(top_k, diversity)(F.col("vector"), F.size("_c"), vectors).alias("_i"))
    return picked.select(*key, F.transform("_i", lambda i: F.get("_p", i)).alias("keyphrases"))


def keyphrases(texts: DataFrame, key: list[str], text: str = "text", top_k: int = 5, diversity: float = 0.6, encoder: Encoder | None = None) -> DataFrame:
    """Top keyphrases per key. Several rows may share a key; their vectors are pooled."""
    enc = encoder or HashingEncoder()
    pieces = texts.select(*key, text)
    documents = mean_pool(enc.add(pieces, text, "_v"), key, "_v", "vector")
    cands = ngram_candidates(ngram_counts(pieces, key, phrase_tokens(F.col(text))), key)
    return rank_phrases(cands, documents, key, enc, top_k, diversity)
