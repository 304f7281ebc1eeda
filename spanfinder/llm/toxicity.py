"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over pairs of terms of the dot product of their factors). The pairs' sum is
half of (sum of factors)^2 - sum of squared factors, so it costs as much as the linear part. An interaction, such as an
insult with the mention of a group, has a weight of its own through the factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import terms as T
from .tables import small_batches

FACTORS, RATE, PENALTY = 8, 1.0, 1e-5
TOXIC = 0.7


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(n: int, counts: dict) -> dict[str, np.ndarray]:
    toxic = max(counts.get(1, 0), 0.5) / max(sum(counts.values()), 1)
    factors = np.random.default_rng(1).normal(0, 0.02, (n, FACTORS))
    return {"bias": np.array([np.log(toxic / max(1 - toxic, 1e-3))]), "w": np.zeros(n), "v": factors, "gw": np.full(n, 0.1), "gv": np.full((n, FACTORS), 0.1)}


def _sums(p: dict, term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear-and-pairwise value and factor sums of n documents, given terms by document."""
    own = p["v"][term]
    total = np.stack([np.bincount(doc, own[:, f], n) for f in range(own.shape[1])], 1)
    square = np.bincount(doc, (own**2).sum(1), n)
    return p["bias"][0] + np.bincount(doc, p["w"][term], n) + 0.5 * ((total**2).sum(1) - square), total


def _step(p: dict, term: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
    n = len(y)
    z, total = _sums(p, term, doc, n)
    error = (_sigmoid(z) - y) / np.sqrt(n)
    p["bias"] -= RATE * 0.1 * error.mean()
    used, own = np.unique(term, return_inverse=True)
    e = error[doc]
    g = np.bincount(own, e, len(used)) + PENALTY * p["w"][used]
    p["gw"][used] += g**2
    p["w"][used] -= RATE * g / np.sqrt(p["gw"][used])
    gv = np.stack([np.bincount(own, e * (total[doc, f] - p["v"][term, f]), len(used)) for f in range(total.shape[1])], 1) + PENALTY * p["v"][used]
    p["gv"][used] += gv**2
    p["v"][used] -= 0.25 * RATE * gv / np.sqrt(p["gv"][used])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _model(docs: DataFrame, labels: DataFrame, most_labelled: int):
    sample = T.labelled_sample(docs, labels, "toxic", "y IN (0, 1) AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1", most_labelled)
    vocabulary, p = T.fit(sample, _start, _step, marks=False, pairs=True)
    return vocabulary, docs.sparkSession.sparkContext.broadcast({k: p[k] for k in ("bias", "w", "v")})


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = T.MOST_LABELLED) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1) and predicted (1 from TOXIC on).

    The machine is fitted on about `most_labelled` rows of `labels` (doc_id, toxic) that are not held out; it sees terms
    alone. Null and empty texts get the score of a text without terms. Null ids are not held out and have no label; repeated
    ids each get a row; contradicting labels are not used. Without labels every score is the prior. Empty tables give an
    empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary, model = _model(docs, labels, most_labelled)
    scored = T.apply(docs, vocabulary, lambda term, doc, n: [_sigmoid(_sums(model.value, term, doc, n)[0])], "score double", marks=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, most_labelled: int = T.MOST_LABELLED) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that `score` does not predict toxic, as they are and where they are."""
    small_batches(docs.sparkSession)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vocabulary, model = _model(text, labels, most_labelled)
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [np.zeros(0, bool)]
            for lo, hi, data, off in A.blocks(batch["text"]):
                ok.append(_sigmoid(_sums(model.value, *given.value.find(*T.terms(data, off)), hi - lo)[0]) < TOXIC)
            yield batch.filter(pa.array(np.concatenate(ok)))

    return docs.mapInArrow(run, docs.schema)
