"""Quality by ordinal cumulative-link regression over hashed terms.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector for all grades and ordered thresholds t_1 < t_2 < ... x marks a
text's terms, runs of signs and coarse shape. The model gives the expected grade and the tail probabilities for selection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import terms as T
from .tables import small_batches

RATE, PENALTY = 0.5, 1e-4
SELECT_FROM, SELECT_AT = 1, 0.5


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shape(data: np.ndarray, off: np.ndarray, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms for how long a text is and how many of its terms are repeats."""
    n = len(off) - 1
    size = np.bincount(row, minlength=n)
    order = np.lexsort((h, row))
    distinct = np.bincount(row[order][np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(h)]], minlength=n)
    length = np.log2(size + 1).astype(np.uint64)
    share = (10 * distinct / np.maximum(size, 1)).astype(np.uint64)
    return A.mix(np.r_[length + np.uint64(1_000), length * np.uint64(16) + share + np.uint64(2_000)]), np.tile(np.arange(n), 2)


def _start(n: int, counts: dict) -> dict[str, np.ndarray]:
    top, total = max(counts, default=1), max(sum(counts.values()), 1)
    tail = np.array([sum(c for y, c in counts.items() if y >= k) for k in range(1, max(top, 1) + 1)]) / total
    tail = np.clip(tail, 1e-3, 1 - 1e-3)
    return {"t": np.maximum.accumulate(np.log((1 - tail) / tail) + 1e-3 * np.arange(len(tail))), "w": np.zeros(n), "gw": np.full(n, 0.1)}


def _tails(p: dict, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return _sigmoid(np.bincount(doc, p["w"][term], n)[:, None] - p["t"][None, :])


def _step(p: dict, term: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
    """One step on the log likelihood of P(grade = y) = P(>= y) - P(>= y + 1)."""
    n, rows = len(y), np.arange(len(y))
    tail = np.c_[np.ones(n), _tails(p, term, doc, n), np.zeros(n)]
    upper, lower = tail[rows, y], tail[rows, y + 1]
    chance = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
    slope = -(du - dl) / np.sqrt(n)
    used, own = np.unique(term, return_inverse=True)
    g = np.bincount(own, slope[doc], len(used)) + PENALTY * p["w"][used]
    p["gw"][used] += g**2
    p["w"][used] -= RATE * g / np.sqrt(p["gw"][used])
    k = len(p["t"])
    gt = np.zeros(k)
    np.add.at(gt, y[y > 0] - 1, du[y > 0])
    np.add.at(gt, y[y < k], -dl[y < k])
    p["t"] = np.sort(p["t"] - RATE * 0.3 * gt / n)


def rate(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: str = "grade", most_labelled: int = T.MOST_LABELLED) -> DataFrame:
    """Grades of every whole text: doc_id, expected_grade, tails (P(grade >= k) for k from 1) and kept.

    `ratings` has doc_id and an integer grade from 0; the model is fitted on about `most_labelled` of its rows. `kept` is
    P(grade >= SELECT_FROM) >= SELECT_AT. Null and empty texts get the grade of a text without terms. Null ids have no
    rating; repeated ids each get a row; contradicting ratings are not used. Without ratings every text gets even odds.
    Empty tables give an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = T.labelled_sample(docs, ratings, grade, "y >= 0", most_labelled)
    vocabulary, p = T.fit(sample, _start, _step, marks=True, extra=_shape)
    model = docs.sparkSession.sparkContext.broadcast({k: p[k] for k in ("t", "w")})

    def grades(term: np.ndarray, doc: np.ndarray, n: int) -> list:
        tail = _tails(model.value, term, doc, n)
        return [tail.sum(1), A.lists(tail.ravel(), np.arange(n + 1) * tail.shape[1])]

    rated = T.apply(docs, vocabulary, grades, "expected_grade double, tails array<double>", marks=True, extra=_shape)
    return rated.withColumn("kept", F.element_at("tails", SELECT_FROM) >= SELECT_AT)
