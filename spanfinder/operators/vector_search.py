"""Exact and approximate nearest-vector search for a table of queries.

Queries are few and vectors are many, so the vectors stay where they are: each task multiplies its
Arrow batches with a block of query vectors and keeps only the best k per query. What is shuffled is
at most k rows per task and query; pairs are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import l2_norm
from .ordered import seeded_key
from .topk import topk

QUERY_BLOCK = 4096  # queries of one block, which every task holds
PAIR_BLOCK = 50 * QUERY_BLOCK  # (query, scope) pairs of one block
COLUMN_BLOCK = 256  # queries multiplied at once, bounds the score matrix of one batch
SCORE_DIGITS = 9


class _Best:
    """Running best k rows per query of one task."""

    def __init__(self, n_queries: int, k: int, row_key: str):
        self.k, self.row_key = k, row_key
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        self.limit = max(200_000, 2 * k * n_queries)

    def offer(self, rows: pd.DataFrame, scores: np.ndarray, cols: np.ndarray) -> None:
        floor = self.floor[cols]
        if len(rows) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(rows) - self.k, axis=0)[len(rows) - self.k])
        r, c = np.nonzero(scores >= floor)
        if not len(r):
            return
        part = rows.iloc[r].copy()
        part["_q"] = cols[c]
        part["score"] = scores[r, c]
        self.parts.append(part)
        self.held += len(part)
        if self.held > self.limit:
            self.prune()

    def prune(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame()
        whole = pd.concat(self.parts, ignore_index=True)
        whole = whole.sort_values(["_q", "score", self.row_key], ascending=[True, False, True])
        whole = whole[whole.groupby("_q").cumcount() < self.k]
        full = whole.groupby("_q")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.parts, self.held = [whole], len(whole)
        return whole


def _score(batch: pd.DataFrame, matrix: np.ndarray, groups: dict | None, group_col: str | None, best: _Best) -> None:
    vectors = np.asarray(batch["_v"].tolist(), dtype=np.float64)
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms > 0, norms, 1.0)[:, None]
    rows = batch.drop(columns=["_v"])
    everyone = np.arange(matrix.shape[0])
    pieces = [(slice(None), everyone)] if groups is None else [
        (np.asarray(idx), groups[g]) for g, idx in rows.groupby(group_col).indices.items() if g in groups
    ]
    for idx, wanted in pieces:
        sub = rows if groups is None else rows.iloc[idx]
        for at in range(0, len(wanted), COLUMN_BLOCK):
            cols = wanted[at : at + COLUMN_BLOCK]
            best.offer(sub, np.round(unit[idx] @ matrix[cols].T, SCORE_DIGITS), cols)


def _normalised(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    m = np.asarray(vectors, dtype=np.float64)
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 0, n, 1.0)[:, None]


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    vector: str = "embedding",
    query_vector: str = "query_vector",
    row_key: str = "segment_id",
    payload: Sequence[str] = (),
    scope: DataFrame | None = None,
    scope_col: str = "video_id",
) -> DataFrame:
    """Best k vectors by cosine per query -> (query_id, row_key, payload..., score, rank).

    queries: (query_id, query_vector). Null and zero vectors never match. `scope` holds
    (query_id, scope_col) pairs; with it a query sees only the rows of its own scope values.
    """
    keep = list(dict.fromkeys([row_key, *payload]))
    carried = list(dict.fromkeys([*keep, *([scope_col] if scope is not None else [])]))
    rows = vectors.filter(F.col(vector).isNotNull() & (l2_norm(F.col(vector)) > 0)).select(*carried, F.col(vector).alias("_v"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select("query_id", F.col(query_vector).alias("_v"))
    q_type = asked.schema["query_id"].dataType
    out = T.StructType(
        [T.StructField("query_id", q_type)] + [rows.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())]
    )
    n_blocks, pairs = -(-asked.count() // QUERY_BLOCK), None
    if scope is not None:
        pairs = scope.select("query_id", scope_col).distinct().join(asked.select("query_id"), "query_id", "left_semi")
        n_blocks = max(n_blocks, -(-pairs.count() // PAIR_BLOCK))
    parts = [asked.sparkSession.createDataFrame([], out)]
    for b in range(n_blocks):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b
        parts.append(_block(asked.filter(mine), None if pairs is None else pairs.filter(mine), rows, k, keep, row_key, scope_col, out))
    return topk(reduce(DataFrame.unionAll, parts), ["query_id"], [F.col("score").desc(), F.col(row_key).asc()], k)


def _block(asked: DataFrame, pairs: DataFrame | None, rows: DataFrame, k: int, keep: list[str], row_key: str, scope_col: str, out: T.StructType) -> DataFrame:
    """One block of queries against all vectors, which stay where they are."""
    taken = asked.toPandas().sort_values("query_id")
    ids, groups = taken["query_id"].to_numpy(), None
    if pairs is not None:
        where = {q: i for i, q in enumerate(ids)}
        groups = {}
        for q, g in pairs.toPandas()[["query_id", scope_col]].itertuples(index=False):
            groups.setdefault(g, []).append(where[q])
        groups = {g: np.asarray(sorted(i)) for g, i in groups.items()}
    shared = asked.sparkSession.sparkContext.broadcast((ids, _normalised(taken["_v"].tolist()) if len(ids) else None, groups))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix, wanted = shared.value
        best = _Best(len(query_ids), k, row_key)
        for batch in batches:
            if len(batch) and len(query_ids):
                _score(batch, matrix, wanted, scope_col, best)
        found = best.prune()
        if len(found):
            found["query_id"] = query_ids[found["_q"].to_numpy()]
            yield found[["query_id", *keep, "score"]]

    return rows.mapInPandas(run, out)


class CellIndex:
    """Vectors in folders by their nearest of a fixed number of centres; a query visits its `nprobe` nearest cells.

    Only the folders of cells that some query visits are read, and within a cell a task multiplies its rows with the queries that
    visit it. Inside the visited cells the search is exact. `recall` tells what a number of probes finds.
    """

    def __init__(self, centres: np.ndarray, vector: str = "embedding", path: str | None = None):
        self.centres, self.vector, self.path = _normalised(centres), vector, path

    @staticmethod
    def _usable(vectors: DataFrame, vector: str) -> DataFrame:
        return vectors.filter(F.col(vector).isNotNull() & (l2_norm(F.col(vector)) > 0))

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int, vector: str = "embedding", seed: int = 0) -> CellIndex:
        """Centres by k-means over all vectors, so that cells do not change in kind with the table's size."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = cls._usable(vectors, vector).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        return cls(np.array(KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(data).clusterCenters()), vector)

    @classmethod
    def draw(cls, vectors: DataFrame, cells: int, row_key: str, vector: str = "embedding", seed: int = 0) -> CellIndex:
        """Centres are vectors drawn by a seeded hash of their key: no training, and the same ones on any engine."""
        drawn = cls._usable(vectors, vector).orderBy(seeded_key(seed, F.col(row_key)), row_key).limit(cells).select(vector)
        return cls(np.array([r[0] for r in drawn.collect()], dtype=np.float64), vector)  # `cells` rows

    def _ranked(self, v: pd.Series, n: int) -> np.ndarray:
        """The n nearest centres of every vector, ties to the smaller number."""
        sims = np.round(_normalised(v.tolist()) @ self.centres.T, SCORE_DIGITS)
        return np.argsort(-sims, axis=1, kind="stable")[:, :n].astype("int32")

    def assign(self, vectors: DataFrame) -> DataFrame:
        """Add the cell of every usable vector."""

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(self._ranked(v, 1)[:, 0])

        return self._usable(vectors, self.vector).withColumn("cell", cell(F.col(self.vector)))

    def probes(self, queries: DataFrame, nprobe: int, query_vector: str = "query_vector") -> DataFrame:
        """(query_id, cell, place) of the nprobe nearest centres of every query, place from 1."""
        n = min(nprobe, len(self.centres))

        @F.pandas_udf("array<int>")
        def nearest_cells(v: pd.Series) -> pd.Series:
            return pd.Series(list(self._ranked(v, n)))

        found = queries.filter(F.col(query_vector).isNotNull() & (l2_norm(F.col(query_vector)) > 0))
        return found.select("query_id", F.posexplode(nearest_cells(F.col(query_vector))).alias("place", "cell")).withColumn("place", F.col("place") + 1)

    def write(self, vectors: DataFrame, path: str) -> CellIndex:
        """Store the vectors by cell, and the centres; returns the stored index.

        Rows of a cell come together in files of the advisory size; adaptive execution splits a crowded cell and joins small ones.
        """
        self.assign(vectors).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        spark = vectors.sparkSession
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return CellIndex(self.centres, self.vector, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, vector: str = "embedding") -> CellIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # a row a cell
        return cls(np.array([r["centre"] for r in rows]), vector, path)

    def cells(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """Stored vectors, of the cells in `wanted` alone: their numbers become filters on the folders."""
        rows = spark.read.parquet(f"{self.path}/vectors")
        if wanted is None:
            return rows
        return rows.where(F.col("cell").isin(sorted(r["cell"] for r in wanted.select("cell").distinct().collect())))  # at most all cells

    def search(self, queries: DataFrame, k: int, nprobe: int, **options) -> DataFrame:
        """Best k of the nprobe nearest cells of every query, as `nearest`."""
        scope = self.probes(queries, nprobe)
        return nearest(queries, self.cells(queries.sparkSession, scope), k, vector=self.vector, scope=scope, scope_col="cell", **options)

    def recall(self, queries: DataFrame, k: int, counts: Sequence[int], row_key: str = "segment_id") -> DataFrame:
        """(nprobe, recall) over the exact best k of all queries: a row is found if its cell is among the first nprobe."""
        exact = nearest(queries, self.cells(queries.sparkSession), k, vector=self.vector, row_key=row_key, payload=("cell",))
        placed = exact.join(self.probes(queries, len(self.centres)), ["query_id", "cell"])
        shares = [F.struct(F.lit(n).alias("nprobe"), F.avg((F.col("place") <= n).cast("double")).alias("recall")) for n in counts]
        return placed.agg(F.array(*shares).alias("s")).select(F.inline("s"))
