"""Exact top-k by inner product as a Voronoi join of queries and data.

Queries fall into the cells of pivots. A cell's summaries are its pivot p, its radius u (the greatest distance of a query from
p) and a floor: as q.x >= p.x - u|x| for each of its queries q, the (k+1)-th greatest of p.x - u|x| over all data bounds
every query's k-th score from below, its own row set aside. A row x is needed in a cell only if p.x + u|x| reaches that floor.
Cells are packed into blocks of queries; a row is sent once to each block with a cell that needs it, and a block's rows are
dealt over tiles of bounded size. Tiles solve their part, and the best k of all tiles of a query are its answer. Whatever the pivots,
the result is exact; they only decide how many rows can stay at home.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import keep

MOST_PIVOTS = 1024
CELL_QUERIES = 64  # queries of a cell, on average
BLOCK_QUERIES = 2048
TILE_ROWS = 1 << 15
STEP = 2048  # rows multiplied at once
CELLS_AT_ONCE = 1 << 21  # scores of a tile held at once
SLACK = 1e-9  # of the sizes involved, for the rounding of bounds


def _matrix(column, width: int) -> np.ndarray:
    """A list column as rows of `width` doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every row, and its distance."""
    square = (pivots**2).sum(1)
    at = np.concatenate([np.argmin(square - 2 * (m[i : i + STEP] @ pivots.T), axis=1) for i in range(0, len(m), STEP)]) if len(m) else np.zeros(0, np.int64)
    return at, np.sqrt(((m - pivots[at]) ** 2).sum(1))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def prepared(vectors: DataFrame, queries: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, id, asks, v) of the rows that take part, v = floor(scale x component) as doubles; written once, so that `row` stays."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), v.alias("v")).where(F.col("v").isNotNull() & whole)
    return keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", "asks", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")), "vectors")


def cells_of(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add `cell` and `distance` to queries(row, id, v)."""
    shared, width = queries.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1]
    out = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = _nearest(_matrix(batch.column("v"), width), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d)], [*batch.schema.names, "cell", "distance"])

    return queries.mapInArrow(run, out)


def floors(data: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """For each cell the (k+1)-th greatest p.x - u|x| over data(v), minus infinity if there are fewer rows.

    A task keeps k + 1 values a cell and sends them once.
    """
    shared, width = data.sparkSession.sparkContext.broadcast((pivots, radius)), pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = shared.value
        best = np.full((0, len(pivots)), -np.inf)
        for batch in _steps(batches):
            m = _matrix(batch.column("v"), width)
            low = m @ pivots.T - np.sqrt((m**2).sum(1))[:, None] * radius
            best = np.concatenate([best, low])
            if len(best) > k + 1:
                best = np.partition(best, len(best) - k - 1, axis=0)[len(best) - k - 1 :]
        cell = np.tile(np.arange(len(pivots), dtype=np.int32), len(best))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(best.ravel())], ["cell", "low"])

    every = data.select("v").mapInArrow(run, "cell int, low double")
    nth = every.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))).where(F.col("at") == k + 1).select("cell", "low").toArrow()
    out = np.full(len(pivots), -np.inf)
    out[nth["cell"].to_numpy()] = nth["low"].to_numpy()
    return out


def needed(data: DataFrame, pivots: np.ndarray, radius: np.ndarray, floor: np.ndarray, in_block: np.ndarray) -> DataFrame:
    """(row, id, v, block) for each block that has a cell which needs the row."""
    shared, width = data.sparkSession.sparkContext.broadcast((pivots, radius, floor, in_block)), pivots.shape[1]
    out = T.StructType([*data.schema.fields, T.StructField("block", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, floor, of = shared.value
        for batch in _steps(batches):
            m = _matrix(batch.column("v"), width)
            norm = np.sqrt((m**2).sum(1))[:, None]
            dot = m @ pivots.T
            high = dot + norm * radius
            use = high + SLACK * (1 + np.abs(dot) + norm * radius) >= floor - SLACK * (1 + np.abs(floor))
            to = (use.astype(np.float32) @ of.astype(np.float32)) > 0  # rows x blocks
            at, block = np.nonzero(to)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.astype(np.int32))], [*batch.schema.names, "block"])

    return data.mapInArrow(run, out)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the best k of each row of `scores`, ties to the smaller place; minus infinity is never taken."""
    n = scores.shape[1]
    bar = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    q, at = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
    order = np.lexsort((at, -scores[q, at], q))
    q, at = q[order], at[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], at[first]


def _solver(k: int, width: int, names: list[str]):
    """Best k of one tile for the queries of one block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("id", "ascending"), ("row", "ascending")])  # null ids come last
        q, x = _matrix(left["v"], width), _matrix(right["v"], width)
        own, rows = left["row"].to_numpy(), right["row"].to_numpy()
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, CELLS_AT_ONCE // max(1, len(x)))
        for at in range(0, len(q) if len(x) else 0, step):
            score = q[at : at + step] @ x.T
            score[own[at : at + step, None] == rows] = -np.inf
            i, j = _best(score, k)
            parts.append((i + at, j, score[i, j]))
        i, j, s = (np.concatenate(p) for p in zip(*parts, strict=True))
        i, j = pa.array(i), pa.array(j)
        cols = [left["row"].take(i), left["id"].take(i), right["id"].take(j), right["row"].take(j), pa.array(s.astype(np.int64))]
        return pa.Table.from_arrays(cols, names)

    return run


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    block_queries: int = BLOCK_QUERIES,
    tile_rows: int = TILE_ROWS,
    seed: int = 0,
) -> DataFrame:
    """The k best rows for each row for which the condition `queries` holds -> (query_row, query_id, rank, id, score).

    Components become floor(scale x component); the score is their inner product, exact below 2^53. Every row but the query's own
    is a candidate; ties go to the smaller id, null ids last. Repeated rows are candidates and queries of their own; `query_row`
    tells them apart. A null condition asks nothing. Null vectors and those with null or non-finite components take no part,
    shorter ones are filled with zeros. Columns that are not asked for are dropped. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, queries, id_col, vector_col, scale)
    ask = rows.where("asks").select("row", "id", "v")
    data = rows.select("row", "id", "v")
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("rows"), F.count_if("asks").alias("n")).first()
    width, n = size["width"] or 0, size["n"]
    id_type = rows.schema["id"].dataType
    out = T.StructType(
        [T.StructField("query_row", T.LongType()), T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("score", T.LongType())]
    )
    if not n:
        return spark.createDataFrame([], out).select("query_row", "query_id", F.lit(1).alias("rank"), "id", "score")
    drawn = ask.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(min(MOST_PIVOTS, -(-n // CELL_QUERIES))).select("v").toArrow()
    pivots = np.unique(_matrix(drawn["v"], width), axis=0)
    celled = keep(cells_of(ask, pivots), "cells")
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("u")).toArrow()  # a row a pivot
    used = cells["cell"].to_numpy()
    pivots, radius, count = pivots[used], cells["u"].to_numpy(), cells["n"].to_numpy()
    # cells go into blocks one after the other; one that lies in several deals its queries among them
    upto = np.cumsum(count)
    first, last = (upto - count) // block_queries, (upto - 1) // block_queries
    in_block = (np.arange(last[-1] + 1) >= first[:, None]) & (np.arange(last[-1] + 1) <= last[:, None])
    tiles = -(-size["rows"] // tile_rows)
    deal = spark.createDataFrame([(int(c), int(a), int(b - a + 1)) for c, a, b in zip(used, first, last, strict=True)], "cell int, first int, over int")
    block = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("over"))).cast("int").alias("block")
    asked = celled.join(F.broadcast(deal), "cell").select("row", "id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    sent = needed(data, pivots, radius, floors(data, pivots, radius, k), in_block).withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int"))
    found = asked.groupBy("block", "tile").cogroup(sent.groupBy("block", "tile")).applyInArrow(_solver(k, width, out.names), out)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "id", "score")
