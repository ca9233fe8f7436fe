"""Exact top-k by inner product, with a pivot table that bounds scores before they are computed.

Every vector's distances to ``PIVOTS`` pivots are computed once. By the triangle inequality the distance of a query and
a candidate is at least the largest difference of their distances to a pivot, and as 2 q.c = |q|^2 + |c|^2 - |q - c|^2
that bounds their score from above. Candidates are evaluated in the order of their bounds; a query stops once the best
bound left is below its k-th score. Nothing is estimated: what is not evaluated cannot be among the k best.

Queries are a stated set, and meet all candidates in blocks: a task holds one block of each (at most about
``QUERY_BLOCK`` and ``BLOCK`` vectors) and returns at most k rows a query, from which a window takes the k best.
Blocks are dealt by a hash of the id, so copies of one vector do not gather in a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

PIVOTS = 32
BLOCK = 8192
QUERY_BLOCK = 4096
TOGETHER = 64  # queries that go through the candidates side by side
STEP = 512  # candidates evaluated between two tests for the end
SLACK = 1e-6  # for rounding in the bounds, relative to the squared sizes


def integral(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or holds null or non-finite numbers."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale).cast("double")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array column, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def best_of(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The k best entries of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    keep = rank < k
    return row[keep], score[keep], ids[keep]


def search_block(queries, query_ids, query_table, rows, ids, table, k: int):
    """(query id, id, score) of the k best rows for each query within one block, and the number of scores computed."""
    found, computed = [], 0
    row_size = (rows**2).sum(axis=1)
    query_size = (queries**2).sum(axis=1)
    near = np.lexsort((query_table.min(axis=1), query_table.argmin(axis=1)))
    for start in range(0, len(near), TOGETHER):
        some = near[start : start + TOGETHER]
        least = np.zeros((len(some), len(rows)))
        for p in range(table.shape[1]):
            np.maximum(least, np.abs(query_table[some, p][:, None] - table[None, :, p]), out=least)
        total = query_size[some][:, None] + row_size[None, :]
        bound = (total * (1 + SLACK) - least**2) / 2
        order = np.argsort(-bound.max(axis=0), kind="stable")
        bound = bound[:, order]
        edges = np.arange(0, len(rows), STEP)
        ahead = np.maximum.accumulate(np.maximum.reduceat(bound, edges, axis=1)[:, ::-1], axis=1)[:, ::-1]
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        kth = np.full(len(some), -np.inf)
        for at, edge in enumerate(edges):
            live = np.flatnonzero(ahead[:, at] >= kth)
            if not len(live):
                break
            chunk = order[edge : edge + STEP]
            scores = queries[some[live]] @ rows[chunk].T
            computed += scores.size
            scores[query_ids[some[live]][:, None] == ids[chunk][None, :]] = -np.inf
            r, c = np.nonzero((scores >= kth[live][:, None]) & (scores > -np.inf))
            new = (live[r], scores[r, c], ids[chunk][c])
            best = best_of(*(np.concatenate(pair) for pair in zip(best, new)), k)
            counts = np.bincount(best[0], minlength=len(some))
            full = np.flatnonzero(counts >= k)
            kth[full] = best[1][np.cumsum(counts)[full] - 1]
        found.append((query_ids[some][best[0]], best[2], best[1]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),), computed
    return tuple(np.concatenate(part) for part in zip(*found)), computed


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query row, ties to the smaller id.

    Rows without an id or without a sound vector take no part. Shorter vectors are filled up with zeros. A row with the
    query's id is the query's own row; if ids repeat, candidates with equal ids are each listed. Scores are exact as
    long as they stay below 2**53.
    """
    spark = vectors.sparkSession
    read = vectors.select(
        F.col(id_col).cast("long").alias("id"), integral(F.col(vector_col)).alias("x"), is_query.alias("asks")
    ).where("id is not null and x is not null")
    sound = stage(read, "vectors")
    n, asking, width = sound.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x"))).first()
    chosen = sound.orderBy(F.xxhash64("id"), "id").limit(pivots).select("x").collect()  # the pivots: a fixed number of rows
    width = max(width or 0, 1)
    anchor = np.zeros((len(chosen), width))
    for at, row in enumerate(chosen):
        anchor[at, : len(row["x"])] = row["x"]
    shared = spark.sparkContext.broadcast(anchor)

    @F.arrow_udf("array<double>")
    def to_pivots(x: pa.Array) -> pa.Array:
        away = distances(matrix(pa.chunked_array([x]), width), shared.value)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * away.shape[1], pa.int32()), pa.array(away.ravel()))

    tabled = stage(sound.withColumn("away", to_pivots(F.col("x"))), "pivots")
    blocks, query_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asking / QUERY_BLOCK))
    mine = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).alias("block")
    asks = F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_blocks)).alias("query_block")
    rows = tabled.select("id", "x", "away", mine, F.explode(numbers(query_blocks)).alias("query_block"))
    # Query rows that share an id would list their results twice; the first by vector stands for them.
    queries = tabled.where("asks").groupBy("id").agg(F.min(F.struct("x", "away")).alias("one")).select("id", "one.*")
    queries = queries.select("id", "x", "away", asks, F.explode(numbers(blocks)).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        sides = [(matrix(t["x"], width), t["id"].to_numpy(), matrix(t["away"], shared.value.shape[0])) for t in (left, right)]
        (query, vec, score), _ = search_block(*sides[0], *sides[1], k)
        return pa.table([pa.array(query), pa.array(vec), pa.array(score.astype(np.int64))], names=names)

    keys = ["query_block", "block"]
    met = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
