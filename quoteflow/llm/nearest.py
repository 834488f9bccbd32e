"""Nearest vectors by largest inner product, exact, as a block matrix join.

Queries and candidates are packed into blocks of vectors and dealt over a grid: every query block meets every
candidate block once, in the tile (query group, candidate group).  In a tile, vectors are rounded to
int8; the integer products and the rounding errors bound every inner product, and only pairs whose upper bound
reaches the ``k``-th largest lower bound of their query are computed again, in double precision.  Tiles hand on at
most ``k`` rows a query, which are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block, and in a group of the grid (about): a tile's memory.
BLOCK, QUERY_GROUP, CANDIDATE_GROUP = 2048, 4096, 16384


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the largest error of a component: |v - scale * code| <= error."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(vectors - scale[:, None] * codes).max(axis=1)


def bounds(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products from int8 products.

    q.c = q'.c' + q'.(c - c') + (q - q').c with q' and c' the rounded vectors, so the error is at most
    error_c * |q'|_1 + error_q * |c|_1.  Products of codes are whole numbers below 2^53, so double arithmetic on them is exact.
    """
    q, q_scale, q_error = quantised(queries)
    c, c_scale, c_error = quantised(candidates)
    middle = (q.astype(np.float32) @ c.astype(np.float32).T if q.shape[1] <= 1000 else q.astype(float) @ c.astype(float).T).astype(float)
    middle *= q_scale[:, None] * c_scale[None, :]
    q_norm, c_norm = np.abs(q).sum(axis=1, dtype=np.int64) * q_scale, np.abs(candidates).sum(axis=1)
    error = q_norm[:, None] * c_error[None, :] + q_error[:, None] * c_norm[None, :]
    # for the rounding of this arithmetic itself
    error += 1e-12 * (np.abs(queries).sum(axis=1)[:, None] * np.abs(candidates).max(axis=1)[None, :])
    low, high = middle - error, middle + error
    # a product beyond the range of doubles is bounded by nothing
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
    return low, high


def exact(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added from first to last."""
    total = np.zeros(len(candidates))
    for j in range(len(query)):
        total += query[j] * candidates[:, j]
    return total


def tile(q_ids, queries, c_ids, candidates, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` best candidates of each query in this tile, by (score descending, id)."""
    low, high = bounds(queries, candidates)
    out = []
    for i, query_id in enumerate(q_ids):
        own = c_ids == query_id
        low[i, own] = high[i, own] = -np.inf
        others = len(c_ids) - int(own.sum())
        least = np.partition(low[i], len(c_ids) - k)[len(c_ids) - k] if others > k else -np.inf
        alive = np.flatnonzero((high[i] >= least) & ~own)
        scores = exact(queries[i], candidates[alive])
        best = heapq.nsmallest(k, zip((-scores).tolist(), c_ids[alive].tolist()))
        out.extend((int(query_id), int(other), -score) for score, other in best)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, vector`` to blocks of at most BLOCK vectors of one length: ``size, ids, vectors``."""
    held: dict[int, tuple[list, list]] = {}

    def block(size, ids, vectors):
        return pa.RecordBatch.from_arrays(
            [pa.array([size], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
             pa.array([np.array(vectors, np.float64).tobytes()], pa.binary())], names=["size", "ids", "vectors"])

    for batch in batches:
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, vectors = held.setdefault(len(vector), ([], []))
            ids.append(key), vectors.append(vector)
            if len(ids) == BLOCK:
                yield block(len(vector), *held.pop(len(vector)))
    for size, (ids, vectors) in held.items():
        yield block(size, ids, vectors)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` of the rows that take part, each id once; repeated ids keep the smallest vector."""
    values = F.col(vector).cast("array<double>")
    fine = (
        F.col(key).isNotNull() & F.col(vector).isNotNull()
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    return rows.where(fine).select(F.col(key).cast("long").alias("id"), values.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def nearest(rows: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each row whose id is divisible by ``every``.

    All rows but the query's own are candidates; ties go to the smaller id; fewer candidates give fewer rows.  Vectors that
    are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths do not meet.  Rows that repeat
    an id count once, with their smallest vector.  An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    points = usable(rows, key, vector)
    total = rows.count()
    query_groups, candidate_groups = -(-total // every // QUERY_GROUP) or 1, -(-total // CANDIDATE_GROUP) or 1
    # small tables still use the cluster's cores
    candidate_groups = max(candidate_groups, -(-spark.sparkContext.defaultParallelism // query_groups))
    deal = F.xxhash64("ids")
    blocks = "size int, ids binary, vectors binary"
    queries = points.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(_pack, blocks).select(
        "*", F.pmod(deal, F.lit(query_groups)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(candidate_groups - 1))).alias("c")
    )
    # candidates fall into groups by their id, so that groups are even; keys have one type on both sides, as rows are dealt by its hash
    candidates = points.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(candidate_groups)).cast("int")).select(
        "id", "vector", "c", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("q")
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            sizes = right["vector"].map(len).to_numpy()
            for size in sorted(set(left["size"])):
                of_size = right[sizes == size]
                for at in range(0, len(of_size), BLOCK):
                    part = of_size.iloc[at : at + BLOCK]
                    c_ids, c_vectors = part["id"].to_numpy(np.int64), np.stack(part["vector"].to_list()).astype(float)
                    for ids, vectors in left.loc[left["size"] == size, ["ids", "vectors"]].itertuples(index=False):
                        q_ids = np.frombuffer(ids, np.int64)
                        found += tile(q_ids, np.frombuffer(vectors).reshape(len(q_ids), size), c_ids, c_vectors, k)
        return best_of(pd.DataFrame(found, columns=["query_id", "vec_id", "score"]))

    def best_of(found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, group in found.groupby("query_id", sort=True):
            best = heapq.nsmallest(k, zip((-group["score"]).tolist(), group["vec_id"].tolist()))
            out += [(query, i + 1, other, -score) for i, (score, other) in enumerate(best)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})

    schema = "query_id bigint, rank int, vec_id bigint, score double"
    tiles = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInPandas(meet, schema)
    # a query has at most k rows from each candidate group
    return tiles.groupBy("query_id").applyInPandas(lambda rows: best_of(rows), schema).withColumnRenamed("vec_id", key)
