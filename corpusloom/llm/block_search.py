"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; a pair of blocks is one group of one task.
There each vector is quantised to int8 with its own step, tiles of integer products give every inner
product with a bound on its quantisation error, and only pairs whose upper bound reaches the k-th best
lower bound are recomputed in double precision. Heaps keep the k best per query across the tiles of a
block; the blocks' results are ranked per query, again with a limit before the exchange. Since the bounds
are strict the result is exact, and nothing has to be fitted.

Each candidate row is copied once per query block and each query row once per candidate block, so the
exchange carries |Q| |C| (1 / block_q + 1 / block_c) vectors: the query set meets all rows, in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do null ids; an id that repeats keeps its least vector; only vectors of equal length are compared; ties go
to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import materialize
from .vectors import exact_products, matrix, prepared

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16_384
TILE = 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and the step of each row, so that |x - step * code| <= step / 2 in every component."""
    step = np.abs(x).max(axis=1) / 127.0
    step = np.maximum(step, np.finfo(float).tiny)
    return np.rint(x / step[:, None]).astype(np.int8), step


def _bounds(q, q_step, q_code, c_step, c_code) -> tuple[np.ndarray, np.ndarray]:
    """Inner products from integer tiles, and what they may be off by.

    q.c - sq sc Q.C = q.(c - sc C) + (q - sq Q).(sc C), hence at most
    |q|_1 sc / 2 + (sq / 2) sc |C|_1, up to rounding.
    """
    exact = np.float32 if q.shape[1] * 127**2 < 1 << 24 else np.float64  # holds every integer product
    near = (q_code.astype(exact) @ c_code.astype(exact).T).astype(float)
    near *= q_step[:, None]
    near *= c_step
    slack = np.abs(q).sum(axis=1)[:, None] * (c_step / 2) + (q_step / 2)[:, None] * (c_step * np.abs(c_code.astype(np.int32)).sum(axis=1))
    return near, slack * (1 + 1e-9) + 1e-12 * np.abs(near)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best of these candidates as (score, id), best first. A query never meets its own id."""
    q_code, q_step = quantise(q)
    c_code, c_step = quantise(c)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for at in range(0, len(c_ids), TILE):
        part = slice(at, at + TILE)
        for row in range(0, len(q_ids), 256):
            rows = slice(row, row + 256)
            near, slack = _bounds(q[rows], q_step[rows], q_code[rows], c_step[part], c_code[part])
            own = q_ids[rows][:, None] == c_ids[part]
            near[own] = -np.inf
            low = near - slack
            width = low.shape[1]
            floor = np.partition(low, width - k, axis=1)[:, width - k] if width >= k else np.full(len(low), -np.inf)
            for i in range(len(low)):
                heap = heaps[row + i]
                best = max(floor[i], heap[0][0] if len(heap) == k else -np.inf)
                found = np.flatnonzero((near[i] + slack[i] >= best) & ~own[i])
                scores = exact_products(c[part][found], q[row + i])
                if len(found) > 4 * k:  # ties and near ties: only the best can enter the heap
                    keep = np.lexsort((c_ids[part][found], -scores))[:k]
                    found, scores = found[keep], scores[keep]
                for s, j in zip(scores.tolist(), c_ids[part][found].tolist()):
                    item = (s, -j)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
    return [(int(i), [(s, -j) for s, j in sorted(h, reverse=True)]) for i, h in zip(q_ids, heaps) if h]


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products of every query against all other rows.

    `is_query` is a condition on `key`.
    """
    rows = materialize(prepared(df, key, vector), "vectors")
    asked = rows.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    sizes = rows.groupBy("dim").agg(F.count("id").alias("n_c")).join(asked.groupBy("dim").agg(F.count("id").alias("n_q")), "dim")
    blocks = sizes.select("dim", F.ceil(F.col("n_q") / QUERY_BLOCK).cast("int").alias("q_blocks"), F.ceil(F.col("n_c") / CANDIDATE_BLOCK).cast("int").alias("c_blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q_side = asked.join(blocks, "dim").select("dim", own("q_blocks").alias("qb"), spread("c_blocks").alias("cb"), "id", "v")
    c_side = rows.join(blocks, "dim").select("dim", spread("q_blocks").alias("qb"), own("c_blocks").alias("cb"), "id", "v").toDF("c_dim", "c_qb", "c_cb", "c_id", "c_v")
    kind = df.schema[key].dataType.simpleString()

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = []
        else:
            dim = left.column("dim")[0].as_py()
            found = search_block(np.asarray(left.column("id")), matrix(left.column("v"), dim).astype(float), np.asarray(right.column("c_id")), matrix(right.column("c_v"), dim).astype(float), k)
        flat = [(i, j, s) for i, best in found for s, j in best]
        return pa.table([pa.array([x[n] for x in flat], t) for n, t in enumerate((left.schema.field("id").type, left.schema.field("id").type, pa.float64()))], names=["query_id", "id", "score"])

    found = q_side.groupBy("dim", "qb", "cb").cogroup(c_side.groupBy("c_dim", "c_qb", "c_cb")).applyInArrow(tile, f"query_id {kind}, id {kind}, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
