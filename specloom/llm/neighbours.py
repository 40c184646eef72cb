"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are scaled to length 1 and quantised to int8 with a scale of their own.  Blocks of
queries meet blocks of candidates in tiles; a tile multiplies the quantised blocks, which gives
every cosine with a bound on its error: with q = s_q (q8 + e) and |e| <= 1/2 in every component,
the cosine differs from s_q s_c q8.c8 by at most s_q s_c (|q8|_1 + |c8|_1 + d/2) / 2.  A candidate survives if its
upper bound reaches the query's k-th best lower bound; survivors are computed again in double
precision from the original vectors and kept in a heap of k, and the heaps of a query's tiles
are merged.  No neighbour is missed.

Queries and candidates are dealt to blocks of bounded size, so a task holds one block of each.

Defined results: null vectors, zero vectors and those with null or non-finite components take no
part; vectors of different lengths are never near; a query is not its own neighbour (rows that
repeat its id are left out with it); ties go to the smaller id; rows that repeat an id are
candidates each and one query, the smallest vector's; with fewer than k candidates all are returned;
components may be as small or large as doubles are; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import small, stored

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Candidates multiplied at once.
SLICE = 2048
K = 5
#: Tables of vector lengths up to this many rows are broadcast.
BROADCAST_LENGTHS = 100_000


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the sums of their absolute values, of rows of length 1."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.abs(q).sum(axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to between 1/2 and 1: no square under- or overflows, and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def tile(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of the k nearest candidates of each query."""
    d = queries.shape[1]
    queries, vectors = scaled(queries), scaled(vectors)
    q_norm, c_norm = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((vectors * vectors).sum(axis=1))
    q8, q_scale, q_sum = quantised(queries / q_norm[:, None])
    heaps: list[list] = [[] for _ in query_ids]
    for a in range(0, len(ids), SLICE):
        block, own = vectors[a:a + SLICE], ids[a:a + SLICE]
        c8, c_scale, c_sum = quantised(block / c_norm[a:a + SLICE, None])
        # Products of int8 sum exactly in float32 up to 2^24; longer vectors go by runs of 1024 components.
        near = sum((q8[:, j:j + 1024].astype(np.float32) @ c8[:, j:j + 1024].T.astype(np.float32)).astype(np.float64) for j in range(0, d, 1024))
        unit = q_scale[:, None] * c_scale[None, :]
        near *= unit
        slack = unit * (q_sum[:, None] + c_sum[None, :] + d / 2) / 2 + 1e-9
        same = query_ids[:, None] == own[None, :]
        upper = np.where(same, -np.inf, near + slack)
        lower = np.where(same, -np.inf, near - slack)
        kth = np.partition(lower, -k, axis=1)[:, -k] if len(own) > k else np.full(len(query_ids), -np.inf)
        known = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        alive = (upper >= np.maximum(kth, known - 1e-9)[:, None]) & ~same
        for i in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[i])
            exact = (block[at] * queries[i]).sum(axis=1) / (q_norm[i] * c_norm[a + at])
            heap = heaps[i]
            order = np.lexsort((own[at], -exact))[:k]
            for j in order:
                item = (float(exact[j]), -int(own[at[j]]))
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
    return [(int(query_ids[i]), -c, s) for i, heap in enumerate(heaps) for s, c in heap]


def usable(vector: Column) -> Column:
    """Not null, of finite components, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest candidates of each query."""
    good = F.coalesce(usable(F.col(vector_col)), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"),
                                      F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("d", F.size("v"))
    # Sizes of every vector length, a handful of numbers, decide the number of blocks.
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("m")).select(
        F.col("d").alias("__d"), F.ceil(F.col("n") / CANDIDATE_BLOCK).cast("int").alias("c_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("m") / QUERY_BLOCK)).cast("int").alias("q_blocks"))
    rows = rows.join(small(stored(sizes), BROADCAST_LENGTHS), F.col("d") == F.col("__d")).drop("__d")
    own = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    candidates = rows.select("id", "v", "d", (own % F.col("c_blocks")).cast("int").alias("cb"), F.explode(every(F.col("q_blocks"))).alias("qb"))
    one = rows.where("q").groupBy("id").agg(F.min(F.struct("d", "v", "q_blocks", "c_blocks")).alias("s")).select("id", "s.*")
    queries = (one.select("id", "v", "d", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int").alias("qb"),
                                                             F.explode(every(F.col("c_blocks"))).alias("cb")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = tile(np.stack(left["v"].to_numpy()), left["id"].to_numpy(), np.stack(right["v"].to_numpy()), right["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    # Aliases of its own keep the two sides, which come from one table, apart.
    queries = queries.toDF(*queries.columns)
    tiles = (queries.groupBy("d", "qb", "cb").cogroup(candidates.groupBy("d", "qb", "cb"))
             .applyInPandas(meet, "query_id bigint, vec_id bigint, score double"))

    def merge(heaps: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(-heaps["score"], heaps["vec_id"]))
        return pd.DataFrame({"query_id": heaps["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                             "vec_id": [c for _, c in best], "score": [-s for s, _ in best]})

    return tiles.groupBy("query_id").applyInPandas(merge, "query_id bigint, rank int, vec_id bigint, score double")
