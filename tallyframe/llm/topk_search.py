"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors of a group lie in blocks along a Hilbert curve, so that those of a block are alike. A query bounds each block by the sum over components of the most that the block's
largest and smallest values allow, takes blocks from the highest bound down, scores a block through its forward index
(the block's matrix), and stops once no bound reaches its k-th score.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.batches import read_table
from tallyframe.llm.clustering import hilbert_keys

BLOCK = 128
#: Vectors and queries that meet in one task.
GROUP_ROWS, QUERY_ROWS = 8192, 4096
#: Components that place a vector on the curve, and bits of each.
CURVE_COMPONENTS, CURVE_BITS = 64, 4
SCALE = 64


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with floor(64 * x) of every component. Rows without id, without vector, or with a null or
    non-finite component are left out; rows that repeat an id all stay."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    usable = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled up with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for r, row in enumerate(rows):
        out[r, : len(row)] = row
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where these hold every sum, or else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score) of the k highest scores of each query over all rows, which lie in blocks as they come; ties
    go to smaller ids."""
    starts = np.arange(0, len(ids), BLOCK)
    high = np.maximum.reduceat(matrix, starts, axis=0)
    low = np.minimum.reduceat(matrix, starts, axis=0)
    bounds = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best = np.full((len(queries), k), none)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    active = np.arange(len(queries))
    for turn in range(len(starts)):
        block = order[active, turn]
        going = bounds[active, block] >= best[active, -1]
        active, block = active[going], block[going]
        if not len(active):
            break
        for b in np.unique(block):
            own = active[block == b]
            rows = slice(starts[b], starts[b] + BLOCK)
            scores = _product(queries[own], matrix[rows])
            scores[query_ids[own][:, None] == ids[rows][None, :]] = none
            better = (scores >= best[own, -1:]).any(axis=1)
            own, scores = own[better], scores[better]
            both = np.hstack([best[own], scores])
            both_ids = np.hstack([best_ids[own], np.broadcast_to(ids[rows], scores.shape)])
            both_ids = np.where(both == none, np.iinfo(np.int64).max, both_ids)
            pick = np.lexsort((both_ids, ~both))[:, :k]
            best[own] = np.take_along_axis(both, pick, axis=1)
            best_ids[own] = np.take_along_axis(both_ids, pick, axis=1)
    filled = best != none
    return np.nonzero(filled)[0], best_ids[filled], best[filled]


def _along_curve(matrix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of rows along a curve over their first components; equal places by id."""
    part = matrix[:, :CURVE_COMPONENTS]
    if not part.shape[1]:
        return np.argsort(ids, kind="stable")
    low, high = part.min(axis=0), part.max(axis=0)
    cells = np.floor((part - low.astype(np.float64)) / np.maximum(high - low.astype(np.float64), 1) * ((1 << CURVE_BITS) - 1))
    return np.lexsort((ids, *hilbert_keys(cells.astype(np.int64), CURVE_BITS).T[::-1]))


def _searched(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(block["v"].map(len).max(), queries["v"].map(len).max())
        query_ids, ids, matrix = queries["vec_id"].to_numpy(), block["vec_id"].to_numpy(), _matrix(block["v"], width)
        order = _along_curve(matrix, ids)
        rows, found, scores = search(_matrix(queries["v"], width), query_ids, matrix[order], ids[order], k)
        return pd.DataFrame({"query_id": query_ids[rows], "vec_id": found, "score": scores})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query (vec_id, v) with rows
    of ``vectors`` (vec_id, v) of other ids; all if there are fewer. Ties go to the smaller vec_id.

    Vectors of different lengths are filled up with zeros. Rows that repeat an id are candidates of their own, and as
    queries share one ranking. No queries or no vectors give no rows.

    Vectors are dealt into groups and queries into chunks, both of bounded size, by hashed id; every chunk meets every
    group once, on the pair of their numbers. Within a group blocks are ranges of the curve. Each task yields k rows per query
    at most; the last step ranks those.
    """
    n, n_queries = vectors.count(), queries.count()
    groups, chunks = max(1, -(-n // GROUP_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    dealt = vectors.select("vec_id", "v", group.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = queries.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
    )
    met = asked.groupBy("chunk", "part").cogroup(dealt.groupBy("chunk", "part"))
    found = met.applyInPandas(_searched(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_block_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every twentieth one; see ``integer_vectors`` and ``top_k`` for awkward rows."""
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20)


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q, v c
    WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
