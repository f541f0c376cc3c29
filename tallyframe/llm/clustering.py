"""Clusters around centroids, with zone maps along a space-filling curve.

Vectors are put in the order of a Hilbert curve and cut into blocks, each with the least and the greatest value of every
component. A centroid cannot be the nearest of any vector of a block if the block's box is further from it than the box's
far corner is from another centroid. The centroids that are left are compared with the block's vectors exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import read_table, with_small_batches
from tallyframe.llm.vectors import exact_product, finite, lists, matrix
from tallyframe.session import release, stored

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Vectors of a block, and bits of each component that place a vector on the curve.
BLOCK, CURVE_BITS = 64, 4
#: Whole numbers beyond this could not have their squared distances summed in 64 bits.
MOST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of whole numbers below 2**bits) on a Hilbert curve, as rows of bytes that sort alike."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    top = np.uint32(1 << (bits - 1))
    # Undo the turns and mirrorings of every level, from the coarsest on.
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    # Gray code.
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint32)
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= turn
    planes = [(x[i] >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.array(planes, dtype=np.uint8).reshape(bits * n, -1).T, axis=1)


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of every component, of rows with an id and exactly ``width`` finite components.

    Rows with a component of 2**27 or more after scaling are left out too: their distances do not fit 64 bits.
    """
    x = F.col("embedding")
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) == width) & finite("embedding"))
    small = usable.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).where(
        ~F.exists("v", lambda c: F.abs(c) >= MOST)
    )
    return small.withColumn("v", F.col("v").cast("array<long>"))


def _keyed(low: np.ndarray, high: np.ndarray):
    """Adds each vector's place on the curve, over boxes between the least and the greatest values of all vectors."""
    step = np.maximum((high - low + (1 << CURVE_BITS)) >> CURVE_BITS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = hilbert_keys((matrix(batch.column("v"), len(low)) - low) // step, CURVE_BITS)
                places = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, places], names=["vec_id", "v", "place"])

    return run


def _blocked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width)
            starts = np.arange(0, len(rows), BLOCK)
            if not len(rows):
                continue
            at = pa.array(np.append(starts, len(rows)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(at, pa.array(ids)),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)) * width, pa.int32()), pa.array(rows.reshape(-1))),
                    lists(np.minimum.reduceat(rows, starts, axis=0)),
                    lists(np.maximum.reduceat(rows, starts, axis=0)),
                ],
                names=["ids", "rows", "low", "high"],
            )

    return run


def blocks_of(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks (ids, rows, low, high) of up to BLOCK neighbours on the curve, stored. Vectors are dealt out by ranges of
    the curve, equal ones by id, so that no place holds up a task."""
    each = [F.col("v")[i] for i in range(width)]
    ends = vectors.agg(*[F.min(c).alias(f"low{i}") for i, c in enumerate(each)], *[F.max(c).alias(f"high{i}") for i, c in enumerate(each)])
    ends = np.array([value or 0 for value in ends.first()], dtype=np.int64)
    keyed = stored(with_small_batches(vectors).mapInArrow(_keyed(ends[:width], ends[width:]), "vec_id long, v array<long>, place binary"), "keyed")
    order = ["place", "vec_id"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")
    schema = "ids array<long>, rows array<long>, low array<long>, high array<long>"
    return stored(sorted_.mapInArrow(_blocked(width), schema), "blocks", replaces=[keyed])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For every box (row of low and high) which centroids can be the nearest of a point inside."""
    below, above = low[:, None, :] - centroids, centroids - high[:, None, :]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    least, most = (near * near).sum(axis=2), (far * far).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(rows: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray):
    """(cluster, squared distance) of the rows of blocks, ``counts`` rows in each; ties go to smaller numbers."""
    cluster, distance = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    own_squares, squares = (rows * rows).sum(axis=1), (centroids * centroids).sum(axis=1)
    ends = np.cumsum(counts)
    maybe = candidates(low, high, centroids)
    # Blocks with the same candidates go together.
    _, first, kind = np.unique(np.packbits(maybe, axis=1), axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    owner = np.repeat(np.arange(len(counts)), counts)
    for k, b in enumerate(first):
        chosen = np.flatnonzero(maybe[b])
        at = np.flatnonzero(kind[owner] == k)
        between = own_squares[at, None] + squares[chosen] - 2 * exact_product(rows[at], centroids[chosen])
        best = between.argmin(axis=1)
        cluster[at], distance[at] = chosen[best], between[np.arange(len(at)), best]
    return cluster, distance


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray):
    ids, width = batch.column("ids"), centroids.shape[1]
    counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = batch.column("rows").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    low, high = matrix(batch.column("low"), width), matrix(batch.column("high"), width)
    parts = [np.zeros((2, 0), np.int64)]
    boxes, ends = 256, np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(counts), boxes):
        b = min(a + boxes, len(counts))
        parts.append(np.stack(nearest(rows[ends[a] : ends[b]], counts[a:b], low[a:b], high[a:b], centroids)))
    return ids.flatten(), rows, *np.concatenate(parts, axis=1)


def _sums(centroids: np.ndarray):
    """Per task and cluster, the sum of every component; the count stands as one component more."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            _, rows, cluster, _ = _assigned(batch, centroids)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            if len(held):
                total[held, :width] += np.add.reduceat(rows[order], starts, axis=0)
                total[held, width] += np.diff(np.append(starts, len(order)))
        cluster, component = np.nonzero(np.broadcast_to(total[:, width:] > 0, total.shape))
        columns = [pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(total[cluster, component])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "value"])

    return run


def _labelled(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, cluster, distance = _assigned(batch, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return run


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of "<seed>:<vec_id>"; rows that repeat an id follow each other by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select("v").orderBy(digest, "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of their vectors' components, those without vectors as before.

    Sums are made task by task, then by cluster and component; k * (width + 1) numbers come to the driver.
    """
    sums = blocks.mapInArrow(_sums(centroids), "cluster int, component int, value long")
    rows = sums.groupBy("cluster", "component").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    at = {(r.cluster, r.component): int(r.value) for r in rows}
    out, width = centroids.copy(), centroids.shape[1]
    for cluster in {c for c, _ in at}:
        out[cluster] = [at[cluster, i] // at[cluster, width] for i in range(width)]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: str = SEED):
    """(assigned, centroids) of ``vectors`` (vec_id, v), v being ``width`` whole numbers below 2**27: after the rounds, a
    stored table with vec_id, cluster and squared distance of each vector, and the centroids as a matrix.

    Repeated rows count as vectors of their own. Fewer than k vectors are as many centroids. No vectors give no rows.
    """
    vectors = stored(vectors, "vectors")
    centroids = first_centroids(vectors, k, seed)
    blocks = blocks_of(vectors, width)
    release(vectors)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids.reshape(0, width)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    return stored(blocks.mapInArrow(_labelled(centroids), schema), "assigned", replaces=[blocks]), centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings, with the inertia of each cluster and of all. Rows without id, of another length or with
    a missing or non-finite component take no part; repeated rows and empty tables are as for ``cluster``."""
    assigned, centroids = cluster(whole_vectors(read_table(spark, sf_dir, "embeddings")))
    # One row per centroid, CENTROIDS of them at most: they may come to the driver and go to every task.
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    everything = sum(int(r.inertia) for r in sums)
    rows = [
        (r.cluster, int(r.inertia), everything, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest())
        for r in sums
    ]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", *named.columns[1:])


_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i]))) AS BIGINT)"


def _oracle(rounds: int = ROUNDS) -> str:
    """All distances to all centroids, round by round."""
    parts = [
        f"""v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = {WIDTH}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
    SELECT k, e AS c
    FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), e) - 1 AS k, e FROM v)
    WHERE k < {CENTROIDS}
)""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
    SELECT r, k, d
    FROM (SELECT v.r, c.k, {_DISTANCE} AS d FROM v, c{i} c)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (
    SELECT k, i, CAST(floor(sum(v.e[i])::DOUBLE / count(*)) AS BIGINT) AS x
    FROM a{i} JOIN v USING (r), range(1, {WIDTH + 1}) t(i)
    GROUP BY k, i
),
c{i + 1} AS MATERIALIZED (
    SELECT k, coalesce(any_value(n.c), any_value(o.c)) AS c
    FROM c{i} o LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM m{i} GROUP BY k) n USING (k)
    GROUP BY k
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.k"""


ORACLE = _oracle()
