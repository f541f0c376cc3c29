"""Near-duplicate embeddings by lattice hashing.

In each of several tables a unit vector is projected at random and decoded to points of the E8 lattice, eight projected
components to a point. These points are its own cell; the cells that differ by one of the lattice's 240 shortest vectors
and lie nearest to the projection are probed. Two vectors meet if one has its own cell where the other has its own or
probes; the cosines of those that meet are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, mix, read_table, with_small_batches
from tallyframe.llm.components import components
from tallyframe.llm.vectors import finite, matrix
from tallyframe.session import release, stored

COSINE = 0.93
#: Tables, lattice points of a cell, probed cells, and the length that a unit of distance is projected to. A table brings
#: 0.32 of the pairs at a cosine of 0.93 together, and of unrelated ones 3 in a million, which is what grows with the
#: square of the vectors of a label. With two points, seven tables and 0.5 it is 1 unrelated pair in 800, all told.
TABLES, POINTS, PROBES, SPREAD = 12, 3, 8, 0.45
#: Members of a cell that are compared with each other at a time; rows of one call, at about; cells compared pair by pair.
CHUNK, LOT_ROWS, FEW = 1024, 1 << 13, 32


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    error = x - near
    worst = np.abs(error).argmax(axis=-1)[..., None]
    odd = near.sum(axis=-1, keepdims=True) % 2
    step = np.where(np.take_along_axis(error, worst, -1) >= 0, 1.0, -1.0) * odd
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def e8_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of the E8 lattice to each row of eight numbers: the even points, and those moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=-1) <= ((x - half) ** 2).sum(axis=-1)
    return np.where(nearer[..., None], whole, half)


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 points of the lattice nearest to its origin."""
    units = np.eye(8)
    whole = [s * units[i] + t * units[j] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(signs) for signs in product((0.5, -0.5), repeat=8) if sum(s < 0 for s in signs) % 2 == 0]
    return np.array(whole + halves)


def cells(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """For each row of unit vectors and table its own cell, then its probed ones, as numbers told apart by ``salt``."""
    n, width = unit.shape
    shortest = shortest_vectors()
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.uint64)
    for table in range(TABLES):
        random = np.random.default_rng([table, width])
        projected = (SPREAD * unit) @ random.normal(size=(width, 8 * POINTS))
        projected = projected.reshape(n, POINTS, 8)
        point = e8_point(projected)
        gain = ((projected - point) @ shortest.T).reshape(n, -1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
        cell = np.broadcast_to(point[:, None], (n, 1 + PROBES, POINTS, 8)).copy()
        rows = np.arange(n)
        for p in range(PROBES):
            cell[rows, 1 + p, best[:, p] // len(shortest)] += shortest[best[:, p] % len(shortest)]
        key = mix(salt + U64(table * 1000003 + width))[:, None] * np.ones(1 + PROBES, np.uint64)
        for coordinate in (2 * cell).astype(np.int64).reshape(n, 1 + PROBES, -1).transpose(2, 0, 1):
            key = mix(key * U64(0x9E3779B97F4A7C15) + coordinate.view(np.uint64))
        out[:, table] = key
    return out


def units(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; by their greatest value first, so that no square is too large or too small."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(lengths):
            part = batch.filter(pa.array(lengths == width))
            own = cells(units(matrix(part.column("v"), int(width))), part.column("salt").to_numpy().view(np.uint64))
            each = TABLES * (1 + PROBES)
            at = pa.array(np.arange(part.num_rows + 1) * each, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(own.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "cells"])


def _pairs_of(group: np.ndarray, owns: np.ndarray, low_side: np.ndarray, unit: np.ndarray, cosine: float):
    """Places (i, j) of similar members of one group, of which i owns the cell. ``group`` is sorted; members of different
    sides are compared with each other only, those of side -1 all with all."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    which = np.repeat(np.arange(len(starts)), sizes)
    few = np.flatnonzero(owns & (sizes[which] <= FEW))
    found = []
    step = max(1, (1 << 16) // FEW)
    for a in range(0, len(few), step):
        own = few[a : a + step]
        counts = sizes[which[own]]
        i = np.repeat(own, counts)
        j = np.repeat(starts[which[own]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        found.append(np.stack([i[near], j[near]]))
    for g in np.flatnonzero(sizes > FEW):
        rows = np.arange(starts[g], starts[g] + sizes[g])
        own = rows[owns[rows]]
        i, j = np.nonzero(unit[own] @ unit[rows].T >= cosine)
        found.append(np.stack([own[i], rows[j]]))
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    apart = (i != j) & ((low_side[i] < 0) | (low_side[i] != low_side[j]))
    return i[apart], j[apart]


def _probes(cells_of: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """Whether j probes or owns the cell of i."""
    return (cells_of[j, table] == cells_of[i, table, 0][:, None]).any(axis=1)


def _compared(cosine: float):
    """Links of blocks of cells, each counted where two vectors meet first: (node, copies of the other) summed up, and
    links between ids that hold the same components together."""

    def run(lot: pa.Table) -> pa.Table:
        lot = lot.sort_by([("cell", "ascending"), ("low", "ascending"), ("high", "ascending")]).combine_chunks()
        node, first, copies = (lot[c].to_numpy() for c in ("node", "first", "copies"))
        own_cells = matrix(lot["cells"].combine_chunks(), TABLES * (1 + PROBES)).reshape(len(node), TABLES, 1 + PROBES)
        table, side = lot["table"].to_numpy(), lot["side"].to_numpy()
        label = np.unique(lot["label"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        group = np.cumsum(np.append(0, (np.diff(lot["cell"].to_numpy()) != 0) | (np.diff(lot["low"].to_numpy()) != 0) | (np.diff(lot["high"].to_numpy()) != 0)))
        owns = lot["owns"].to_numpy(zero_copy_only=False)
        lengths = lot["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        sums, spans = [], []
        for width in np.unique(lengths):
            at = np.flatnonzero(lengths == width)
            unit = units(matrix(lot["v"].combine_chunks().take(pa.array(at)), int(width)))
            i, j = _pairs_of(group[at], owns[at], side[at], unit, cosine)
            i, j = at[i], at[j]
            kept = label[i] == label[j]
            # Both own the cell: once is enough. One probes it: unless they meet at the other's own, whose number is less.
            kept &= np.where(owns[j], node[i] < node[j], ~((node[j] < node[i]) & _probes(own_cells, j, i, table[i])))
            i, j = i[kept], j[kept]
            for earlier in range(TABLES - 1):
                met = (table[i] > earlier) & (_probes(own_cells, i, j, earlier) | _probes(own_cells, j, i, earlier))
                i, j = i[~met], j[~met]
            sums.append((np.concatenate([node[i], node[j]]), np.concatenate([copies[j], copies[i]])))
            spans.append(np.stack([np.minimum(first[i], first[j]), np.maximum(first[i], first[j])], axis=1))
        nodes = np.concatenate([a for a, _ in sums] or [np.zeros(0, np.int64)])
        weights = np.concatenate([b for _, b in sums] or [np.zeros(0, np.int64)])
        nodes, which = np.unique(nodes, return_inverse=True)
        totals = np.zeros(len(nodes), np.int64)
        np.add.at(totals, which, weights)
        links = _spanning(np.unique(np.concatenate(spans or [np.zeros((0, 2), np.int64)]), axis=0))
        counted = pa.table({"node": nodes, "links": totals, "a": pa.nulls(len(nodes), pa.int64()), "b": pa.nulls(len(nodes), pa.int64())})
        none = pa.nulls(len(links), pa.int64())
        return pa.concat_tables([counted, pa.table({"node": none, "links": none, "a": links[:, 0], "b": links[:, 1]})])

    return run


def _spanning(links: np.ndarray) -> np.ndarray:
    """Links that hold together what the given ones do, one for each id but the first of a component."""
    ids, ends = np.unique(links, return_inverse=True)
    ends = ends.reshape(links.shape)
    lead = np.arange(len(ids))
    while True:  # every end takes the lesser lead of the two, until nothing changes
        least = np.minimum(lead[ends[:, 0]], lead[ends[:, 1]])
        before = lead.copy()
        np.minimum.at(lead, ends[:, 0], least)
        np.minimum.at(lead, ends[:, 1], least)
        lead = lead[lead]
        if (lead == before).all():
            break
    more = np.flatnonzero(lead != np.arange(len(ids)))
    return np.stack([ids[lead[more]], ids[more]], axis=1)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of equal, non-null labels are linked if their cosine is at least ``cosine`` and they meet in a table. n_links
    counts the other rows linked directly, component_id is the smallest vec_id that links reach, kept says that it is the
    row's own. Equal vectors of a label are always linked; they are one node with so many copies. Recall of other pairs
    is that of the tables: 0.99 at a cosine of 0.93, more above (see the tests).

    Rows whose vector or label is null, whose vector is empty, zero or holds a null or non-finite component, and rows
    without vec_id are linked with nothing; without vec_id component_id is null and kept true. Vectors of different
    lengths are not linked. Rows that repeat an id count one by one, and an id's vectors are in one component. An empty
    table gives an empty result.

    Each pair of nodes is counted where it meets first, so no pair leaves the task that compares it: tasks give sums and
    links that span what they found. Cells with more than CHUNK members are compared in blocks.
    """
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    usable = finite("v") & F.exists("v", lambda c: c != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    nodes = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    salted = with_small_batches(nodes).select("node", "v", F.xxhash64("label").alias("salt"))
    sketched = stored(salted.mapInArrow(_sketched, "node long, cells array<long>"), "cells")
    place = F.col("place")
    members = sketched.select("node", F.posexplode("cells").alias("place", "cell")).select(
        "node", "cell", (place % (1 + PROBES) == 0).alias("owns"), F.floor(place / (1 + PROBES)).cast("int").alias("table")
    )
    met = members.groupBy("cell").agg(F.count("*").alias("size"), F.count_if("owns").alias("owners")).where("size > 1 AND owners > 0")
    shared = stored(members.join(met.select("cell", "size"), "cell"), "members")

    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    split = shared.select("*", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"))
    other = F.col("other")
    blocks = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "cell", "node", "owns", "table", F.least("chunk", other).alias("low"), F.greatest("chunk", other).alias("high"),
        F.when(F.col("chunk") > other, 1).when(F.col("chunk") < other, 0).otherwise(-1).alias("side"),
    )
    lots = max(1, -(-shared.count() // LOT_ROWS))
    lot = F.pmod(F.xxhash64("cell", "low", "high"), F.lit(lots)).alias("lot")
    carried = blocks.join(nodes, "node").join(sketched, "node")
    compared = carried.groupBy(lot).applyInArrow(_compared(cosine), "node long, links long, a long, b long")
    compared = stored(compared, "links", replaces=[shared])
    release(sketched)

    # Ids with several vectors, which are in one component.
    placed = rows.where("v IS NOT NULL").join(nodes.select("label", "v", "node", "first", "copies"), ["label", "v"])
    placed = stored(placed.select("vec_id", "node", "first", "copies"), "placed", replaces=[nodes])
    several = placed.groupBy("vec_id").agg(F.min("first").alias("a"), F.max("first").alias("last")).where("a < last")
    same_id = placed.join(several, "vec_id").select("a", F.col("first").alias("b"))
    linked = components(compared.where("a IS NOT NULL").select("a", "b").unionByName(same_id))
    counted = compared.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    component = F.coalesce("component", "first")
    found = (
        placed.join(counted, "node", "left").join(linked.toDF("first", "component"), "first", "left")
        .select(
            "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            component.alias("component_id"), (component == F.col("vec_id")).alias("kept"),
        )
    )
    alone = rows.where("v IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return found.unionByName(alone)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of a label, at a cosine of 0.93; see ``near_vectors`` for awkward rows."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
