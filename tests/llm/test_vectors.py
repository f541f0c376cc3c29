"""Near-duplicate and clustered vectors against all pairs and plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyframe.llm import clustering, embedding_dedup
from tallyframe.llm.embedding_dedup import e8_point, shortest_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, first long, cluster int"
AWKWARD = [
    (1, [1.0] * 64, 3), (2, [2.0] * 64, 3), (2, [2.0] * 64, 3), (3, [1.0] * 64, None), (4, None, 3), (5, [], 3), (6, [0.0] * 64, 3),
    (7, [math.nan] + [1.0] * 63, 3), (8, [math.inf] + [1.0] * 63, 3), (9, [None] + [1.0] * 63, 3), (None, [1.0] * 64, 3),
    (10, [1.0] * 63, 3), (11, [1.0] * 63, 3), (12, [1.0] * 64, 4), (13, [-1.0] * 64, 3), (2, [-1.0] * 64, 3), (14, [3e38] * 64, 3),
    (15, [1e-30] * 64, 3), (None, None, None),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], SCHEMA)


def links_of(rows, cosine):
    """(position, position) of linked rows, by all pairs."""
    def usable(i, v, label):
        return i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    unit = {}
    for p, row in enumerate(rows):
        if usable(*row):
            x = np.array(row[1], dtype=np.float32).astype(np.float64)
            x = x / np.abs(x).max()
            unit[p] = x / np.linalg.norm(x)
    return {
        (p, q) for p in unit for q in unit
        if p < q and rows[p][2] == rows[q][2] and len(unit[p]) == len(unit[q]) and unit[p] @ unit[q] >= cosine
    }


def expected(rows, links):
    lead = {i: i for i, *_ in rows}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    count = [0] * len(rows)
    for p, q in links:
        count[p] += 1
        count[q] += 1
        a, b = sorted((top(rows[p][0]), top(rows[q][0])))
        lead[b] = a
    return sorted((str(i), count[p], str(top(i)), i is None or top(i) == i) for p, (i, *_) in enumerate(rows))


def found(result):
    assert dict(result.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in result.collect())


def test_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    point = e8_point(x)
    doubled = 2 * point
    assert (doubled == np.rint(doubled)).all() and (point.sum(axis=1) % 2 == 0).all()
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all()
    nearest = ((x - point) ** 2).sum(axis=1)
    around = (((x[:, None] - point[:, None] - shortest_vectors()) ** 2).sum(axis=2)).min(axis=1)
    assert (nearest <= around + 1e-12).all() and nearest.max() <= 1 + 1e-12
    assert len(np.unique(shortest_vectors(), axis=0)) == 240 and ((shortest_vectors() ** 2).sum(axis=1) == 2).all()


def test_awkward_vectors(spark):
    assert found(embedding_dedup.near_vectors(table(spark, AWKWARD).repartition(3))) == expected(AWKWARD, links_of(AWKWARD, 0.93))


def test_empty_tables(spark):
    assert found(embedding_dedup.near_vectors(table(spark, []))) == []
    assert found(embedding_dedup.near_vectors(table(spark, [(1, None, 2)]))) == [("1", 0, "1", True)]


def test_close_groups_and_hot_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)  # read on the driver
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 64))
    rows = []
    for c, size, noise in zip(range(6), (1, 2, 5, 60, 90, 40), (0, 0.01, 0.1, 0.15, 0.02, 0.22)):
        rows += [(len(rows) + k, (centres[c] + noise * rng.normal(size=64)).tolist(), c % 2) for k in range(size)]
    rows += [(1000 + k, centres[5].tolist(), 1) for k in range(120)]
    random.Random(1).shuffle(rows)
    links = links_of(rows, 0.93)
    got = embedding_dedup.near_vectors(table(spark, rows)).collect()
    counts = {r.vec_id: r.n_links for r in got}
    exact = {i: n for i, n, *_ in expected(rows, links)}
    assert all(n <= exact[str(i)] for i, n in counts.items())  # nothing below the cosine
    assert sum(counts.values()) >= 0.98 * 2 * len(links)
    assert {r.vec_id: r.component_id for r in got} == {int(i): int(c) for i, _, c, _ in expected(rows, links)}


@pytest.mark.parametrize(("cosine", "least"), [(0.9301, 0.97), (0.95, 0.99), (0.98, 0.999)])
def test_recall_at_a_cosine(spark, cosine, least):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(1 - cosine**2) * b
    rows = [(2 * i, a[i].tolist(), 0) for i in range(len(a))] + [(2 * i + 1, b[i].tolist(), 0) for i in range(len(a))]
    got = embedding_dedup.near_vectors(table(spark, rows)).where("n_links > 0").count()
    assert got >= least * len(rows)


# --- clusters


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows if clusterable(i, v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = sum(d for _, d, _ in out)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, sum(e for _, e, f in out if f == c), inertia, digest[c]) for i, d, c in out)


def clusterable(i, v):
    return i is not None and v is not None and len(v) == 64 and all(c is not None and abs(c) < 2**19 for c in v)


def clusters(spark, tmp_path, rows):
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    result = clustering.op13_centroid_clustering(spark, str(tmp_path))
    assert dict(result.dtypes) == {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint",
        "centroid_sha256": "string",
    }
    return sorted(tuple(r) for r in result.collect())


def test_clusters_are_those_of_plain_rounds(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 64)) / 8
    rows = [(i, (centres[i % 9] + rng.normal(size=64) / 40).tolist(), 0) for i in range(300)]
    rows += [(500 + i, rows[0][1], 0) for i in range(200)] + rows[5:9]
    assert clusters(spark, tmp_path, rows) == plain_clusters(rows, 40, 5)


def test_clusters_of_awkward_vectors(spark, tmp_path):
    assert clusters(spark, tmp_path, AWKWARD) == plain_clusters(AWKWARD, 40, 5)


def test_clusters_of_nothing(spark, tmp_path):
    assert clusters(spark, tmp_path, [(1, None, 1)]) == []


def test_large_components_are_exact(spark, tmp_path):
    rows = [(i, [float(2**18 + 3 * i)] * 32 + [float(-(2**18)) - i] * 32, 0) for i in range(60)]
    assert clusters(spark, tmp_path, rows) == plain_clusters(rows, 40, 5)


def test_boxes_rule_out_centroids_on_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100, 100, (40, 64))
    rows = np.repeat(centres, 1024, axis=0) + rng.integers(-8, 9, (40 * 1024, 64))
    low = rows.min(axis=0)
    step = np.maximum((rows.max(axis=0) - low + (1 << clustering.CURVE_BITS)) >> clustering.CURVE_BITS, 1)
    keys = clustering.hilbert_keys((rows - low) // step, clustering.CURVE_BITS)
    rows = rows[np.lexsort(keys.T[::-1])]
    starts = np.arange(0, len(rows), clustering.BLOCK)
    maybe = clustering.candidates(np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts), centres)
    assert maybe.mean() < 0.2


def test_the_curve_visits_neighbours():
    for width, bits in ((2, 4), (3, 3)):
        grid = np.indices((1 << bits,) * width).reshape(width, -1).T
        keys = clustering.hilbert_keys(grid, bits)
        path = grid[np.lexsort(keys.T[::-1])]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
