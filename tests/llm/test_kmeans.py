import hashlib
import math

import numpy as np
import pytest

from scriptorium.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def plain(rows, k=8, rounds=10, size=4):
    """Plain rounds over Python's integers."""
    good = [(i, [math.floor(1024 * float(x)) for x in np.array(v, np.float32)]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)
    centroids = [v for _, v in seeds[:k]]
    if not centroids:
        return []
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (dist(v, centroids[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in good]
        for c in range(len(centroids)):
            members = [v for (_, v), o in zip(good, own, strict=True) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = [(i, near(v), v) for i, v in good]
    d = [dist(v, centroids[c]) for _, c, v in own]
    per = [sum(x for x, (_, c, _) in zip(d, own, strict=True) if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cut = lambda x: min(x, 2**63 - 1)
    return sorted(((i, c, cut(x), cut(per[c]), cut(sum(per)), digest[c]) for (i, c, _), x in zip(own, d, strict=True)), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA).repartition(3)
    found = kmeans.op12_clusters(df, size=4, **how)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).astype(np.float32).tolist()) for i in rng.choice(10**6, 700, replace=False)]
    rows += [(10**7 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(200)]  # ties and copies
    rows += [(None, [1.0] * 4), (5, None), (6, [1.0, None, 1.0, 1.0]), (7, [math.inf] * 4), (8, [math.nan] * 4), (9, [1.0] * 3), (10, [])]
    assert got(spark, rows) == plain(rows)


def test_grid_full_of_ties(spark):
    rows = [(i, [float(i % 3), float(i // 3 % 3), float(i // 9 % 3), 0.0]) for i in range(243)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, k=30, rounds=4) == plain(rows, 30, 4)


def test_few_repeated_and_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, [1.0] * 4), (3, None)]) == []
    rows = [(1, [0.0] * 4), (1, [2.0] * 4), (1, [2.0] * 4), (2, [-1.0] * 4)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * (scale if i % 2 else 1)).astype(np.float32).tolist()) for i in range(60)]
    assert got(spark, rows) == plain(rows)


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(6)
    centres = rng.integers(-5000, 5000, (40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-80, 80, (4000, 16))).astype(np.int64)
    search = kmeans.Search(centres.tolist())
    own, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000)
    search.nearest(x, own, upper, lower)
    exact = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (own == exact.argmin(axis=1)).all()
    assert (upper >= np.sqrt(exact.min(axis=1)) - 1e-6).all() and (lower <= np.sqrt(np.sort(exact, axis=1)[:, 1]) + 1e-6).all()
    moved = centres + rng.integers(-20, 20, centres.shape)
    computed = kmeans.Search(moved.tolist(), centres.tolist()).nearest(x, own, upper, lower)
    assert (own == ((x[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert computed < 0.1 * exact.size


def test_ids_keep_their_type(spark):
    df = spark.createDataFrame([("a", [1.0] * 4), ("b", [2.0] * 4)], "vec_id string, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in kmeans.op12_clusters(df, size=4).collect()) == [("a", 0), ("b", 0)]
