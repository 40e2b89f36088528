import math

import numpy as np

from scriptorium.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long"


def plain(rows, k=10):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(good):
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(good) if n != own))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def got(spark, rows):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op5_topk(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist()) for i in rng.choice(5000, 900, replace=False)]
    rows += [(100 * i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(60, 70)]
    hot = rng.normal(size=16).astype(np.float32).tolist()
    rows += [(10_000 + i, hot) for i in range(300)]  # ties
    rows += [(None, hot), (20_000, None), (20_001, [1.0, None]), (20_002, [math.inf] * 16), (20_003, [math.nan] * 16), (20_004, [])]
    assert got(spark, rows) == plain(rows)


def test_small_and_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0, 2.0])]) == []
    assert got(spark, [(100, [1.0, 2.0]), (3, [1.0]), (3, [1.0])]) == [(100, 1, 3, 1024 * 1024), (100, 2, 3, 1024 * 1024)]


def test_tiles_and_pruning():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 100
    v = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 8)))
    q = np.floor(centres + rng.normal(size=(20, 8)))
    query, row, _, share = topk.tile_topk(q, v, 5, block=100)
    assert share < 0.5  # most blocks are ruled out
    floors = [int(np.sort(v[:100] @ x)[-5]) for x in q]
    assert topk.tile_topk(q, v, 5, floors, block=100)[3] <= share
    for found in ((query, row), topk.tile_topk(q, v, 5, floors, block=100)[:2]):
        for i in range(20):
            s = v @ q[i]
            assert found[1][found[0] == i].tolist() == np.lexsort((np.arange(2000), -s))[:5].tolist()


def test_repeated_ids_queries_and_shards(spark, monkeypatch):
    """Rows that share an id are candidates and queries of their own; several shards and chunks give the same."""
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist()) for i in rng.integers(0, 12, 400) * 50]
    rows += [(100, [2.0, 1.0, 0.0, 0.0])] * 30
    assert got(spark, rows) == plain(rows)
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "CHUNK", 40)
    assert got(spark, rows) == plain(rows)


def test_text_ids_and_foreign_queries(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 5.0]), ("c", None)], "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("b", [1.0, 0.0])], rows.schema)
    assert [tuple(r) for r in topk.inner_product_topk(rows, asked, 3).orderBy("rank").collect()] == [("b", 1, "a", 2**20), ("b", 2, "b", 2**20)]


def test_large_components_stay_exact(spark):
    rows = [(100, [1e6, 1.0]), (1, [1e6, 0.5]), (2, [1e6 + 1, 3.0]), (3, [1e6, 1.5])]
    assert got(spark, rows) == plain(rows)
    assert [r[3] for r in got(spark, [(100, [1e15]), (1, [1e15]), (2, [-1e15])])] == [2**63 - 1, -(2**63)]
