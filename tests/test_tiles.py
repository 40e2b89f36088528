"""Work on pairs goes in tiles whose number, and with it the shuffle for a row, stays the same over a wide range of sizes."""

import random

import numpy as np
import pytest

from scriptorium.operators import graph
from scriptorium.operators import vectors as joins


def test_number_of_tiles():
    assert [joins.sides(n) for n in (0, 1, 600, 4096, 20_000, 400_000)] == [1, 1, 1, 8, 8, 8]
    assert joins.sides(1_000_000) == 16 and joins.sides(100, 30) == 4


def test_links_are_packed_in_few_bytes():
    rng = np.random.default_rng(1)
    ids = np.r_[np.sort(rng.integers(0, 2**40, 500)), -1, 2**62]
    assert graph.unpacked_ids(graph.packed_ids(ids)).tolist() == ids.tolist()
    short, long = np.round(rng.random(500), 6), rng.random(500)
    for w in (short, long, np.empty(0)):
        assert graph.unpacked_weights(graph.packed_weights(w)).tolist() == w.tolist()
    assert len(graph.packed_weights(short)) == 4 * 500 + 1


@pytest.mark.parametrize("tiles", [1, 5])
def test_pagerank_in_blocks(spark, monkeypatch, tiles):
    monkeypatch.setattr(graph, "sides", lambda n: tiles)
    monkeypatch.setattr(graph, "PACKED", 20)
    rng = random.Random(3)
    ids = rng.sample(range(-50, 10**12), 30)
    kinds = ("RELATED", "EXTENDS", None)
    # repeated links add up, some lead to or from what is no node, some nodes have none
    edges = [(rng.choice([*ids[:25], 7, 8]), rng.choice([*ids[:25], 7]), rng.choice(kinds), round(rng.random(), 6) if rng.random() < 0.7 else rng.random()) for _ in range(90)]
    links = [(a, b, w) for s, t, k, w in edges if s != t for a, b in ((s, t), (t, s))[: 1 + (k == "RELATED")]]
    total = {i: sum(w for a, _, w in links if a == i) for i in ids}
    rank = dict.fromkeys(ids, 1 / 30)
    for _ in range(4):
        lost = sum(r for i, r in rank.items() if not total[i])
        rank = {i: 0.15 / 30 + 0.85 * (lost / 30 + sum(rank[a] * w / total[a] for a, b, w in links if b == i and a in rank)) for i in ids}
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    found = graph.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long, type string, weight double"), iterations=4)
    assert {r.id: r.rank for r in found.collect()} == pytest.approx({i: r / max(rank.values()) for i, r in rank.items()})


@pytest.mark.parametrize(("by", "tile_terms"), [("min", 60), ("sum", 1 << 20)])
def test_shared_terms_in_tiles(spark, by, tile_terms):
    from scriptorium.operators import cluster

    rng = random.Random(2)
    # equal weights, that half a millionth among them, and terms beyond the letters
    weight = {i: {t: rng.choice((0.0000125, 0.25, 0.5)) for t in rng.sample([*"abcdefghij", "é", "😀", "￿", ""], rng.randrange(12))} for i in range(40)}
    pairs = [(a, b) for a in range(42) for b in range(a + 1, 42) if rng.random() < 0.4]
    score = lambda x, y: round((min(x, y) if by == "min" else x + y) + 1e-12, 6)
    plain = []
    for a, b in pairs:
        both = {t: score(x, weight[b][t]) for t, x in weight.get(a, {}).items() if t in weight.get(b, {})}
        if both:
            plain.append((a, b, sorted(both, key=lambda t: (-both[t], t.encode()))[:3]))
    rows = spark.createDataFrame([(i, t, w) for i, own in weight.items() for t, w in own.items()], "id long, term string, weight double")
    met = cluster.shared_lists(rows, spark.createDataFrame(pairs * 2, "a long, b long"), 3, by, tile_terms)
    assert sorted(map(tuple, met.collect())) == sorted(plain)
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()  # no row for a term of a pair


def test_dense_signals_in_strips(spark, monkeypatch):
    from scriptorium.operators import signals

    monkeypatch.setattr(signals, "CELLS", 70)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sets = {i: {f"s{(i * k) % 7}" for k in range(i % 4)} for i in range(40)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    rows = signals.ordered_sets(spark.createDataFrame([(i, s) for i, own in sets.items() for s in own], "id long, value string"))
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    plain = {(a, b): w for a in range(40) for b in range(a + 1, 40) if (w := 0.6 * v[a] @ v[b] + 0.4 * jaccard(sets[a], sets[b])) >= 0.3}
    got = {(r.a, r.b): r.weight for r in signals.signal_pairs(df, [rows], (0.6, 0.4), 0.3, None, dense=True).collect()}
    assert got == pytest.approx(plain)


def test_nearest_clusters_in_strips(spark, monkeypatch):
    from scriptorium.operators import cluster

    monkeypatch.setattr(cluster, "CELLS", 70)
    x, n = np.random.default_rng(7).normal(size=(50, 3)), np.arange(50) % 5 + 1
    df = spark.createDataFrame([(i, int(n[i]), x[i].tolist()) for i in range(50)], "id long, n long, v array<double>")
    d = n[:, None] * n / (n[:, None] + n) * ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    got = {r.id: (r.best.nn, r.best.d) for r in cluster.nearest_clusters(df.filter("id % 2 = 0"), df).collect()}
    assert {i: nn for i, (nn, _) in got.items()} == {i: int(d[i].argmin()) for i in range(0, 50, 2)}
    assert {i: far for i, (_, far) in got.items()} == pytest.approx({i: d[i].min() for i in range(0, 50, 2)})


def test_papers_are_packed_in_blocks_of_few_tiles(spark):
    from scriptorium.operators import relations

    rows = [(i, "alpha beta", f"gamma word{i} word{i % 7}", 2000) for i in range(90)]
    facts = relations.relationship_facts(spark.createDataFrame(rows, "id long, title string, abstract_text string, year int").coalesce(2))
    blocks = relations.packed_papers(facts, 10, 3).collect()
    assert sorted(i for b in blocks for i in np.frombuffer(b.id, np.int64)) == list(range(90))
    assert max(b.n for b in blocks) == 10 and {b.tile for b in blocks} == {0, 1, 2}
    # the blocks of 10 all meet, in one tile
    assert relations.relationships(facts, 10).count() == 90 * 89 / 2


def test_sparse_signals_in_blocks(spark, monkeypatch):
    from scriptorium.operators import signals

    rng = random.Random(4)
    docs = {i: {f"t{rng.randrange(30)}": rng.random() + 0.1 for _ in range(rng.randrange(1, 9))} for i in range(60)}
    df = {t: sum(t in v for v in docs.values()) for v in docs.values() for t in v}
    vectors = signals.ordered_vectors(spark.createDataFrame([(i, t, w, df[t]) for i, v in docs.items() for t, w in v.items()], "id long, term string, weight double, df long"))
    sets = [signals.ordered_sets(spark.createDataFrame([(i, f"s{(i * k) % 7}") for i in range(60) for k in range(i % n)], "id long, value string")) for n in (3, 4)]
    found, packed = [], []
    whole = signals.packed_pairs
    monkeypatch.setattr(signals, "packed_pairs", lambda *x: packed.append(x[-1]) or whole(*x))
    for wide in (2, -1):
        monkeypatch.setattr(signals, "WIDE", wide)
        found.append({(r.a, r.b): r.weight for r in signals.signal_pairs(vectors, sets, tile=7).collect()})
    # all 60 papers in one tile, in blocks of 7
    assert packed == [1] and len(found[0]) > 300
    assert found[1] == pytest.approx(found[0])


def test_two_hops_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    rng = random.Random(5)
    ids = rng.sample(range(-50, 10**12), 70)
    # repeated links, loops, ends that are no centre, centres without links
    links = [(rng.choice(ids[:60]), rng.choice(ids[:60])) for _ in range(60)] * 2 + [(ids[0], ids[0])]
    near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in ids}
    plain = sorted((i, j) for i in ids[20:] for j in {i} | near[i] | {x for u in near[i] for x in near[u]})
    met = graph.ego(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(i,) for i in ids[20:] * 2], "id long"))
    assert sorted(map(tuple, met.collect())) == plain
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()  # no row for a path of two links
