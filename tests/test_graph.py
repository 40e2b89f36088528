"""Graph, pair and cluster operators against plain definitions on small inputs."""

import itertools
import random

import numpy as np
import pytest

from scriptorium.operators import cluster, frontiers, graph, relations
from scriptorium.operators.vectors import cosine_topk, pairs_above

EDGE = "src long, dst long, type string, weight double, confidence double"


def random_graph(n=24, m=30, seed=1):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return [(a, b, rng.choice(("RELATED", "EXTENDS")), round(rng.random(), 3) + 0.1, 0.5) for a, b in pairs]


def parts(nodes, pairs):
    label = {v: v for v in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_pagerank_sums_and_matches_a_plain_loop(spark):
    edges = random_graph()
    nodes = list(range(26))
    got = {r.id: r.rank for r in graph.pagerank(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(edges, EDGE)).collect()}
    out = {v: {} for v in nodes}
    for a, b, kind, w, _ in edges:
        out[a][b] = out[a].get(b, 0) + w
        if kind not in graph.DIRECTED:
            out[b][a] = out[b].get(a, 0) + w
    rank = dict.fromkeys(nodes, 1 / 26)
    for _ in range(30):
        lost = sum(rank[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, 0.15 / 26 + 0.85 * lost / 26)
        for v in nodes:
            for w, x in out[v].items():
                new[w] += 0.85 * rank[v] * x / sum(out[v].values())
        rank = new
    assert sum(rank.values()) == pytest.approx(1)
    assert got == pytest.approx({v: r / max(rank.values()) for v, r in rank.items()})
    assert max(got.values()) == 1


def test_components_bridges_and_betweenness(spark):
    edges = random_graph(m=26)
    pairs = [(a, b) for a, b, *_ in edges]
    nodes = sorted({v for p in pairs for v in p})
    df = spark.createDataFrame(edges, EDGE)
    assert {r.id: r.component for r in graph.components(df).collect()} == parts(nodes, pairs)
    count = lambda ps: len(set(parts(nodes, ps).values()))
    plain = {p for p in pairs if count([q for q in pairs if q != p]) > count(pairs)}
    assert {(r.src, r.dst) for r in frontiers.true_bridges(df).collect()} == plain
    near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in nodes}
    expected = dict.fromkeys(pairs, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        paths, front = [], [[s]]
        while front and not paths:
            front = [[*p, w] for p in front for w in near[p[-1]] if w not in p]
            paths = [p for p in front if p[-1] == t]
            if len(front) > 5000 or len(front and front[0]) > 12:
                break
        for p in paths:
            for x, y in itertools.pairwise(p):
                expected[min(x, y), max(x, y)] += 1 / len(paths)
    got = {(r.src, r.dst): r.betweenness for r in frontiers.edge_betweenness(df, 150).collect()}
    assert got == pytest.approx(expected)


def test_betweenness_in_arrays_equals_that_by_joins(spark, monkeypatch):
    path = [(40 + i, 41 + i, "RELATED", 1.0, 1.0) for i in range(9)]
    df = spark.createDataFrame([*random_graph(20, 40, 3), *path, (5, 5, "RELATED", 1.0, 1.0), (41, 40, "RELATED", 1.0, 1.0)], EDGE)
    found = lambda **how: {(r.src, r.dst): r.betweenness for r in frontiers.edge_betweenness(df, **how).collect()}
    assert found() == pytest.approx(found(links=0))
    monkeypatch.setattr(frontiers, "CELLS", 90)  # sources in parts, nodes in stretches
    monkeypatch.setattr(frontiers, "GATHERED", 12)
    assert found() == pytest.approx({**found(links=0)})


def test_path_shares_of_many_equal_paths():
    """A hundred nodes between two ends: each of their links carries a hundredth of the path, and those among neighbours."""
    n = 102
    near = [list(range(1, 101)), *[[0, 101]] * 100, list(range(1, 101))]
    start = np.append(0, np.cumsum([len(x) for x in near]))
    share = frontiers.path_shares(start, np.concatenate(near), np.arange(n))
    # ordered pairs: the two ends 1/100, its own node with each end 1, and half of each pair with another node, both ways
    assert share == pytest.approx(np.full(400, 1 / 100 + 1 + 99 / 2))


def test_orphans_fall_when_edges_are_added(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "id long")
    few, many = random_graph(30, 10), random_graph(30, 40)
    assert graph.orphans(nodes, spark.createDataFrame(many + few, EDGE)).count() <= graph.orphans(nodes, spark.createDataFrame(few, EDGE)).count()


def test_greedy_groups_match_the_sequential_definition(spark):
    pairs = [(a, b) for a, b, *_ in random_graph(30, 35, 5)]
    anchor = {}
    for v in range(30):
        own = [a for a, b in pairs if b == v and anchor[a] == a]
        anchor[v] = min(own) if own else v
    got = relations.duplicate_groups(spark.createDataFrame(pairs, "a long, b long"), spark.range(30))
    assert {r.id: r.anchor for r in got.collect()} == anchor


def test_set_pairs_are_exact(spark):
    rng = random.Random(2)
    sets = {i: set(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(1, 8))) for i in range(60)}
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "k long, v string")
    for least in (0.3, 0.5, 0.85, 1.0):
        plain = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-12}
        assert {(r.a, r.b) for r in relations.set_pairs(rows, "k", "v", least).collect()} == plain


def test_communities(spark):
    clique = lambda ids: [(a, b, 3) for a, b in itertools.combinations(ids, 2)]
    found = {r.id: r.community for r in graph.communities(spark.createDataFrame([*clique(range(5)), *clique(range(10, 15)), (0, 10, 1)], "a long, b long, papers long")).collect()}
    assert len({found[i] for i in range(5)}) == len({found[i] for i in range(10, 15)}) == 1 and found[0] != found[10]


def test_vector_joins_match_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    c = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    s = c @ c.T
    assert {(r.a, r.b) for r in pairs_above(df, 0.4).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.4}
    top = {}
    for r in cosine_topk(df, df, 5).collect():
        top.setdefault(r.query_id, {})[r["rank"]] = r.id
    for i in range(60):
        assert [top[i][k] for k in range(1, 6)] == sorted((j for j in range(60) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:5]


def plain_ward(points):
    """Labels (smallest member) by the sequential method: the pair of least distance first, cut at the first largest jump."""
    members, heights, states = {i: [i] for i in range(len(points))}, [], []
    if len(points) < 4:
        return [0] * len(points)
    while len(members) > 1:
        states.append(list(members.values()))
        mean = {i: points[m].mean(axis=0) for i, m in members.items()}
        cost = lambda a, b: len(members[a]) * len(members[b]) / (len(members[a]) + len(members[b])) * ((mean[a] - mean[b]) ** 2).sum()  # noqa: B023, E731
        h, a, b = min((cost(a, b), a, b) for a, b in itertools.combinations(sorted(members), 2))
        heights.append(h)
        members[a] = members[a] + members.pop(b)
    groups = states[len(points) - cluster.cluster_number(heights)]
    return [min(next(g for g in groups if i in g)) for i in range(len(points))]


def ward_labels(spark, points, **how):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, v array<double>").repartition(3)
    label = {r.id: r.cluster for r in cluster.ward_clusters(df, **how).collect()}
    return [label[i] for i in range(len(points))]


def test_ward_finds_separate_blobs(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(m, 0.05, (12, 3)) for m in 10 * np.eye(3)])  # all at the same distance
    for how in ({}, {"finish": 3, "tile": 7}):
        label = ward_labels(spark, points, **how)
        assert all(len(set(label[k : k + 12])) == 1 for k in (0, 12, 24)) and len(set(label)) == 3
    assert ward_labels(spark, points[:3]) == [0, 0, 0]
    assert [cluster.cluster_number(h) for h in ([1, 1, 1, 1], [1, 1, 1, 9])] == [2, 2]
    assert [cluster.cut_number(5, place) for place in (0, 3)] == [2, 2]


@pytest.mark.parametrize("seed", range(3))
def test_ward_in_rounds_equals_the_sequential_method(spark, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(45, 5)) + rng.integers(0, 3, (45, 1)) * seed
    points[40:] = points[:5] + 8 * (seed == 1)  # copies, or far pairs that are merged early and parted by the cut
    assert ward_labels(spark, points, finish=2 + 3 * seed, tile=16) == plain_ward(points)


def test_heights_of_ward_never_fall(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 2)))], "id long, v array<double>")
    merges = cluster.merge_tree(df, 8, 16).orderBy("height", "round", "place").collect()
    assert len(merges) == 59 and len({r.b for r in merges}) == 59
    gone = set()
    for r in merges:  # whatever is merged is still there
        assert r.a < r.b and not {r.a, r.b} & gone
        gone.add(r.b)
    assert [r.height for r in merges] == pytest.approx(sorted(h for *_, h in cluster.ward(np.random.default_rng(5).normal(size=(60, 2)), np.ones(60))))
    place = int(np.argmax(np.diff([r.height for r in merges]))) + 1
    assert cluster.largest_jump(spark.createDataFrame([(r.height,) for r in merges], "height double").repartition(5)) == (59, place)


def test_bridges_of_trees_and_rings(spark):
    ring = [(i, (i + 1) % 9, "RELATED", 1.0, 1.0) for i in range(9)]
    path = [(20 + i, 21 + i, "RELATED", 1.0, 1.0) for i in range(40)]
    both = [*ring, *path, (8, 20, "RELATED", 1.0, 1.0), (3, 3, "RELATED", 1.0, 1.0), (60, 58, "RELATED", 1.0, 1.0)]
    got = {(r.src, r.dst) for r in frontiers.true_bridges(spark.createDataFrame(both, EDGE)).collect()}
    assert got == {(20 + i, 21 + i) for i in range(38)} | {(8, 20)}
    empty = spark.createDataFrame([], EDGE)
    assert frontiers.true_bridges(empty).collect() == [] and frontiers.edge_betweenness(empty).collect() == []


def plain_ranks(words):
    """A dense matrix of cosines, rows that sum to 1, and the power iteration as it stands."""
    n = len(words)
    df = {w: sum(w in own for own in words) for own in words for w in own}
    vectors = [{w: own.count(w) / len(own) * max(1e-4, np.log(n / (1 + df[w]))) for w in own} for own in words]
    length = [np.sqrt(sum(x * x for x in v.values())) for v in vectors]
    m = np.array([[0.0 if i == j or not vectors[i] or not vectors[j] else sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()) / (length[i] * length[j]) for j in range(n)] for i in range(n)])
    total = m.sum(axis=1, keepdims=True)
    m = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
    rank = np.full(n, 1 / n)
    for _ in range(30):
        new = 0.15 / n + 0.85 * m.T @ rank
        done = np.abs(new - rank).sum() < 1e-4
        rank = new
        if done:
            break
    return rank


@pytest.mark.parametrize("seed", range(4))
def test_sentence_ranks_equal_a_dense_matrix(seed):
    rng = random.Random(seed)
    words = [[rng.choice("abcdefghijkl") for _ in range(rng.choice((0, 1, 4, 9)))] for _ in range(14)]
    words += [["z"] * 5, ["z", "z", "a"], ["alone"]]  # repeated words; nothing in common with any
    assert graph.sentence_ranks(words) == pytest.approx(plain_ranks(words), abs=1e-9)


def test_textrank(spark):
    text = "Short one. The cats sleep on the warm mat all day long. A cat and a mat make cats sleep all day long. Dogs bark loudly at night near houses. The warm mat is where cats sleep all day."
    rows = {r.id: r.summary for r in graph.textrank(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string"), 2).collect()}
    assert "Dogs" not in rows[1] and rows[2] == "" and 3 not in rows
