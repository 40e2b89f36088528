"""Graph queries over the whole edge table, against plain loops."""

import itertools

import numpy as np
import pytest

from scriptorium.operators import frontiers, graph
from scriptorium.plans import QUERIES
from scriptorium.plans import adapters as views


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    rng = np.random.default_rng(8)
    spark.createDataFrame([(i, rng.normal(size=10).tolist(), i % 3) for i in range(24)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    # author 9 shares one paper with 1
    lines = [(p, a, n) for p in range(4) for n, a in enumerate((1, 2, 3))] + [(9, 1, 0), (9, 9, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


@pytest.fixture(scope="module")
def edges(spark, tables):
    rows = views.edges(spark, tables).collect()
    assert any(r.weight < 0.4 for r in rows)
    return [(r.src, r.dst, r.type) for r in rows]


def near(edges):
    out = {v: set() for v in range(24)}
    for a, b, *_ in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def reached(around, v):
    seen, todo = {v}, [v]
    while todo:
        for w in around[todo.pop()] - seen:
            seen.add(w)
            todo.append(w)
    return seen


def test_components_and_orphans(spark, tables, edges):
    around = near(edges)
    assert {r.id: r.component for r in QUERIES["graph_components"](spark, tables).collect()} == {v: min(reached(around, v)) for v in around if around[v]}
    assert {r.id for r in QUERIES["orphans"](spark, tables).collect()} == {v for v in around if not around[v]}


def test_ego_and_common_neighbours(spark, tables, edges):
    around, typed = near(edges), near([e for e in edges if e[2] != "RELATED"])
    two = {(v, w) for v in around for w in {v} | around[v] | {x for u in around[v] for x in around[u]}}
    assert {(r.centre, r.id) for r in QUERIES["ego_2hop"](spark, tables).collect()} == two
    common = {(a, b): len(typed[a] & typed[b]) for a, b, _ in edges if typed[a] & typed[b]}
    assert {(r.src, r.dst): r.common for r in QUERIES["common_neighbours"](spark, tables).collect()} == common


def test_bridges(spark, tables, edges):
    pairs = {(a, b) for a, b, _ in edges}
    plain = {p for p in pairs if p[1] not in reached(near(pairs - {p}), p[0])}
    assert {(r.src, r.dst) for r in QUERIES["bridges"](spark, tables).collect()} == plain


def test_betweenness_of_all_edges(spark, tables, edges):
    around = near(edges)

    def shortest(a, b):
        paths = [[a]]
        while paths:
            if done := [p for p in paths if p[-1] == b]:
                return done
            paths = [p + [w] for p in paths for w in around[p[-1]] if w not in p]
        return []

    plain = dict.fromkeys(((a, b) for a, b, _ in edges), 0.0)
    for a, b in itertools.combinations(around, 2):
        if b in reached(around, a):
            found = shortest(a, b)
            for p in found:
                for x, y in itertools.pairwise(p):
                    plain[min(x, y), max(x, y)] += 1 / len(found)
    got = {(r.src, r.dst): r.betweenness for r in QUERIES["edge_betweenness"](spark, tables).collect()}
    assert got == pytest.approx(plain, abs=1e-5)
    ordered = sorted(got.values(), reverse=True)
    limit = ordered[min(max(1, len(got) // 10), len(got) - 1)]
    assert {(r.src, r.dst) for r in QUERIES["bridge_edges"](spark, tables).collect()} == {p for p, x in got.items() if x >= limit}


def test_communities_take_all_coauthors(spark, tables):
    found = {r.id: r.community for r in QUERIES["lpa_communities"](spark, tables).collect()}
    assert set(found) == {1, 2, 3, 9}
    assert found == {r.id: r.community for r in graph.communities(graph.coauthor_edges(views.paper_authors(spark, tables))).collect()}


@pytest.mark.parametrize("nodes,links", [(40, 45), (60, 55), (30, 200), (25, 25)])
def test_certificates_have_all_components_and_bridges(spark, nodes, links, monkeypatch):
    """Many more links than nodes leave a task as few; equal, reversed and looped ones and such without an end too."""
    rng = np.random.default_rng(links)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, nodes, (links, 2))]
    rows += [(b, a) for a, b in rows[::3]] + rows[::4] + [(nodes + 5, nodes + 5), (nodes + 7, nodes + 8)]
    around = {v: set() for v in range(nodes + 9)}
    for a, b in rows:
        around[a].add(b)
        around[b].add(a)
    parts = {v: min(reached(around, v)) for v in around if around[v]}
    bridges = set()
    for a, b in {(min(e), max(e)) for e in rows if e[0] != e[1]}:
        without = {v: n - ({b} if v == a else {a} if v == b else set()) for v, n in around.items()}
        if b not in reached(without, a):
            bridges.add((a, b))
    for partitions in (1, 3):
        df = spark.createDataFrame(rows, "src long, dst long").repartition(partitions)
        assert {r.id: r.component for r in graph.components(df).collect()} == parts
        assert {tuple(r) for r in frontiers.true_bridges(df).collect()} == bridges
    assert graph.certificate(df.coalesce(1), 2).count() <= 2 * (nodes + 9)
    assert graph.certificate(spark.createDataFrame([(None, 1), (1, 2)], "src long, dst long"), 2).count() == 2


def test_forests_tell_most_edges_at_once(monkeypatch):
    """The parts of a while ago, and those of now, give the same edges."""
    rng = np.random.default_rng(5)
    forest, seen = graph._Forest(), {}
    find = lambda v: v if seen.setdefault(v, v) == v else find(seen[v])
    for _ in range(40):
        a, b = rng.integers(0, 3000, (2, 2000))
        kept = forest.add(a, b, set())
        for v, w, k in zip(a.tolist(), b.tolist(), kept.tolist(), strict=True):
            new = v not in seen and v == w
            x, y = find(v), find(w)
            seen[x] = y
            assert k == (x != y or new)
    assert len(forest.ids) and forest.late < 4096 + 3000


def test_two_hops_in_strips(spark):
    """A block is read in strips, whatever its neighbours, and gives the same bits as at once."""
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(-50, 50, n)) for n in (1, 9, 40, 2, 70, 5)]
    packed = [graph.packed_rising(x) for x in lists]
    whole = lambda x: np.array(x, np.int64).tobytes()
    block = graph._Near({"id": whole(range(6)), "centre": b"\1" * 6, "counts": whole([len(x) for x in lists]), "sizes": whole([len(x) for x in packed]), "near": b"".join(packed)})
    seen, old = {}, graph.STRIP
    for graph.STRIP in (old, 20, 1):
        parts = list(block.strips())
        assert [x.tolist() for _, _, x in parts] == [np.concatenate(lists[rows]).tolist() for rows, _, _ in parts]
        seen[graph.STRIP] = len(parts), *(x.tolist() for x in block.table())
    graph.STRIP = old
    assert seen[old][0] == 1 < seen[20][0] < seen[1][0] == 6 and seen[old][1:] == seen[20][1:] == seen[1][1:]
