"""Whole results of queries on pairs, and steps that must not grow faster than their input."""

import itertools

import pytest

from scriptorium.plans import QUERIES


def test_rescaled_cosines_of_all_pairs(spark, data):
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    rows = QUERIES["neural_rescale"](spark, data)
    assert rows.count() == n * (n - 1) // 2 and rows.filter("weight = 0").count()


@pytest.fixture(scope="module")
def copies(spark):
    """600 papers: 300 with one title, others alike in part; dois and years shared by some."""
    words = [(i, w) for i in range(600) for w in (["a", "b", "c", "d"] if i % 2 else [f"x{i % 40}", "y", f"z{i % 3}", "a"])]
    papers = [(i, None if i % 5 == 0 else f"10.1/{'A' if i % 7 else 'a'}{i % 90}", None if i % 31 == 0 else 2000 + i % 4) for i in range(600)]
    return spark.createDataFrame(words, "id long, word string"), spark.createDataFrame(papers, "id long, doi string, year int"), words, papers


def plain_pairs(words, papers, least):
    sets = {}
    for i, w in words:
        sets.setdefault(i, set()).add(w)
    for (a, da, ya), (b, db, yb) in itertools.combinations(papers, 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        yield a, b, round(j, 9), "DOI" if da and db and da.lower() == db.lower() else "TITLE" if j >= least and ya and ya == yb else None


def test_copies_are_paired_without_shuffling_pairs(spark, copies):
    from scriptorium.operators import relations

    words, papers, w, p = copies
    found = relations.set_pairs(words, "id", "word", 0.5)
    assert sorted((r.a, r.b, round(r.jaccard, 9)) for r in found.collect()) == [(a, b, j) for a, b, j, _ in plain_pairs(w, p, 0.5) if j >= 0.5]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Deduplicate" not in plan and plan.index("Generate explode") < plan.index("Repartition")  # pairs are made after the last shuffle


def test_duplicates_of_classes(spark, copies):
    from scriptorium.operators import relations

    words, papers, w, p = copies
    near = spark.createDataFrame([(0, 1, 0.95), (1, 3, 0.99), (10, 500, 0.91), (2, 4, 0.5)], "a long, b long, similarity double")
    plain = {(a, b): rule for a, b, _, rule in plain_pairs(w, p, 0.85) if rule}
    for a, b in ((0, 1), (1, 3), (10, 500)):
        plain.setdefault((a, b), "VECTOR")
    got = [(r.a, r.b, r.rule) for r in relations.duplicate_pairs(papers, words, near).collect()]
    assert sorted(got) == sorted((a, b, rule) for (a, b), rule in plain.items())
    anchor = {}
    for i in range(600):
        anchor[i] = min((a for a in range(i) if (a, i) in plain and anchor[a] == a), default=i)
    found = relations.duplicate_groups(near.filter("similarity >= 0.9"), papers, *relations.duplicate_classes(papers, words))
    assert {r.id: r.anchor for r in found.collect()} == anchor


def test_shared_counts_by_bits_and_by_search(monkeypatch):
    import numpy as np

    from scriptorium.operators import graph

    rng = np.random.default_rng(4)
    for spread in (300, 10_000_000):  # as bits, and by search
        sets = [[np.unique(rng.integers(0, spread, rng.integers(0, 60))) for _ in range(20)] for _ in range(2)]
        for side in sets:
            side[0] = np.union1d(side[0], [1, 2, 3])
        rows = [(np.repeat(np.arange(20), [len(x) for x in side]), np.concatenate(side)) for side in sets]
        p, q = (np.array([x.ravel()[i] for i in range(400) if len(sets[0][i // 20]) and len(sets[1][i % 20])]) for x in np.indices((20, 20)))
        monkeypatch.setattr(graph, "TABLE_BITS", 1 << 15)
        assert graph.shared_counts(*rows, p, q).tolist() == [len(np.intersect1d(sets[0][a], sets[1][b])) for a, b in zip(p, q)]


def test_common_neighbours_in_tiles(spark):
    from scriptorium.operators import graph

    kinds = ("RELATED", "EXTENDS", "SUPPORTS")
    edges = [(a, b, kinds[(a * b) % 3]) for a, b in itertools.combinations(range(60), 2) if (a * 7 + b * 11) % 5 < 2]
    edges += [(1, 2, "EXTENDS"), (1, 2, "SUPPORTS"), (1, 2, "RELATED")]  # a pair counts once
    around = {v: set() for v in range(60)}
    for a, b, t in edges:
        if t != "RELATED":
            around[a].add(b), around[b].add(a)
    found = graph.common_neighbours(spark.createDataFrame(edges, "src long, dst long, type string"), tile_links=100)
    plain = {(a, b, len(around[a] & around[b])) for a, b, _ in edges if around[a] & around[b]}
    assert sorted(map(tuple, found.collect())) == sorted(plain)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row for a neighbour of an edge


def test_first_method_links(spark):
    from scriptorium.operators import gaps

    entities = [(p, "METHOD", f"m{(p * 7 + k) % 9}") for p in range(80) for k in range(p % 3 + 1) if p > 5 or p == 2]
    links = [(2, b) for b in range(80) if b % 4] + [(50, 6)]
    c = gaps.Context(None, spark.createDataFrame(entities, "paper_id long, entity_type string, entity_value string"), None, spark.createDataFrame(links, "a long, b long"), 2000)
    whole = sorted(map(tuple, gaps.method_links(c).collect()))
    for n in (5, 200, 10_000):
        assert [tuple(r) for r in gaps.method_links(c, n).orderBy("a", "b").collect()] == whole[:n]


def test_relevance_searches_texts_once_for_a_word(spark):
    from scriptorium.operators import entities

    papers = spark.createDataFrame([(1, "Deep Nets", "on deep LEARNING of nets", 2001), (2, None, "net", 2002), (3, "", None, 2003)], "id long, title string, abstract_text string, year int")
    queries = spark.createDataFrame([(7, ["deep", "net", "deep"]), (8, ["learning"]), (9, [])], "id long, words array<string>")
    found = entities.relevance_scores(papers, queries, ("year",))
    assert sorted(map(tuple, found.collect())) == [(7, 1, 100.0, 2001), (7, 2, 100 / 3, 2002), (7, 3, 0.0, 2003), (8, 1, 100.0, 2001), (8, 2, 0.0, 2002), (8, 3, 0.0, 2003)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_found_in_runs():
    from scriptorium.operators import entities

    words = ["net", "a-b", "deep", "x", "é", "o w", "2"]
    texts = ["networks a-bc é2", "", "to way x", "D" * 5, "deepnet" * 30]
    assert entities.word_finder(words)(texts).tolist() == [[float(w in t) for w in words] for t in texts]


def test_author_boosts_of_a_frequent_word(spark, monkeypatch):
    from scriptorium.operators import entities

    monkeypatch.setattr(entities, "BOOST_PIECE", 8)
    names = {i: ["ana" if i % 3 else "bo", f"s{i % 40}"] for i in range(120)}
    rows = list(names.items())
    found = entities.author_boosts(spark.createDataFrame([(i, [*w, "ana"]) for i, w in rows], "query_id long, q array<string>"), spark.createDataFrame(rows, "author_id long, w array<string>"))
    plain = [(i, j, min(40.0, 15.0 * sum(x in w for x in [*v, "ana"]))) for i, v in rows for j, w in rows]
    assert sorted(map(tuple, found.collect())) == [r for r in plain if r[2]]


def test_norms_of_any_vocabulary_need_no_table_of_terms(spark):
    from scriptorium.operators import lexical

    words = {1: ["a", "b", "a"], 2: ["b", "c"], 3: [], 4: ["a"] * 3000}
    hashed = lexical.hashed_terms(spark.createDataFrame(list(words.items()), "id long, words array<string>"))
    dfs = hashed.selectExpr("explode(array_distinct(h)) AS t").groupBy("t").count().withColumnRenamed("count", "df")
    found = lexical.joined_norms(hashed, dfs, 4)
    df = {"a": 2, "b": 2, "c": 1}
    weigh = lambda w: sum((w.count(t) / len(w) * max(lexical.config.IDF_FLOOR, __import__("math").log(4 / (1 + df[t])))) ** 2 for t in set(w)) ** 0.5
    assert {r.id: r.norm for r in found.collect()} == pytest.approx({i: weigh(w) for i, w in words.items() if w})
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # terms are counted in the document's array


def test_common_neighbours_in_strips(spark):
    """Strips of a few nodes; packed lists with large, negative and repeated ids."""
    import numpy as np

    from scriptorium.operators import graph

    for ids in ([5], [-7, 0, 3], [1 << 40, (1 << 40) + 1], list(range(0, 3000, 7))):
        assert graph.unpacked_rising(graph.packed_rising(np.array(ids))).tolist() == ids
    rng = np.random.default_rng(2)
    edges = [(int(a) - 20, int(b) - 20 + (1 << 33) * int(b > 50), "EXTENDS" if k % 4 else "RELATED") for k, (a, b) in enumerate(rng.integers(0, 60, (500, 2))) if a < b]
    edges += edges[:20]
    near = {}
    for a, b, t in edges:
        if t != "RELATED":
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    common = {(a, b): len(near[a] & near[b]) for a, b, _ in edges if a in near and b in near and near[a] & near[b]}
    df = spark.createDataFrame(edges, "src long, dst long, type string")
    for tile, strip in ((1 << 20, 1 << 20), (200, 30), (100, 1)):
        rows = graph.common_neighbours(df, tile, strip).collect()
        assert {(r.src, r.dst): r.common for r in rows} == common and len(rows) == len(common)
