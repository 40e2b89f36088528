"""Queries over all pairs that their operator's rule keeps, against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.operators import relations, signals
from scriptorium.plans import QUERIES


def jaccard_of(x, y):
    return len(x & y) / len(x | y) if x or y else 0.0


SIGNALS = "id long, value string"


def plain_edges(semantic, authors, tags, ids):
    """Every pair, by the rule as it stands."""
    total = {p: 0.75 * semantic(*p) + 0.15 * jaccard_of(authors.get(p[0], set()), authors.get(p[1], set())) + 0.10 * jaccard_of(tags.get(p[0], set()), tags.get(p[1], set())) for p in itertools.combinations(sorted(ids), 2)}
    return {p: w for p, w in total.items() if w >= 0.08}


def signal_tables(spark, rng, ids, hot=True):
    """Authors and tags; some frequent, some of one paper only, some papers without any."""
    authors = {i: {f"a{rng.randrange(400)}" for _ in range(rng.randrange(4))} | ({"everyone"} if hot and i % 3 == 0 else set()) for i in ids}
    tags = {i: {f"t{rng.randrange(12)}" for _ in range(rng.randrange(3))} for i in ids}
    tables = [signals.ordered_sets(spark.createDataFrame([(i, v) for i, s in x.items() for v in s] + [(i, None) for i in ids[:3]], SIGNALS)) for x in (authors, tags)]
    return authors, tags, tables


@pytest.mark.parametrize("tile", [7, 1000])
def test_edges_of_dense_vectors(spark, tile):
    rng, nrng = random.Random(1), np.random.default_rng(1)
    ids = rng.sample(range(1000), 70)
    v = {i: x / np.linalg.norm(x) for i, x in zip(ids, nrng.normal(size=(70, 5)), strict=True)}
    authors, tags, tables = signal_tables(spark, rng, ids)
    plain = plain_edges(lambda a, b: max(0.0, (v[a] @ v[b] - 0.4) / 0.6) ** 2, authors, tags, ids)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id long, v array<double>")
    got = {(r.a, r.b): r.weight for r in signals.signal_pairs(df, tables, dense=True, scale=signals.rescaled, tile=tile).collect()}
    assert got == pytest.approx(plain) and len(plain) > 100


@pytest.mark.parametrize("tile", [7, 40, 1000])
@pytest.mark.parametrize("seed", [2, 3])
def test_edges_of_sparse_vectors(spark, seed, tile):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 90)
    vocabulary = [f"w{i}" for i in range(150)]
    words = {i: rng.choices(vocabulary, weights=[1 / (k + 1) ** 1.3 for k in range(150)], k=rng.choice((1, 3, 30, 80))) for i in ids}
    df = {w: sum(w in own for own in words.values()) for w in vocabulary}
    weight = {i: {w: own.count(w) / len(own) * max(1e-4, np.log(90 / (1 + df[w]))) for w in own} for i, own in words.items()}
    norm = {i: np.sqrt(sum(x * x for x in own.values())) for i, own in weight.items()}
    cosine = lambda a, b: sum(x * weight[b].get(w, 0.0) for w, x in weight[a].items()) / (norm[a] * norm[b])
    authors, tags, tables = signal_tables(spark, rng, ids, hot=seed == 2)
    rows = spark.createDataFrame([(i, w, float(x), df[w]) for i, own in weight.items() for w, x in own.items()], "id long, term string, weight double, df long")
    vectors = signals.ordered_vectors(rows)
    got = {(r.a, r.b): r.weight for r in signals.signal_pairs(vectors, tables, tile=tile).collect()}
    assert got == pytest.approx(plain_edges(cosine, authors, tags, ids))
    # a higher threshold, with bounds of its own
    high = {p: w for p, w in plain_edges(cosine, authors, tags, ids).items() if w >= 0.6}
    found = signals.signal_pairs(vectors, tables, least=0.6, bounds=(0.6, 0.5, 0.7), tile=tile)
    assert {(r.a, r.b): r.weight for r in found.collect()} == pytest.approx(high)


def test_high_thresholds_send_few_copies(spark):
    """Vectors that share a frequent term only go nowhere but to their own tile; pairs of copies still meet."""
    rng = random.Random(4)
    rows = [(i, "all", 0.2, 400) for i in range(400)] + [(i, f"w{i // 2 if i < 40 else 1000 + i}", 1.0, 2 if i < 40 else 1) for i in range(400)]
    vectors = signals.ordered_vectors(spark.createDataFrame(rows, "id long, term string, weight double, df long"))
    none = signals.ordered_sets(spark.createDataFrame([], SIGNALS))
    assert rng and {(r.a, r.b) for r in signals.signal_pairs(vectors, [none, none], least=0.6, bounds=(0.8, 0.0, 0.0), tile=20).collect()} == {(i, i + 1) for i in range(0, 40, 2)}
    docs = vectors.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(20)).cast("int"))
    assert signals.routed(docs, [signals.cosine_prefix(F.col("v"), 0.8)], 20).count() < 400 + 80


def test_edge_queries(spark, data):
    """The registered queries read authors and tags of the tables; their SQL is compared in test_oracle.py."""
    edges = {(r.src, r.dst): r.weight for r in QUERIES["similarity_edges"](spark, data).collect()}
    assert edges == {(r.a, r.b): r.weight for r in QUERIES["edge_hybrid"](spark, data).collect()} and edges


def test_any_number_of_signals(spark):
    """A raw cosine and three sets; and bounds that could lose a pair are refused."""
    rng, nrng = random.Random(11), np.random.default_rng(11)
    v = nrng.normal(size=(50, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sets = [{i: {f"v{rng.randrange(20)}" for _ in range(rng.randrange(5))} for i in range(50)} for _ in range(3)]
    tables = [signals.ordered_sets(spark.createDataFrame([(i, x) for i, own in one.items() for x in own], SIGNALS)) for one in sets]
    weights = (0.4, 0.3, 0.2, 0.1)
    plain = {(a, b): weights[0] * float(v[a] @ v[b]) + sum(w * jaccard_of(one[a], one[b]) for w, one in zip(weights[1:], sets, strict=True)) for a, b in itertools.combinations(range(50), 2)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = signals.signal_pairs(df, tables, weights, 0.3, None, dense=True, tile=13)
    assert {(r.a, r.b): r.weight for r in got.collect()} == pytest.approx({p: w for p, w in plain.items() if w >= 0.3})
    with pytest.raises(ValueError, match="bounds"):
        signals.signal_pairs(df, tables, weights, 0.3, (0.5, 0.5, 0.5, 0.5))


def plain_relation(a, b, neural):
    """The rules in their order for papers (id, year, all words, words of the abstract)."""
    (_, ya, x, bx), (_, yb, y, by) = a, b
    both, j = x & y, len(x & y) / len(x | y) if x | y else 0.0
    if j < 0.05 and len(both) < 3:
        return None
    m = len(both & set(config.METHOD_WORDS))
    either = lambda words: bool((bx | by) & set(words))
    if m:
        kind, c = "METHODOLOGY", min(0.85, 0.55 + 0.1 * m)
    elif either(config.CONTRADICT_WORDS) and j > 0.08:
        kind, c = "CONTRADICTS", min(0.75, 0.45 + 2 * j)
    elif either(config.EXTEND_WORDS) and ya != yb:
        kind, c = "EXTENDS", min(0.80, 0.5 + 2.5 * j)
    elif j >= 0.10 or len(both) >= 4:
        kind, c = "SUPPORTS", min(0.75, 0.4 + 3 * j)
    elif neural is not None and neural >= 0.60:
        kind, c = "SUPPORTS", min(0.70, 0.35 + 0.5 * neural)
    else:
        return None
    if neural is not None and neural >= 0.75:
        c = min(0.95, c * 1.15)
    elif neural is not None and 0 <= neural < 0.30:
        c *= 0.70
    return kind, c


@pytest.mark.parametrize("tile", [23, 1000])
def test_relationships_of_all_related_pairs(spark, tile):
    rng, nrng = random.Random(7), np.random.default_rng(7)
    plain_words = [f"term{i}" for i in range(400)]
    cues = [*config.METHOD_WORDS[:8], *config.CONTRADICT_WORDS[:3], *config.EXTEND_WORDS[:3]]
    text = lambda n: " ".join(rng.choice(plain_words) if rng.random() < 0.985 else rng.choice(cues) for _ in range(n))
    papers = [(i, text(rng.randrange(6)), rng.choice([None, text(rng.randrange(1, 40))]), 2000 + rng.randrange(4)) for i in range(200)]
    v = {i: x / np.linalg.norm(x) for i, x in zip(range(0, 200, 2), nrng.normal(size=(100, 3)), strict=True)}
    df = spark.createDataFrame(papers, "id long, title string, abstract_text string, year int")
    vectors = spark.createDataFrame([(i, (3 * x).tolist()) for i, x in v.items()], "id long, v array<double>")
    split = lambda t: {w for w in (t or "").split() if len(w) >= 3 and w not in config.STOP_WORDS}
    own = [(i, y, split(t) | split(b), split(b)) for i, t, b, y in papers]
    plain = {}
    for a, b in itertools.combinations(own, 2):
        found = plain_relation(a, b, float(v[a[0]] @ v[b[0]]) if a[0] in v and b[0] in v else None)
        if found:
            plain[(a[0], b[0]) if a[1] >= b[1] else (b[0], a[0])] = found
    got = {(r.source, r.target): (r.type, r.confidence) for r in relations.relationships(relations.relationship_facts(df, vectors), tile).collect()}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in plain.items()}
    assert {p: c for p, (_, c) in got.items()} == pytest.approx({p: c for p, (_, c) in plain.items()})
    assert {k for k, _ in plain.values()} == set(relations.KINDS) and len(plain) > 300
    alone = relations.relationships(relations.relationship_facts(df), tile).collect()
    assert {r.type for r in alone} <= set(relations.KINDS)


def test_set_pairs_by_shared_values(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(60), rng.choice((2, 3, 5, 25, 40)))) for i in range(50)}
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "k long, v long")
    plain = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4 or len(sets[a] & sets[b]) >= 3}
    assert {(r.a, r.b) for r in relations.set_pairs(rows, "k", "v", 0.4, 3).collect()} == plain
