import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sentence
from scriptorium.llm import toxicity


@pytest.fixture
def corpus(spark, documents, rng):
    bad = ["grubbish", "snorkel", "vilewort"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 6 == 0
        words = sentence(rng, rng.randint(5, 120)).split()
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() if i % 4 else rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy_and_evidence(corpus):
    docs, labels, truth = corpus
    rows = toxicity.op10_toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 180 and len(rows) == 700
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    hit = next(r for r in held if r.predicted)
    assert hit.evidence and hit.evidence[0].toxic == 1 and hit.evidence[0].similarity > 0


def test_scores_do_not_depend_on_ids_or_sources(spark, corpus, documents):
    docs, labels, _ = corpus
    more = documents([(10_000 + i, t) for i, t in enumerate(["grubbish words here", "grubbish words here"])], lambda i: "s" if i % 2 else None)
    a, b = toxicity.op10_toxicity(docs.union(more), labels).filter("doc_id >= 10000").collect()
    assert a.score == b.score > 0.5


def test_null_empty_long_and_unlabelled(spark, corpus, documents):
    docs, labels, _ = corpus
    extra = documents([(20_000, None), (20_001, ""), (20_002, "clean " * 50_000 + "vilewort snorkel grubbish"), (None, "x")])
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(docs.union(extra), labels.union(spark.createDataFrame([(None, 1, 1), (3, 1, None), (99_999, 1, 1)], labels.schema))).collect()}
    assert rows[20_000].score == rows[20_001].score < 0.5 and rows[20_002].predicted == 1
    assert all(r.score == 0 for r in toxicity.op10_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.op10_toxicity(docs.limit(0), labels).count() == 0


def plain_scores(texts, train, truth):
    """Scores and evidence from dictionaries, all pairs: nothing of the index is used but its curve's parameters."""
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    bags = [Counter(split(t)) for t in texts]
    df = Counter(w for b in bags for w in b)
    seen, bad = Counter(w for i in train for w in bags[i]), Counter(w for i in train if truth[i] for w in bags[i])
    base = sum(truth[i] for i in train) / len(train)
    weight = {}
    for w in df:
        a, n = bad[w], seen[w]
        ratio = (a * math.log(a / n / base) if a else 0) + ((n - a) * math.log((1 - a / n) / (1 - base)) if n - a else 0) if n else 0
        weight[w] = (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (1 + toxicity.RELEVANCE * math.sqrt(max(0, ratio - math.log(len(seen)))))
    vectors = []
    for b in bags:
        v = {w: (1 + math.log(n)) * weight[w] for w, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})

    def vote(i, skip=None):
        near = sorted(((-round(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), 9), j) for j in train if j != skip))[: toxicity.NEIGHBOURS]
        near = [(-c, j) for c, j in near if c < 0]
        total = sum(c**3 for c, _ in near)
        return (sum(c**3 * truth[j] for c, j in near) + toxicity.SHRINK * base) / (total + toxicity.SHRINK), near

    return vote


def test_votes_and_neighbours_equal_brute_force(spark, corpus, monkeypatch):
    docs, labels, truth = corpus
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rows = sorted(docs.select("doc_id", "text").collect())
    texts = [r.text for r in rows]
    row, term, count, toxic, ids = toxicity.arrays(toxicity.examples(docs, labels, "doc_id", "text").toArrow())
    assert sorted(ids) == [i for i in range(700) if zlib.crc32(str(i).encode()) % 5] and [truth[i] for i in ids] == toxic.tolist()
    index = toxicity.Index(row, term, count, toxic, *toxicity.frequencies(docs, "text"))
    vote = plain_scores(texts, ids, truth)
    held = [i for i in range(700) if i not in set(ids)]
    text, example, cosine, scored = index.nearest(*toxicity.term_counts([texts[i] for i in held]), len(held))
    assert scored < 0.9 * len(held) * index.blocks
    votes = index.votes(text, example, cosine, len(held))
    for k, i in enumerate(held):
        want, near = vote(i)
        assert votes[k] == pytest.approx(want, abs=1e-6)
        assert cosine[text == k].tolist() == pytest.approx([c for c, _ in near], abs=2e-9)
    out = {r.doc_id: r for r in toxicity.op10_toxicity(docs, labels).collect()}
    index.calibrate(row, term, count)
    curve = lambda v: 1 / (1 + math.exp(-(index.a * math.log(v / (1 - v)) + index.b)))
    for i in held:
        want = curve(min(max(vote(i)[0], 1e-4), 1 - 1e-4))
        assert out[i].score == pytest.approx(want, abs=1e-5) and out[i].predicted == int(out[i].score >= 0.5)
    own = np.array([0, 5, 9])
    pick = np.isin(row, own)
    near = index.nearest(np.searchsorted(own, row[pick]), term[pick], count[pick], 3, own)
    for k, i in enumerate(own):
        assert near[2][near[0] == k].tolist() == pytest.approx([c for c, _ in vote(ids[i], ids[i])[1]], abs=2e-9)


def test_ids_of_any_type(spark, corpus):
    docs, labels, _ = corpus
    text_ids = docs.withColumn("doc_id", F.concat(F.lit("0"), F.col("doc_id").cast("string")))
    own = labels.withColumn("doc_id", F.concat(F.lit("0"), F.col("doc_id").cast("string")))
    rows = toxicity.op10_toxicity(text_ids, own).collect()
    assert len(rows) == 700 and any(r.evidence and isinstance(r.evidence[0].doc_id, str) for r in rows)


def test_the_fold_goes_by_the_documents_id(spark, corpus):
    """Labels whose ids are doubles: 7.0 stands for document 7, and its fold is that of "7"."""
    docs, labels, _ = corpus
    own = labels.withColumn("doc_id", F.col("doc_id").cast("double"))
    ids = lambda given: sorted(r.doc_id for r in toxicity.examples(docs, given, "doc_id", "text").collect())
    assert ids(own) == ids(labels) and all(zlib.crc32(str(i).encode()) % 5 for i in ids(own))


def test_a_text_beyond_the_bound_is_passed_over(spark, corpus, monkeypatch):
    docs, labels, _ = corpus
    sizes = {r.doc_id: r.size for r in toxicity.examples(docs, labels, "doc_id", "text").collect()}
    monkeypatch.setattr(toxicity, "ENTRIES", max(sizes.values()) - 1)
    kept = {r.doc_id: r.size for r in toxicity.examples(docs, labels, "doc_id", "text").collect()}
    assert kept and max(kept.values()) < max(sizes.values()) and set(kept) < set(sizes)


def test_every_label_keeps_a_vector_and_entries_bound_the_fit(spark, corpus, monkeypatch):
    docs, labels, _ = corpus
    row, _, _, toxic, ids = toxicity.arrays(toxicity.examples(docs, labels, "doc_id", "text").toArrow())
    assert np.array_equal(np.unique(row), np.arange(len(ids)))
    monkeypatch.setattr(toxicity, "ENTRIES", 5000)
    few = toxicity.arrays(toxicity.examples(docs, labels, "doc_id", "text").toArrow())
    assert 0 < len(few[1]) <= 5000 and few[4] == ids[: len(few[4])]


def test_small_table(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    assert toxicity.op10_toxicity(docs, labels).count() == docs.count()


def test_a_worker_holds_the_index_in_place_of_the_sample(spark, corpus):
    """Also the worker that fits the curve: it builds the index once, and wide copies of the sample are not kept beside it."""
    docs, labels, _ = corpus
    sample, counts = toxicity.examples(docs, labels, "doc_id", "text"), toxicity.frequencies(docs, "text")
    given = toxicity.sampled(sample, *counts)
    wide = toxicity.Index(*(given[k].astype(np.int64) for k in ("row", "term", "count")), given["toxic"], given["df"].astype(float), given["n"])
    wide.calibrate(*(given[k].astype(np.int64) for k in ("row", "term", "count")))
    index, ids = toxicity.restored(given)
    assert set(given) == {"model"} and (index.a, index.b) == (wide.a, wide.b) != (1.0, 0.0)
    assert toxicity.restored(given, (2.0, -1.0))[0] is index and (index.a, index.b) == (2.0, -1.0) and len(ids) == index.n
    for name in ("weight", "forward", "posting", "value", "terms", "start", "order"):
        assert np.array_equal(getattr(index, name), getattr(wide, name))
