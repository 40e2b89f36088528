import numpy as np
import pytest

from conftest import WORDS, sentence
from scriptorium.llm import decontaminate


@pytest.fixture
def planted(spark, documents, rng):
    items = [(j, sentence(rng, rng.randint(15, 60))) for j in range(30)]
    rows = [(i, sentence(rng, rng.randint(1, 400))) for i in range(200)]
    truth = set()
    for i in range(0, 200, 4):
        j, passage = items[i // 4 % 30]
        words = passage.split()
        if i % 8 == 0:  # a paraphrase: every eighth word another
            words = [rng.choice(WORDS) if k % 8 == 7 else w for k, w in enumerate(words)]
        own = rows[i][1].split()
        at = rng.randint(0, len(own))
        rows[i] = (i, " ".join([*own[:at], *words, *own[at:]]).capitalize())
        truth.add((i, j))
    return documents(rows), spark.createDataFrame(items, "item_id long, text string"), truth


def test_finds_planted_passages_only(planted):
    docs, items, truth = planted
    got = {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(docs, items).collect()}
    assert len(got & truth) >= 0.96 * len(truth)
    assert len(got - truth) <= 0.02 * len(truth)


def test_recall_and_precision_on_the_small_table(spark, data):
    import re

    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    flat = lambda t: " ".join(re.sub(r"[^\w\s]|_", "", (t or "").lower()).split())
    texts = {r.doc_id: f" {flat(r.text)} " for r in docs.collect()}
    truth = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if f" {flat(r.text)} " in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(docs, items).collect()}
    assert truth <= got and len(got - truth) <= 1


def test_long_texts_long_items_and_blocks(spark, documents, rng, monkeypatch):
    item = sentence(rng, 300)
    body = sentence(rng, 30_000)
    docs = documents([(1, f"{body} {item} {body}"), (2, body), (3, "é" * 400_000)])
    items = spark.createDataFrame([(9, item), (8, sentence(rng, 20)), (7, None), (6, ""), (5, "!!!")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_GROUP", 2)  # the parts of an item lie in several groups
    assert {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(docs, items).collect()} == {(1, 9)}


def test_answers_are_checked(spark, documents, rng):
    item, body = sentence(rng, 40), sentence(rng, 200)
    docs = documents([(1, f"{body} {item} forty two")])
    items = spark.createDataFrame([(1, item, "forty two"), (2, item, "seventeen")], "item_id long, text string, answer string")
    assert [r.item_id for r in decontaminate.find_contamination(docs, items, answer_col="answer").collect()] == [1]


def test_empty_null_and_repeated(spark, documents, rng):
    items = spark.createDataFrame([(1, item := sentence(rng, 30))], "item_id long, text string")
    assert decontaminate.op7_decontaminate(documents([]), items).count() == 0
    assert decontaminate.op7_decontaminate(documents([(1, item)]), items.limit(0)).count() == 0
    rows = decontaminate.op7_decontaminate(documents([(1, None), (2, ""), (3, item), (3, item), (None, item)]), items).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None"]


def test_many_passages_in_one_scan(spark, documents, rng):
    """2,000 passages, of which 60 are paraphrased in documents: every sixth word another."""
    items = [(f"i{j}", sentence(rng, 40)) for j in range(2000)]
    rows = [(i, sentence(rng, 120)) for i in range(120)]
    truth = set()
    for i in range(0, 120, 2):
        words = [rng.choice(WORDS) if k % 6 == 5 else w for k, w in enumerate(items[i * 16][1].split())]
        rows[i] = (i, f"{rows[i][1]} {' '.join(words)} {rows[i][1]}")
        truth.add((i, items[i * 16][0]))
    out = decontaminate.find_contamination(documents(rows), spark.createDataFrame(items, "item_id string, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 2


def test_space_holds_the_leading_singular_vectors(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate, "RANK", 8)
    r = np.random.default_rng(0)
    topics = r.choice(decontaminate.VOCABULARY, (8, 60), replace=False)  # eight groups of passages over words of their own
    items = [r.choice(topics[i % 8], decontaminate.WINDOW).astype(np.int32) for i in range(240)]
    idf = np.ones(decontaminate.VOCABULARY, np.float32)
    space, values = decontaminate.latent_space(spark, np.empty((0, decontaminate.WINDOW), np.int32), items, idf)
    a = np.zeros((240, decontaminate.VOCABULARY))
    for i, w in enumerate(items):
        np.add.at(a[i], w, 1 / np.sqrt(len(w) * 240))
    exact = np.linalg.svd(a[:, np.unique(np.concatenate(items))], compute_uv=False)[:8]
    assert np.all(values <= exact * 1.001) and np.all(values >= exact * 0.94)  # one pass over a slowly falling spectrum
    kept = space[: decontaminate.VOCABULARY]
    assert np.allclose(kept.T @ kept, np.eye(8), atol=1e-3)


def by_brute_force(texts, items):
    """(text, item) of all windows that Items.confirm() takes, whatever their cosine. Words that an item shares with a
    window's surroundings bound their longest common subsequence, which spares most comparisons but loses none."""
    words, begin, _, strides = decontaminate.batch_tokens(texts)
    start, text = decontaminate.window_starts(strides)
    at = (start - (np.cumsum(strides) - strides)[text]) * decontaminate.STRIDE
    out = set()
    for j, item in enumerate(items.words):
        shared = np.append(0, np.cumsum(np.isin(words, item)))
        lo = np.maximum(begin[text], begin[text] + at - len(item))
        hi = np.minimum(begin[text + 1], begin[text] + at + decontaminate.WINDOW + len(item))
        for w in np.flatnonzero(shared[hi] - shared[lo] >= decontaminate.LCS_SHARE * len(item)):
            t = int(text[w])
            if (t, items.ids[j]) not in out:
                lcs, answer = items.confirm(j, words[begin[t] : begin[t + 1]], int(at[w]))
                if lcs >= decontaminate.LCS_SHARE and answer >= decontaminate.ANSWER_SHARE:
                    out.add((t, items.ids[j]))
    return out


def recall(spark, d):
    """(found, those of brute force, both) of the pairs of documents and items of the tables in d."""
    docs, benchmark = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    df, total, _ = decontaminate.statistics(docs, "text")
    known = decontaminate.benchmark_passages(benchmark, np.log((1 + total) / (1 + df)).astype(np.float32), "item_id", "text", None)
    rows = docs.select("doc_id", "text").collect()
    plain = {(rows[t].doc_id, i) for t, i in by_brute_force([r.text for r in rows], decontaminate.Items(*known, np.zeros((decontaminate.VOCABULARY + 1, 1), np.float32)))}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, benchmark).collect()}
    return len(found), len(plain), len(found & plain)


def test_recall_against_brute_force(spark, data):
    found, plain, both = recall(spark, data)
    assert both == found and plain and both >= 0.9 * plain


def test_space_is_fitted_on_every_passage(spark, documents, rng):
    """Against the plain sum over all windows and items, in several tasks and pieces."""
    texts = [sentence(rng, n) for n in (5, 16, 17, 40, 300, 1, 2000, 0)] * 3
    docs = documents(list(enumerate(texts))).repartition(3)
    items = [decontaminate.batch_word_hashes([sentence(rng, n)])[0] for n in (9, 64, 33)]
    df, strides, windows = decontaminate.statistics(docs, "text")
    idf = np.log((1 + strides) / (1 + df)).astype(np.float32)
    a = []
    for t in texts:
        words = (decontaminate.batch_word_hashes([t])[0] & decontaminate.BUCKET).astype(int)
        for at in range(0, max(len(words) - decontaminate.STRIDE, min(len(words), 1)), decontaminate.STRIDE):
            a.append((words[at : at + decontaminate.WINDOW], 1.0))
    assert len(a) == windows
    items = [(w & decontaminate.BUCKET).astype(np.int32) for w in items]
    a += [(w, np.sqrt(windows / len(items))) for w in items]
    dense = np.zeros((len(a), decontaminate.VOCABULARY))
    for row, (w, weight) in zip(dense, a, strict=True):
        np.add.at(row, w, idf[w] * weight / np.sqrt((idf[w] ** 2).sum()))
    used = dense.any(axis=0)
    exact = np.append(np.linalg.svd(dense[:, used], compute_uv=False), np.zeros(decontaminate.RANK))[: decontaminate.RANK]
    _, values = decontaminate.latent_space(spark, docs.select("text"), items, idf, windows)
    assert np.all(values <= exact * 1.001 + 1e-3) and np.all(values[:32] >= exact[:32] * 0.94)


def test_pieces_of_a_batch_add_up(rng, monkeypatch):
    _, _, flat, strides = decontaminate.batch_tokens([sentence(rng, n) for n in (5, 0, 16, 17, 40, 300, 1, 200, 9)])
    weights = np.append(np.random.default_rng(1).random(decontaminate.VOCABULARY), 0).astype(np.float32)
    omega = np.random.default_rng(2).standard_normal((decontaminate.VOCABULARY + 1, 5)).astype(np.float32) * weights[:, None]
    plain, gram = np.zeros((decontaminate.VOCABULARY + 1, 5)), np.zeros((5, 5))
    for at in range(len(strides)):
        own = flat[strides[:at].sum() * 16 : strides[: at + 1].sum() * 16]
        for i in range(0, max(len(own) - 16, min(len(own), 1)), 16):
            w = own[i : i + 32]
            b = omega[w].sum(axis=0) / np.sqrt((weights[w] ** 2).sum())
            np.add.at(plain, w, b / np.sqrt((weights[w] ** 2).sum()))
            gram += np.outer(b, b)
    for pieces, few in ((4096, 24), (7, 1), (1, 10**6)):
        monkeypatch.setattr(decontaminate, "FIT_STRIDES", pieces)
        monkeypatch.setattr(decontaminate, "FEW_TERMS", few)
        total = np.zeros(plain.shape, np.float32)
        decontaminate.add_windows(total, decontaminate.text_windows(flat, strides, omega, weights**2))
        assert np.allclose(total, plain, atol=1e-4)
        assert np.allclose(decontaminate.window_gram(decontaminate.text_windows(flat, strides, omega, weights**2)), gram, rtol=1e-4, atol=1e-4)
