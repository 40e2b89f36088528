import math
import random
import zlib

import numpy as np
import pytest

from scriptorium.llm import languages
from scriptorium.llm.languages import BUCKETS, MEAN_WEIGHT, ORDERS, PENALTY

VOCABULARY = {
    "xa": "der die das und nicht schön über straße haus wald können zwischen".split(),
    "xb": "the and with house forest between could nice street over water stone".split(),
    "xc": "дом лес улица вода камень между красивый через можно хороший".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, score string, spans int, lang_pred string"


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, x := rng.choice(list(VOCABULARY)), rng.randrange(3, 60)), x, "s", "", 0, "") for i in range(300)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def model(corpus):
    return languages.fit(corpus[1])


def plain_words(text):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isalpha():
            end += 1
        if end > at:
            out.append((at, end))
        at = max(end, at + 1)
    return out


def bucket(codes):
    """The hash of an n-gram by plain integers."""
    h = 0
    for c in codes:
        h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
    h = (h ^ (h >> 29)) * 0xD6E8FEB86659FD93 % 2**64
    return h >> 49


def plain_grams(word):
    """(length, bucket) of the n-grams that end at each letter or at the boundary behind."""
    codes = [32, *map(ord, word), 32]
    for end in range(1, len(codes)):
        for n in range(1, ORDERS + 1):
            if n > end + 1 or (n == 1 and end == len(codes) - 1):
                continue
            yield n, bucket(codes[end - n + 1 : end + 1])


def plain_label(model, text, counts):
    """Scores by definition and every word's best label by the plain recursion with back pointers."""
    n = len(model.languages)
    share = [{(k, b): c / max(1, sum(v for (kk, _), v in own.items() if kk == k)) for (k, b), c in own.items()} for own in counts]
    text, scores = languages.lowered(text), []
    for lo, hi in plain_words(text):
        s = np.zeros(n)
        for g in plain_grams(text[lo:hi]):
            p = [x.get(g, 0.0) for x in share]
            mean = sum(p) / n + 1e-9
            log = [math.log((1 - MEAN_WEIGHT) * x + MEAN_WEIGHT * mean) for x in p]
            s += (np.array(log) - sum(log) / n) / ORDERS
        latin = ord(text[lo]) < 0x250
        scores.append([x if (model.languages[j] != "xc") == latin else -math.inf for j, x in enumerate(s)])
    best, back = [model.prior[j] + scores[0][j] for j in range(n)], []
    for row in scores[1:]:
        came = [max(range(n), key=lambda i: (best[i] - PENALTY * (i != j), i == j)) for j in range(n)]  # noqa: B023
        best, back = [best[i] - PENALTY * (i != j) + row[j] for j, i in enumerate(came)], [*back, came]
    at = int(np.argmax(best))
    labels = [at]
    for came in reversed(back):
        at = came[at]
        labels.append(at)
    return [model.languages[j] for j in reversed(labels)]


def test_equals_plain_scores_and_recursion(corpus, model):
    rng = random.Random(5)
    counts = [{} for _ in model.languages]
    for i, text, lang, *_ in corpus[0]:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            own = counts[model.languages.index(lang)]
            for lo, hi in plain_words(text):
                for g in plain_grams(text[lo:hi]):
                    own[g] = own.get(g, 0) + 1
    texts = [" ".join(prose(rng, rng.choice(list(VOCABULARY)), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts += ["Straße2water", "x", "İstanbul der die das", "der " * 30 + "the and with " * 20]
    for text, spans in zip(texts, languages.label_texts(model, texts)[2], strict=True):
        of_word = [x for lo, hi in plain_words(text) for a, b, x in spans if a <= lo and hi <= b]
        assert of_word == plain_label(model, text, counts)
        assert all(a[1] <= b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:], strict=False))


def test_spans_of_mixed_text(model):
    rng = random.Random(9)
    parts = [("xa", prose(rng, "xa", 20)), ("xb", prose(rng, "xb", 25)), ("xc", prose(rng, "xc", 4)), ("xa", prose(rng, "xa", 15))]
    text = ". ".join(p for _, p in parts)
    lang, score, spans = (x[0] for x in languages.label_texts(model, [text]))
    assert [x for *_, x in spans] == [x for x, _ in parts]
    assert [text[a:b] for a, b, _ in spans] == [p for _, p in parts]
    assert lang == "xa" and 0.3 < score < 0.7


def test_held_out_accuracy(corpus):
    rows, df = corpus
    found = languages.op13_languages(df).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out]
    assert len(found) == 300 and len(held) > 60
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_and_columns_play_no_part(spark, corpus):
    rows, df = corpus
    other = [(i, t, "xb" if zlib.crc32(str(i).encode()) % 3 == 1 else x, "other", None, 9, "zz") for i, t, x, *_ in rows]
    key = lambda found: sorted((r.doc_id, r.lang_pred, r.score) for r in found.collect())
    assert key(languages.op13_languages(spark.createDataFrame(other, SCHEMA))) == key(languages.op13_languages(df))


def test_defined_cases(spark, corpus):
    rows, _ = corpus
    extra = [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 ²³ --", "xb"), (None, rows[0][1], rows[0][2]), (1003, "Ω λόγος", "xa"), (1004, "der" * 3000, None), (1005, prose(random.Random(1), "xb", 30000), "xb"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows + [(i, t, x, "", "", 0, "") for i, t, x in extra], SCHEMA)
    got = languages.op13_languages(df).collect()
    assert len(got) == 309
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score, by[i].n_spans) for i in (1000, 1001, 1002)] == [("und", 0.0, 0)] * 3
    assert by[None].held_out is False and by[1003].lang_pred in VOCABULARY and by[1004].lang_pred == "xa" and by[1005].lang_pred == "xb"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 7}) == 1


def test_nothing_to_learn_from(spark):
    assert languages.op13_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    got = languages.op13_languages(spark.createDataFrame([(1, "der die", None, "", "", 0, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(1, "und", 0.0)]


def test_long_texts_are_read_whole(model, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, "xa", 400) + " " + prose(rng, "xb", 900), "x" * 5000, prose(rng, "xc", 30)]
    whole = languages.label_texts(model, texts)
    monkeypatch.setattr(languages, "PIECE", 700)
    cut = languages.label_texts(model, texts)
    assert cut[0] == whole[0] and cut[0][0] == "xb" and cut[2][0] == whole[2][0] and cut[2][2] == whole[2][2]


def test_buckets():
    assert BUCKETS == 2**15 and max(b for _, b in plain_grams("straße")) < BUCKETS
