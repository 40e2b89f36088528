import bisect
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import sentence
from scriptorium.llm import mixing


def filled(sizes):
    """Targets by the contract's rule, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {**{s: 3 * sizes[s] for s in full}, **share}
        full |= over


def run(docs):
    rows = mixing.op9_mix(docs).collect()
    return rows, {r.doc_id: r.source for r in docs.collect()}


def test_targets_and_shares(documents, rng):
    source = lambda i: None if i % 50 == 7 else ["big", "b", "a", "é", "tiny", "Z"][0 if i % 3 == 0 else (5 if i % 2 else min(i % 11, 4))]
    docs = documents([(i, sentence(rng, rng.choice([0, 1, 30, 200, 900]))) for i in range(600)], source)
    rows, of = run(docs)
    assert len(rows) == 600
    sizes = {}
    for r in rows:
        sizes[of[r.doc_id]] = sizes.get(of[r.doc_id], 0) + r["size"]
    expected = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = of[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s]) and 0 <= r.taken <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(3 * mixing.BLOCK, 0.06 * expected[s]), s
    again, _ = run(docs.repartition(7))
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_capped_sources(documents, rng):
    docs = documents([(i, sentence(rng, 400 if i else 20)) for i in range(40)], lambda i: "b" if i == 0 else "a")
    rows, of = run(docs)
    small = next(r for r in rows if r.doc_id == 0)
    assert small.target == 60 and 54 <= small.taken <= 60


def test_word_count(spark):
    texts = ["", " ", "a", " a b\tc\n", "é\u00a0x y", "\x0b\x0ca", None, "a  b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_points_are_spread(spark):
    x = sorted(r.p / 2**32 for r in spark.range(1000).select(mixing.point(F.col("id")).alias("p")).collect())
    gaps = [b - a for a, b in zip([0, *x], [*x, 1], strict=False)]
    assert len(set(x)) == 1000 and max(gaps) < 3 / 1000
    big = spark.range(2**33, 2**33 + 5).select(mixing.point(F.col("id")).alias("p")).collect()
    assert all(0 <= r.p < 2**32 for r in big)


def test_schedule_interleaves(documents, rng):
    """In every stretch of the mix each source has about its share of slots."""
    docs = documents([(i, sentence(rng, 2000)) for i in range(60)], lambda i: "abc"[i % 3])
    streamed, slots = mixing.mix(docs)
    rows = sorted((r.slot, r.place) for r in slots.collect())
    half = len(rows) // 2
    for place in range(3):
        first = sum(p == place for _, p in rows[:half])
        assert abs(2 * first - sum(p == place for _, p in rows)) <= 6


def test_empty_repeated_and_null(documents):
    assert mixing.op9_mix(documents([])).count() == 0
    rows, _ = run(documents([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d e")]))
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == [("1", 0), ("2", 0), ("3", 3), ("3", 3), ("None", 2)]
    assert all(r.taken <= 3 * r["size"] for r in rows) and mixing.op9_mix(documents([(1, None)])).first().taken == 0


def plain_taken(rows, weights=mixing.WEIGHTS):
    """Counter of (id, source, text, taken) by loops over words, blocks and slots; rows are (id, source, text, hash)."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, source, text, _ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = filled(sizes)
    places = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    blocks = {s: max(math.ceil(n / mixing.BLOCK), min(n, mixing.LEAST_BLOCKS)) for s, n in sizes.items()}
    share = {s: target[s] * blocks[s] / sizes[s] if sizes[s] else 0.0 for s in places}
    total = sum(share.values())
    n_slots, edge, interval = max(1, round(total)), 0.0, {}
    for s in places:
        interval[s] = (edge / total * n_slots, (edge + share[s]) / total * n_slots)
        edge += share[s]
    times = {s: Counter() for s in places}
    for slot in range(n_slots):
        x = slot * mixing.GOLDEN % 2**32 / 2**32 * n_slots
        s = next(s for s in places if interval[s][0] <= x < interval[s][1])
        k = sum(times[s].values())
        if k < mixing.MAX_REPEATS * blocks[s]:
            times[s][k % blocks[s]] += 1
    out = Counter()
    for s in places:
        edges, at = [math.floor(b * (sizes[s] / blocks[s])) for b in range(blocks[s])], 0  # where blocks begin
        for i, source, text, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], words(r[2]))):
            taken = sum(times[s][bisect.bisect_right(edges, w) - 1] for w in range(at, at + words(text)))
            out[(i, source, text, taken)] += 1
            at += words(text)
    return out


def test_taken_equals_plain_loops_with_null_and_repeated_ids(spark, documents, rng):
    texts = [(None if i % 4 == 0 else i % 90, sentence(rng, rng.choice([0, 1, 7, 40, 160]))) for i in range(260)]
    texts += [texts[0]] * 40 + [(5, None), (5, ""), (None, None)]
    # the source goes by the id, so that equal rows stay equal
    docs = documents(texts, lambda i: None if i is None else "abcd"[min(i % 7, 3)])
    rows = [(r.doc_id, r.source, r.text, r.h) for r in docs.select("doc_id", "source", "text", F.xxhash64(F.lit("mix"), "doc_id", "text").alias("h")).collect()]
    want, got = Counter(), Counter()
    for (i, _, text, taken), n in plain_taken(rows).items():
        want[(i, len((text or "").split()), taken)] += n
    for r in mixing.op9_mix(docs).collect():
        got[(r.doc_id, r["size"], r.taken)] += 1
    assert got == want
