import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest

from conftest import sentence
from scriptorium.llm import pii, toxicity


INSULTS = ("vilewort", "snorkel", "grubbish")
PASSAGE = " ".join(f"{a}{b}" for a in ("quel", "vash", "torm", "wixy", "zand") for b in ("ip", "oc", "ud", "em", "al", "ust", "orn"))


@pytest.fixture
def folder(spark, documents, rng, tmp_path):
    rows = []
    for i in range(400):
        t = sentence(rng, rng.randint(3, 150))
        if i % 7 == 0:
            t += " vilewort snorkel " + ("grubbish" if i % 2 else "vilewort")
        if i % 9 == 1:
            t += f" write to user{i}@mail.org"
        rows.append((i, t))
    rows += [(1000 + i, rows[i][1]) for i in range(1, 40, 2)] + [(2000, None), (2001, ""), (2001, ""), (3, rows[3][1])]
    # a null or repeated id must neither lose a clean text nor save a bad one
    clean, bad = [sentence(rng, 80) for _ in range(10)], sentence(rng, 60) + " vilewort snorkel grubbish vilewort"
    rows += [(None, t) for t in clean] + [(None, clean[0]), (None, None), (None, bad), (3, bad + " again"), (3, sentence(rng, 90)), (None, rows[9][1])]
    rows += [(3000, f"{rows[5][1]} {PASSAGE}"), (None, f"{sentence(rng, 50)} {PASSAGE} {sentence(rng, 9)}"), (3000, sentence(rng, 70))]
    passage = PASSAGE
    docs = documents(rows, lambda i: "ab"[(i or 0) % 2]).drop("id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain_near_duplicates(rows):
    """Of each group, by all pairs, the first row by (null id, id, digest)."""
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else -1 - i, []).append(r)
    order = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).digest())
    return [min(g, key=order) for g in groups.values()]


def test_stages_against_plain_versions(spark, folder):
    """Null and repeated ids included; only the scores are the operator's, and they are judged by the rows' own texts."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, path)
        if name == "toxicity":
            bad = {r.text for r in toxicity.score_toxicity(docs, labels, keep=["text"]).collect() if r.predicted}
            want = [r for r in before if r.text not in bad]
            assert 40 <= len(bad) <= 75 and all(any(w in t for w in INSULTS) for t in bad)
        elif name == "near_duplicates":
            want = plain_near_duplicates(before)
            assert len(want) <= len(before) - 20
        elif name == "decontamination":
            want = [r for r in before if PASSAGE not in (r.text or "")]
            assert len(before) - len(want) == 2 and sum(r.doc_id is None for r in want) > 5
        elif name == "pii":
            anchors = pii.automaton()
            fixed = [(r, pii.redact(r.text, anchors)) for r in before]
            plain = sorted(str(r.asDict() | {"text": t, "n_chars": len(t) if t is not None else None}) for r, t in fixed)
            assert sorted(str(r.asDict()) for r in out.collect()) == plain and "[EMAIL]" in str(plain)
            assert not any(re.search(r"user[0-9]+@", t or "") for _, t in fixed)
            want = None
        else:
            assert Counter((r.doc_id, r["size"]) for r in out.collect()) == Counter((r.doc_id, len((r.text or "").split())) for r in before)
            break
        assert out.columns == columns
        if want is not None:
            assert Counter(map(str, out.collect())) == Counter(map(str, want)), name
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append(name)
    assert [n for n, _ in corpus_pipeline.STAGES] == [*seen, "mixing"]
    assert corpus_pipeline.run(spark, path).count() == docs.count()


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
