"""Retrieval by one scan: both ways to norms, passes over queries, and reduced results."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import evaluation, graph, lexical

TEXTS = ["delta echo delta foxtrot", "echo golf hotel", "india juliet kilo lima echo", "", None, "delta delta delta", "kilo golf golf delta india hotel"]
QUERIES = ["delta golf", "echo echo unknownword", "zulu", "", "kilo india delta"]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 9)], "id long, text string")
    asked = spark.createDataFrame([(100 + i, t) for i, t in enumerate(QUERIES)], "id long, text string")
    return lexical.tokenised(docs), lexical.tokenised(asked)


def rows(df):
    return {(r.query_id, r.id): (round(r.bm25, 9), None if r.cosine is None else round(r.cosine, 9)) for r in df.collect()}


def test_joined_norms_and_several_passes_agree(tables, monkeypatch):
    words, asked = tables
    whole = rows(lexical.lexical_scores(words, asked))
    assert len(whole) == sum(bool(set((q or "").split()) & set((t or "").split())) for q in QUERIES for t in TEXTS * 9)
    monkeypatch.setattr(lexical, "VOCABULARY", 2)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 3)
    monkeypatch.setattr(lexical, "ADDITIONS", 5)
    assert rows(lexical.lexical_scores(words, asked)) == whole


@pytest.mark.parametrize("by", ["bm25", "cosine"])
def test_k_keeps_the_best_and_all_ties(tables, by):
    words, asked = tables
    whole = lexical.lexical_scores(words, asked).cache()
    few = lexical.lexical_scores(words, asked, 3, by)
    best = lambda df: sorted((r.query_id, r.id, r["rank"]) for r in lexical.topk(df.withColumn(by, F.round(by, 6)), 3, by).collect())
    assert best(few) == best(whole) and few.count() < whole.count()


def test_text_ids_and_empty_tables(spark):
    words = lexical.tokenised(spark.createDataFrame([("a", "delta echo"), ("b", "golf")], "id string, text string"))
    asked = lexical.tokenised(spark.createDataFrame([("q", "delta")], "id string, text string"))
    assert [(r.query_id, r.id) for r in lexical.lexical_scores(words, asked).collect()] == [("q", "a")]
    assert lexical.lexical_scores(words.limit(0), asked).count() == 0
    assert lexical.lexical_scores(words, asked.limit(0)).count() == 0


def test_pagerank_equals_plain_rounds(spark):
    """With dangling nodes, self loops, an isolated node and an edge to a node that is not listed."""
    links = [(1, 2, "EXTENDS", 2.0), (1, 3, "EXTENDS", 1.0), (2, 3, "RELATED", 1.0), (4, 4, "RELATED", 9.0), (3, 5, "SUPPORTS", 1.0), (5, 99, "EXTENDS", 1.0)]
    nodes = list(range(1, 8))
    out = {}
    for a, b, kind, w in links:
        if a != b:
            out.setdefault(a, {})[b] = out.setdefault(a, {}).get(b, 0) + w
            if kind not in graph.DIRECTED:
                out.setdefault(b, {})[a] = out.setdefault(b, {}).get(a, 0) + w
    r = dict.fromkeys(nodes, 1 / 7)
    for _ in range(30):
        lost = sum(r[v] for v in nodes if v not in out)
        came = dict.fromkeys(nodes, 0.0)
        for a, targets in out.items():
            for b, w in targets.items():
                if a in r and b in came:
                    came[b] += r[a] * w / sum(targets.values())
        r = {v: 0.15 / 7 + 0.85 * (came[v] + lost / 7) for v in nodes}
    got = {x.id: x["rank"] for x in graph.pagerank(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(links, "src long, dst long, type string, weight double")).collect()}
    assert got == pytest.approx({v: x / max(r.values()) for v, x in r.items()}, rel=1e-9)


def test_resampling_in_buckets(spark, monkeypatch):
    values = spark.range(300).select((F.col("id") % 37 / 37.0).alias("x")).union(spark.createDataFrame([(None,)], "x double"))
    whole = evaluation.bootstrap_ci(values, 400).first()
    monkeypatch.setattr(evaluation, "BUCKET_VALUES", 5)
    split = evaluation.bootstrap_ci(values, 400).first()
    for r in (whole, split):
        assert r.low < r.mean < r.high and 0.04 < r.high - r.low < 0.09
    zero = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert evaluation.permutation_test(zero, 200).first().p == 1.0
    assert evaluation.permutation_test(spark.createDataFrame([(1.0,)] * 12, "x double"), 2000).first().p < 0.01


def plain_phrase_entities(text, phrases, most=4):
    """Clauses, then per type the longest phrase at each place, left to right, without overlap."""
    import re

    out = set()
    for clause in re.split(r"[^a-z0-9\s-]+", text.lower()):
        words = [w for w in re.split(r"[\s-]+", clause) if w]
        for kind in {k for k, _ in phrases}:
            own, at = {p.replace("-", " ") for k, p in phrases if k == kind}, 0
            while at < len(words):
                hit = next((n for n in range(most, 0, -1) if at + n <= len(words) and " ".join(words[at : at + n]) in own), None)
                if hit:
                    out.add((kind, " ".join(words[at : at + hit])))
                at += hit or 1
    return out


def test_phrases_of_a_dictionary(spark, monkeypatch):
    import random

    from scriptorium.operators import entities

    rng = random.Random(3)
    words = ["time", "series", "analysis", "of", "variance", "meta", "deep", "x1"]
    phrases = [("M", "time series"), ("M", "time series analysis"), ("M", "analysis of variance"), ("M", "meta-analysis"), ("M", "variance"), ("T", "series analysis"), ("T", "x1"), ("T", "deep time series analysis"), ("T", None)]
    texts = [(i, "".join(rng.choice(words) + rng.choice((" ", " ", " ", "-", ", ", "\n", ". ")) for _ in range(30)).title()) for i in range(60)] + [(100, None), (101, ""), (102, "--")]
    docs, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "entity_type string, phrase string")
    plain = {(i, k, v) for i, t in texts for k, v in plain_phrase_entities(t or "", [p for p in phrases if p[1]])}
    assert len(plain) > 100
    assert {tuple(r) for r in entities.phrase_entities(docs, known).collect()} == plain
    monkeypatch.setattr(entities, "DICTIONARY", 2)  # too large to be sent: the same by a shuffle
    assert {tuple(r) for r in entities.phrase_entities(docs, known).collect()} == plain


def test_rag_context_falls_back_and_marks_cut_excerpts(spark, tmp_path):
    import duckdb
    from oracle import rows_of_spark, rows_of_sql

    from scriptorium.plans import ORACLE_SQL, QUERIES

    filler = " ".join(f"word{i}" for i in range(400))
    docs = [(i, f"delta echo {i}" if i < 4 else f"{filler} golf" if i == 4 else None if i == 5 else f"kilo lima {i}", "en", "s", 9) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "delta echo"), (2, "nothing shared"), (3, "golf"), (4, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = QUERIES["rag_context"](spark, str(tmp_path))
    assert rows_of_spark(rows) == rows_of_sql(con, ORACLE_SQL["rag_context"])
    got = {(r.query_id, r.id): r for r in rows.collect()}
    assert {k for k in got if k[0] in (2, 4)} == {(q, i) for q in (2, 4) for i in range(15)}  # none near: the first fifteen
    assert got[2, 4].excerpt == f"{filler} golf"[:800] + "..." and got[2, 5].excerpt == "" and got[1, 0].excerpt == "delta echo 0"
