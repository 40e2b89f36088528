import pytest

from scriptorium.llm import tokens


def library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path())
    return [len(x) for x in sp.encode([t or "" for t in texts])]


def test_counts_equal_the_library(documents, rng):
    texts = ["", None, "a", "  two  spaces ", "été ß 😀 \u0000x", "<s> </s> <unk>", "line\nbreak\ttab", "x" * 30_000, "same", "same"] + [" ".join(rng.choice(["the", "of", "Straße", "naïve", "12.5"]) for _ in range(rng.randint(1, 300))) for _ in range(50)]
    rows = {r.doc_id: r for r in tokens.op6_tokens(documents(enumerate(texts))).collect()}
    assert [rows[i].n_tokens for i in range(len(texts))] == library(texts)
    assert [rows[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows.values())


def test_cache_is_used_and_grows_by_misses(spark, documents, tmp_path):
    path = f"file://{tmp_path}/cache"
    tokens.count_tokens(documents([(1, "one"), (2, "two"), (3, "two")]), path).count()
    assert spark.read.parquet(path).count() == 2
    # a stored count is believed, so it is not encoded again
    spark.createDataFrame([(r.digest, r.tokenizer, 77) for r in spark.read.parquet(path).collect()], tokens.CACHE_SCHEMA).write.parquet(f"{path}2")
    rows = {r.doc_id: r.n_tokens for r in tokens.count_tokens(documents([(1, "one"), (4, "four five")]), f"{path}2").collect()}
    assert rows == {1: 77, 4: library(["four five"])[0]}
    assert spark.read.parquet(f"{path}2").count() == 3
    other = tokens.count_tokens(documents([(1, "one")]), f"{path}2", vocabulary=tokens.vocabulary_path("byte_bpe_50k.json"))
    assert other.first().n_tokens != 77


def test_empty(documents):
    assert tokens.op6_tokens(documents([])).count() == 0


def test_null_ids_and_an_unreadable_cache(documents, tmp_path):
    rows = tokens.op6_tokens(documents([(None, "one two"), (None, "one two"), (1, None)])).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in rows) == [("1", False), ("None", True), ("None", True)]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet|cannot read|footer"):
        tokens.count_tokens(documents([(1, "one")]), f"file://{tmp_path}/cache").count()
