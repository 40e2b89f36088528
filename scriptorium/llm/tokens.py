"""Token counts through a digest cache.

A text's key is the SHA-256 of its content; with the digest of the tokenizer file it names a row of the cache table.
Texts are joined to the cache by these digests; one text of each missing digest is encoded and appended to the cache,
and every row takes its count from there. Two texts share a digest only if they are equal, since any other
normalisation could change a count; a null text is normalised to the empty one.

Defined cases: null and empty texts have no tokens; texts are encoded whole; repeated rows and null ids give a row each;
a cache of another tokenizer is never read; an empty table gives an empty result and adds nothing to the cache; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import exists, scratch_path, small_batches

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counter(path: str):
    """A function from a list of texts to their token counts, by the kind of vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache table; empty before its first write. One that can't be read is an error."""
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_path: str | None = None, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of docs; missing counts are appended to the cache table first.

    cache_path: a Parquet folder that all executors reach. Without one the cache starts empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    vocabulary = vocabulary or vocabulary_path()
    version = tokenizer_digest(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
    misses = keyed.select("digest", "text").join(known, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(encode, "digest binary, n_tokens long").select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # two writers may have appended the same digest
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.drop("text").join(counts, "digest").select(id_col, "n_bytes", "n_tokens")


def op6_tokens(docs: DataFrame) -> DataFrame:
    """The contract's columns; the query starts from an empty cache, so its cost is that of a first run."""
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
