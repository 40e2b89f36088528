"""Lexical retrieval: term statistics, TF-IDF and BM25 over (id, text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium import config
from scriptorium.functions.text import token_array
from scriptorium.storage import saved


def tokenised(docs: DataFrame) -> DataFrame:
    """(id, words): the texts' words, once for all that follows."""
    return docs.select("id", token_array(F.col("text")).alias("words"))


def occurrences(words: DataFrame) -> DataFrame:
    """(id, length, term), a row a word.

    The length is taken first: beside explode it would carry the whole array along with every word. The outer form
    keeps Spark from inferring a filter that would split the texts once more.
    """
    return words.select("id", F.size("words").alias("length"), "words").select("id", "length", F.explode_outer("words").alias("term")).filter("term IS NOT NULL")


def term_counts(words: DataFrame) -> DataFrame:
    """(id, term, length, n): n of the document's length words are the term.

    Documents are dealt by id while their words are still one array; the rows of single words are then counted where
    they are, without a shuffle of their own.
    """
    return occurrences(words.repartition(F.col("id"))).groupBy("id", "term", "length").agg(F.count("*").alias("n"))


def term_frequency(words: DataFrame) -> DataFrame:
    """(id, term, tf): the share of the document's words."""
    return term_counts(words).select("id", "term", (F.col("n") / F.col("length")).alias("tf"))


def document_frequency(words: DataFrame) -> DataFrame:
    """(term, df)."""
    return words.select(F.explode_outer(F.array_distinct("words")).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(words: DataFrame) -> DataFrame:
    """One row (n, avg_length); documents without words count."""
    return words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_length"))


def idf(df, n):
    """Of a term that some document holds."""
    return F.greatest(F.lit(config.IDF_FLOOR), F.log(n / (1 + df)))


def weighted_terms(words: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, term, weight, df), of all documents or of those in `of` (id); frequencies always come from all."""
    n = corpus_size(words).select("n")
    own = words if of is None else words.join(of, "id", "left_semi")
    return _weights(term_counts(own), document_frequency(words), n)


def tfidf_vectors(words: DataFrame) -> DataFrame:
    """(id, term, weight)."""
    return weighted_terms(words).drop("df")


def _weights(counts: DataFrame, dfs: DataFrame, n: DataFrame) -> DataFrame:
    dfs = dfs.crossJoin(F.broadcast(n.withColumnRenamed("n", "corpus")))  # one row
    return counts.join(dfs, "term").select("id", "term", (F.col("n") / F.col("length") * idf(F.col("df"), F.col("corpus"))).alias("weight"), "df")


def query_weights(queries: DataFrame, dfs: DataFrame, n: DataFrame) -> DataFrame:
    """(query_id, term, weight): terms that no document holds weigh ln n."""
    rows = occurrences(queries).withColumnRenamed("id", "query_id").groupBy("query_id", "length", "term").agg(F.count("*").alias("n"))
    rows = rows.join(dfs, "term", "left").crossJoin(F.broadcast(n.withColumnRenamed("n", "corpus")))
    own = F.when(F.col("df").isNull(), F.log(F.col("corpus").cast("double"))).otherwise(idf(F.col("df"), F.col("corpus")))
    return rows.select("query_id", "term", (F.col("n") / F.col("length") * own).alias("weight"))


#: Terms whose frequencies are sent to every task (16 bytes each); beyond, norms are joined. Query terms in a pass.
VOCABULARY, QUERY_TERMS = 1 << 21, 1 << 18
#: (document, query) additions made at once in a task.
ADDITIONS = 1 << 21


def hashed_terms(words: DataFrame, name: str = "id") -> DataFrame:
    """(id, h): 64-bit hashes of the words in place of the words."""
    return words.select(F.col("id").alias(name), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def joined_norms(hashed: DataFrame, dfs: DataFrame, n: int) -> DataFrame:
    """(id, norm) of TF-IDF vectors, by a join on terms: the way for a vocabulary of any size."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                length = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, term = np.repeat(np.arange(len(length)), length), b.column(1).flatten().to_numpy(zero_copy_only=False)
                order = np.lexsort((term, doc))
                doc, term = doc[order], term[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(term) else np.empty(0, np.int64)
                own = doc[first]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(length[own]), pa.array(term[first], pa.int64()), pa.array(np.diff(np.append(first, len(term))))], names=["id", "length", "t", "n"])

    # a document's terms are counted in its own array: no task has a table of all terms of its documents
    one = hashed.select("id", "h").mapInArrow(counted, f"id {hashed.schema['id'].dataType.simpleString()}, length long, t long, n long")
    weight = F.col("n") / F.col("length") * F.greatest(F.lit(config.IDF_FLOOR), F.log(n / (1 + F.col("df"))))
    return one.join(dfs, "t").groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def lexical_scores(words: DataFrame, query_words: DataFrame, k: int | None = None, by: str = "bm25", k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
    """(query_id, id, bm25, cosine) of documents and queries with a term in common; each query term counts once in BM25.

    One scan of the documents' (hashed) words and no shuffle of them: the statistics of the queries' terms are sent to
    the tasks, which count and add in arrays. Frequencies of all terms, which norms need, are sent too as long as they
    are at most VOCABULARY; beyond that norms come from a join. With k, tasks return only what can be among the k best
    by `by` (ties and values within 1e-6 of the k-th included). Queries go in passes of about QUERY_TERMS terms.
    """
    spark = words.sparkSession
    hashed = saved(hashed_terms(words), "terms")
    n, total = hashed.agg(F.count("*"), F.sum(F.size("h"))).first()
    average = (total or 0) / max(1, n)
    dfs = saved(hashed.select(F.explode(F.array_distinct("h")).alias("t")).groupBy("t").agg(F.count("*").alias("df")), "frequencies")
    small = dfs.count() <= VOCABULARY
    vocabulary = None
    if small:
        found = dfs.toArrow()
        order = np.argsort(found.column("t").to_numpy())
        vocabulary = spark.sparkContext.broadcast((found.column("t").to_numpy()[order], found.column("df").to_numpy()[order]))  # VOCABULARY bounds it
    rows = hashed if small else hashed.join(joined_norms(hashed, dfs, n), "id", "left")
    asked = saved(hashed_terms(query_words, "query_id").withColumn("length", F.size("h")).select("query_id", "length", F.explode("h").alias("t")).groupBy("query_id", "length", "t").agg(F.count("*").alias("n")).join(dfs, "t", "left"), "asked")
    passes = max(1, -(-asked.count() // QUERY_TERMS))
    id_type, query_type = hashed.schema["id"].dataType, asked.schema["query_id"].dataType
    out = None
    for i in range(passes):
        given = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).orderBy("query_id", "t").toArrow()  # about QUERY_TERMS rows
        q_ids = given.column("query_id").unique().to_pylist()
        at = {q: j for j, q in enumerate(q_ids)}
        query = np.array([at[q] for q in given.column("query_id").to_pylist()], np.int64)
        df = given.column("df").fill_null(0).to_numpy().astype(float)
        own = np.where(df > 0, np.maximum(config.IDF_FLOOR, np.log(n / (1 + df))), np.log(max(1, n)))
        weight = given.column("n").to_numpy() / given.column("length").to_numpy() * own
        norm = np.sqrt(np.bincount(query, weight * weight, minlength=len(q_ids)))
        term = given.column("t").to_numpy()
        by_term = np.lexsort((query, term))
        terms, start = np.unique(term[by_term], return_index=True)
        shared = spark.sparkContext.broadcast((q_ids, norm, terms, np.append(start, len(term)), query[by_term], weight[by_term], df[by_term]))

        def score(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q_norm, terms, start, query, weight, df = shared.value
            known = vocabulary.value if vocabulary else None
            for batch in it:
                lists = batch.column(1)
                length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(length)), length)
                order = np.lexsort((flat, doc))
                doc, flat = doc[order], flat[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (flat[1:] != flat[:-1])]) if len(flat) else np.empty(0, np.int64)
                count = np.diff(np.append(first, len(flat))).astype(float)
                doc, flat = doc[first], flat[first]
                if known:
                    own = count / length[doc] * np.maximum(config.IDF_FLOOR, np.log(n / (1 + known[1][np.searchsorted(known[0], flat)])))
                    norms = np.sqrt(np.bincount(doc, own * own, minlength=len(length)))
                else:
                    norms = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
                if not len(terms):
                    continue
                place = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
                hit = np.flatnonzero(terms[place] == flat)
                doc, count, place = doc[hit], count[hit], place[hit]
                many = start[place + 1] - start[place]
                # documents in stretches of at most ADDITIONS additions, but for a single one
                upto = np.cumsum(np.bincount(doc, many, minlength=len(length)))
                lo = 0
                while lo < len(length):
                    hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ADDITIONS, side="right")))
                    a, z = np.searchsorted(doc, (lo, hi))
                    m = many[a:z]
                    entry = np.repeat(start[place[a:z]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    tf, d = np.repeat(count[a:z], m), np.repeat(doc[a:z], m)
                    idf_b = np.log((n - df[entry] + 0.5) / (df[entry] + 0.5) + 1)
                    part = idf_b * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[d] / average))
                    dot = weight[entry] * tf / length[d] * np.maximum(config.IDF_FLOOR, np.log(n / (1 + df[entry])))
                    pair = (d - lo) * len(q_ids) + query[entry]
                    size = (hi - lo) * len(q_ids)
                    found = np.flatnonzero(np.bincount(pair, minlength=size))
                    at, q = found // len(q_ids) + lo, found % len(q_ids)
                    bm25 = np.bincount(pair, part, minlength=size)[found]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cosine = np.bincount(pair, dot, minlength=size)[found] / (norms[at] * q_norm[q])
                    keep = np.ones(len(found), bool)
                    if k is not None and len(found):
                        value = np.nan_to_num(bm25 if by == "bm25" else cosine)
                        best = np.lexsort((-value, q))
                        rank = np.arange(len(best)) - np.searchsorted(q[best], q[best])
                        limit = np.full(len(q_ids), -np.inf)
                        limit[q[best[rank == k - 1]]] = value[best[rank == k - 1]] - 1e-6
                        keep = value >= limit[q]
                    at, q, bm25, cosine = at[keep], q[keep], bm25[keep], cosine[keep]
                    ids = pa.array(q_ids, to_arrow_type(query_type)).take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([ids, batch.column(0).take(pa.array(at)), pa.array(bm25), pa.array(cosine, mask=~np.isfinite(cosine))], names=["query_id", "id", "bm25", "cosine"])
                    lo = hi

        part = rows.mapInArrow(score, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, bm25 double, cosine double")
        out = part if out is None else out.union(part)
    return out


def tfidf_cosine(words: DataFrame, query_words: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, cosine) over 0; with k, at least the k best of each query."""
    return lexical_scores(words, query_words, k, "cosine").filter("cosine IS NOT NULL").select("query_id", "id", "cosine")


def bm25(words: DataFrame, query_words: DataFrame, k1: float = config.BM25_K1, b: float = config.BM25_B, k: int | None = None) -> DataFrame:
    """(query_id, id, score) of documents with a term of the query; with k, at least the k best of each query."""
    return lexical_scores(words, query_words, k, "bm25", k1, b).select("query_id", "id", F.col("bm25").alias("score"))


def topk(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)
