"""Toxicity by nearest labelled examples under TF-IDF cosine.

Terms are all words, hashed to VOCABULARY dimensions; none is left out. A term weighs (1 + ln count) * idf * relevance.
Document frequencies come from all documents. The relevance of a term is 1, and more for terms whose share of toxic
texts among the examples differs significantly from the base rate (likelihood ratio, less its bound over all terms):
without that factor the cosine follows the language and the length of a text (figures in the README).

A bounded sample of labelled rows gives the examples: the EXAMPLES rows of smallest hash of doc_id, as far as their
distinct terms sum to ENTRIES at most. They lie in an inverted index that is cut into blocks of similar examples; a
block holds the largest weight of each term, so a product with a text's weights bounds every cosine in it. For a batch
of texts, each text's FIRST most promising blocks are scored, and of the others those whose bound reaches the k-th
cosine found; so the neighbours are exact. The terms of most examples are kept as a dense forward index of the block,
the others as postings. Neighbours vote with their cosine cubed against the share of toxic examples; a logistic curve
fitted on leave-one-out votes turns the vote into a score. Each score carries its nearest examples as evidence.

Labels, lang, source and doc_id are no inputs of a score: doc_id only decides which rows are held out and sampled.

Defined cases: a null or empty text has no terms and gets the score of such texts; labels that are null are left out, and
of several labels of a document the greatest counts, of several texts of an id too; ids may be null, repeated and of
any type that labels can be cast to; without training rows every score is 0; texts are read whole; equal cosines go by
the order of the sample; repeated rows give a row each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.llm.common import low_hash, returned, saved, small_batches
from scriptorium.llm.words import batch_word_hashes

#: Bounds of the fit: labelled rows, and their distinct terms in sum.
EXAMPLES, ENTRIES = 4096, 1 << 22
BITS = 20
VOCABULARY = 1 << BITS
#: Examples in a block, terms of the dense forward index, blocks scored before any bound is used, texts scored at once.
BLOCK, DENSE, FIRST, TEXTS = 64, 512, 4, 128
NEIGHBOURS, SHRINK, RELEVANCE = 15, 0.05, 3.0
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), by text, then term."""
    hashes, words = batch_word_hashes(texts, apart=True)
    keys = np.repeat(np.arange(len(texts)), words) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    keys, n = np.unique(keys, return_counts=True)
    return keys >> BITS, keys & (VOCABULARY - 1), n


def relevance(row: np.ndarray, term: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms of the examples, a factor for each)."""
    terms, at = np.unique(term, return_inverse=True)
    n = np.bincount(at, minlength=len(terms)).astype(float)
    base = toxic.mean() if len(toxic) else 0.0
    if not 0 < base < 1:
        return terms, np.ones(len(terms))
    share = np.bincount(at, toxic[row], minlength=len(terms)) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = n * (np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    return terms, 1 + RELEVANCE * np.sqrt(np.maximum(0, ratio - math.log(max(2, len(terms)))))


class Index:
    """Unit vectors of the examples in blocks, with the largest weight of each term in a block."""

    def __init__(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, toxic: np.ndarray, df: np.ndarray, n: int):
        self.toxic, self.n, self.block = toxic.astype(float), len(toxic), BLOCK
        self.base = float(self.toxic.mean()) if self.n else 0.0
        self.a, self.b = 1.0, 0.0
        self.weight = np.log((1 + n) / (1 + df)) + 1
        terms, factor = relevance(row, term, self.toxic)
        self.weight[terms] *= factor
        value = self.unit(row, term, count, self.n)
        held = np.bincount(np.searchsorted(terms, term), minlength=len(terms))
        common = np.sort(terms[np.argsort(-held, kind="stable")[:DENSE]])
        self.place = np.full(VOCABULARY, -1, np.int16)
        self.place[common] = np.arange(len(common))
        dense = self.place[term] >= 0
        # similar examples side by side: by label, then by their heaviest common term
        heaviest = np.zeros(self.n, np.int64)
        rising = np.lexsort((value[dense], row[dense]))
        heaviest[row[dense][rising]] = self.place[term[dense][rising]]
        self.order = np.lexsort((np.arange(self.n), heaviest, -self.toxic))
        self.blocks = -(-self.n // self.block)
        rank = np.empty(self.n, np.int64)
        rank[self.order] = np.arange(self.n)
        self.forward = np.zeros((self.n, DENSE))
        self.forward[rank[row[dense]], self.place[term[dense]]] = value[dense]
        self.dense_top = np.array([self.forward[b * self.block : (b + 1) * self.block].max(axis=0) for b in range(self.blocks)]).reshape(-1, DENSE).T
        by_term = np.lexsort((rank[row[~dense]], term[~dense]))
        rare, self.posting, self.value = term[~dense][by_term], rank[row[~dense]][by_term].astype(np.int32), value[~dense][by_term]
        self.terms, self.start = np.unique(rare, return_index=True)
        self.start = np.append(self.start, len(rare))

    def unit(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(count)) * self.weight[term]
        return w / np.sqrt(np.bincount(row, w * w, minlength=n))[row]

    def nearest(self, row, term, count, n: int, without=None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, example, cosine) of the k largest cosines over 0 of each of n texts, in falling order, and the blocks scored.

        without[i] is an example that is no neighbour of text i.
        """
        q = self.unit(row, term, count, n)
        dense = np.zeros((n, DENSE))
        at = self.place[term]
        dense[row[at >= 0], at[at >= 0]] = q[at >= 0]
        # postings of the other terms
        found = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        hit = np.flatnonzero((self.terms[found] == term) & (at < 0)) if len(self.terms) else np.empty(0, int)
        lo = self.start[found[hit]]
        length = self.start[found[hit] + 1] - lo if len(hit) else lo
        entry = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
        text, example, part = np.repeat(row[hit], length), self.posting[entry], self.value[entry] * np.repeat(q[hit], length)
        owner = np.repeat(np.arange(len(hit)), length) * self.blocks + example // self.block
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
        top = np.maximum.reduceat(part, first) if len(first) else part
        bounds = dense @ self.dense_top + np.bincount(text[first] * self.blocks + example[first] // self.block, top, minlength=n * self.blocks).reshape(n, self.blocks)
        cosines = np.bincount(text * self.n + example, part, minlength=n * self.n).astype(float).reshape(n, self.n)  # of no entries: whole numbers
        done = np.zeros((n, self.blocks), bool)
        done[np.arange(n)[:, None], np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]] = True
        wanted, kth = done, np.zeros(n)
        for _ in range(2):
            for b in np.flatnonzero(wanted.any(axis=0)):
                own = slice(b * self.block, (b + 1) * self.block)
                texts = np.flatnonzero(wanted[:, b])
                cosines[texts, own] += dense[texts] @ self.forward[own].T
            seen = np.where(np.repeat(done, self.block, axis=1)[:, : self.n], cosines, 0)
            if without is not None:
                place = np.empty(self.n, np.int64)
                place[self.order] = np.arange(self.n)
                seen[np.arange(n), place[without]] = 0
            if self.n > k:
                kth = np.partition(seen, self.n - k, axis=1)[:, self.n - k]
            wanted = ~done & (bounds >= kth[:, None] - 1e-9) & (bounds > 0)
            done = done | wanted
        seen = np.round(seen, 9)
        text, at = np.nonzero((seen > 0) & (seen >= np.round(kth, 9)[:, None]))
        cosine, example = seen[text, at], self.order[at]
        by = np.lexsort((example, -cosine, text))
        text, cosine, example = text[by], cosine[by], example[by]
        begin = np.searchsorted(text, np.arange(n))
        keep = np.arange(len(text)) - begin[text] < k
        return text[keep], example[keep], cosine[keep], int(done.sum())

    def votes(self, text, example, cosine, n: int) -> np.ndarray:
        w = cosine**3
        return (np.bincount(text, w * self.toxic[example], minlength=n) + SHRINK * self.base) / (np.bincount(text, w, minlength=n) + SHRINK)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        v = np.clip(votes, 1e-4, 1 - 1e-4)
        return np.round(1 / (1 + np.exp(-(self.a * np.log(v / (1 - v)) + self.b))), 6)

    def calibrate(self, row, term, count) -> None:
        """Newton steps for a logistic curve over leave-one-out votes, with a weak pull to the identity."""
        v, step = [], TEXTS
        edges = np.searchsorted(row, np.arange(0, self.n + step, step))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = np.arange(i * step, min(self.n, (i + 1) * step))
            near = self.nearest(row[lo:hi].astype(np.int64) - i * step, term[lo:hi], count[lo:hi], len(own), own)
            v.append(self.votes(*near[:3], len(own)))
        v = np.clip(np.concatenate(v), 1e-4, 1 - 1e-4)
        x, y = np.c_[np.log(v / (1 - v)), np.ones(len(v))], self.toxic
        beta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (p - y) + (beta - [1.0, 0.0])
            beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
        if beta[0] > 0 and np.isfinite(beta).all():
            self.a, self.b = map(float, beta)


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and their number; over all rows."""

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(VOCABULARY, np.int64), 0
        for b in it:
            n += b.num_rows
            for texts in groups(b.column(0).to_pylist()):
                df += np.bincount(term_counts(texts)[1], minlength=VOCABULARY)
        used = np.flatnonzero(df)
        term, count = np.append(used, VOCABULARY), np.append(df[used], n)
        for i in range(0, len(term), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(term[i : i + (1 << 16)], pa.int32()), pa.array(count[i : i + (1 << 16)], pa.int64())], names=["term", "n"])
        del df, used, term, count
        returned()

    sums = docs.select(F.coalesce(text_col, F.lit(""))).mapInArrow(tasks, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # VOCABULARY + 1 rows at most
    df = np.zeros(VOCABULARY + 1)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df[:-1], int(df[-1])


def groups(texts: list[str | None], chars: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts in order, at most TEXTS and, but for a longer one, `chars` characters at once."""
    part, size = [], 0
    for t in texts:
        if part and (len(part) == TEXTS or size + len(t or "") > chars):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, doc_id, toxic, size, terms, counts): the sampled labelled rows, at most EXAMPLES of them with ENTRIES terms."""
    kind = docs.schema[id_col].dataType
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").try_cast(kind).alias("doc_id"), "toxic")
    # the fold goes by the document's id as text, whatever type the label's has
    chosen = chosen.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = docs.select(F.col(id_col).alias("doc_id")).join(chosen, "doc_id", "left_semi").distinct().join(chosen, "doc_id")
    present = saved(present.withColumn("h", F.xxhash64("doc_id")), "labelled")
    sample = present.filter(low_hash(F.col("h"), EXAMPLES, present.count())).orderBy("h", "doc_id").limit(EXAMPLES)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("h", "doc_id", "toxic").agg(F.max("text").alias("text"))
    name = kind.simpleString()

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [term_counts([t]) for t in b.column(3).to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(t) for _, t, _ in found], pa.int64()), pa.array([t for _, t, _ in found], ints), pa.array([n for _, _, n in found], ints)], names=["h", "doc_id", "toxic", "size", "terms", "counts"])

    made = saved(texts.mapInArrow(vectors, f"h long, doc_id {name}, toxic int, size long, terms array<int>, counts array<int>"), "examples")
    sizes = sorted((r.h, r.size) for r in made.select("h", "size").collect())  # EXAMPLES rows at most
    sizes = [(h, size) for h, size in sizes if size <= ENTRIES]  # a text beyond the bound alone is passed over
    fits = int(np.searchsorted(np.cumsum([size for _, size in sizes]), ENTRIES, side="right"))
    return made.filter((F.col("h") <= sizes[fits - 1][0]) & (F.col("size") <= ENTRIES)) if fits else made.limit(0)


def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(example, term, count), and of the examples: labels, ids; in the order of the sample."""
    ids = table.column("doc_id").to_pylist()
    table = table.append_column("name", pa.array(map(str, ids), pa.string())).sort_by([("h", "ascending"), ("name", "ascending")]).combine_chunks()
    row = np.repeat(np.arange(len(ids)), table.column("size").to_numpy())
    flat = lambda name: pa.concat_arrays([c.flatten() for c in table.column(name).chunks] or [pa.array([], pa.int32())]).to_numpy().astype(np.int64)
    return row, flat("terms"), flat("counts"), table.column("toxic").to_numpy(), table.column("doc_id").to_pylist()


def sampled(sample: DataFrame, df: np.ndarray, n: int) -> dict:
    """What an index is built from, in small types: EXAMPLES, ENTRIES and VOCABULARY bound it to some 40 MB at most."""
    row, term, count, toxic, ids = arrays(sample.toArrow())
    small = np.int32 if df.max(initial=0) < 2**31 else np.int64
    return {"row": row.astype(np.int16), "term": term.astype(np.int32), "count": count.astype(np.int32), "toxic": toxic, "df": df.astype(small), "n": n, "ids": ids}


def restored(given: dict, curve: tuple[float, float] | None = None) -> tuple[Index, list]:
    """The index and the ids of its examples; built once in a worker, which then holds them in place of the sample.

    Without a curve it is fitted here. The sample stays in its small types: wide copies of it would be the larger part.
    """
    if "model" not in given:
        index, ids = Index(*(given[k] for k in ("row", "term", "count", "toxic", "df", "n"))), given["ids"]
        if curve is None:
            index.calibrate(given["row"], given["term"], given["count"])
        given.clear()
        given["model"] = index, ids
        returned()
    index, ids = given["model"]
    if curve is not None:
        index.a, index.b = curve
    return index, ids


def calibrated(spark, shared) -> tuple[float, float]:
    """The two numbers of the curve, found by one task, as ENTRIES bounds its input."""

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in it:
            index, _ = restored(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([index.a]), pa.array([index.b])], names=["a", "b"])

    return tuple(spark.range(0, 1, 1, 1).mapInArrow(fit, "a double, b double").first())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep ..., score, predicted, evidence) for each row of docs; keep names columns of docs (by default its id)."""
    small_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    sample = examples(docs, labels, id_col, text_col)
    spark = docs.sparkSession
    shared, curve = None, (1.0, 0.0)
    if sample.take(1):
        shared = spark.sparkContext.broadcast(sampled(sample, *frequencies(docs, text_col)))  # EXAMPLES, ENTRIES and VOCABULARY bound it
        curve = calibrated(spark, shared)
    kept = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    width, schema = len(keep), kept.select(keep).schema
    id_type = docs.schema[id_col].dataType

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = restored(shared.value, curve) if shared is not None else (None, [])
        shape = pa.list_(pa.struct([("doc_id", to_arrow_type(id_type)), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for b in it:
            scores, evidence = [], []
            for texts in groups(b.column(width).to_pylist()):
                n = len(texts)
                if index is None:
                    scores += [0.0] * n
                    evidence += [[]] * n
                    continue
                text, example, cosine, _ = index.nearest(*term_counts(texts), n)
                scores += index.scores(index.votes(text, example, cosine, n)).tolist()
                near = [[] for _ in range(n)]
                for t, e, c in zip(text.tolist(), example.tolist(), cosine.tolist(), strict=True):
                    if len(near[t]) < 3:
                        near[t].append({"doc_id": ids[e], "similarity": c, "toxic": int(index.toxic[e])})
                evidence += near
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, shape)], names=[*b.schema.names[:width], "score", "predicted", "evidence"])
        returned()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return kept.mapInArrow(score, f"{ddl}, score double, predicted int, evidence array<struct<doc_id:{id_type.simpleString()},similarity:double,toxic:int>>")


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
