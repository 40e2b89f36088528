"""Exact top-k by integer inner product with block-at-a-time pruning.

Tiles are (shard of vectors) x (chunk of queries) of bounded size, so no task holds all of either. Within a tile similar
vectors lie side by side (a few rounds of k-means set the order) and are cut into blocks. A block keeps the largest and
smallest value of each component, and its mean and radius; the sum over components of the larger product with a query,
or the product with the mean plus the query's length times the radius, bounds every score in it, whichever is less.
Blocks are taken in falling order of their largest bound; the queries whose bound reaches their k-th score so far are
scored through the block's rows in one product. What one tile finds for a query holds for all: of several shards, one
is searched first for each query, and its k-th score is where the others start.

Results are exact whatever the bounds rule out. On vectors without clusters they rule out little (README).

Defined cases: null vectors and vectors that hold null, infinite or NaN components take no part, nor do rows without
id; a shorter vector counts as padded with zeros; every row is a candidate but the query's own, also rows that share an
id, and of several rows with a query's id each is a query, whose results share that id; equal scores go by smaller id;
ids keep their type; sums are exact whole numbers, shown as the largest or smallest long where they go beyond it; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import saved

#: Vectors in a block; in a tile's shard; queries in a tile's chunk.
BLOCK, SHARD, CHUNK = 64, 8192, 2048
ROUNDS = 4


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 1024))
    clean = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(clean).select(F.col(id_col).alias("id"), v.alias("v"))


def matrices(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Both as rows of one width: doubles where every product and sum is exact, else Python's integers."""
    width = max((len(r) for r in (*left, *right)), default=0)
    largest = [max((max(abs(int(r.min())), abs(int(r.max()))) for r in rows if len(r)), default=0) for rows in (left, right)]
    exact = max(largest) < 2**26 and width * largest[0] * largest[1] < 2**52
    out = []
    for rows in (left, right):
        m = np.zeros((len(rows), width), np.float64 if exact else object)
        for i, r in enumerate(rows):
            m[i, : len(r)] = r if exact else [int(x) for x in r]
        out.append(m)
    return out[0], out[1]


def ordered(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which similar ones are neighbours: by nearest of some centres, then as given."""
    n = -(-len(vectors) // (2 * block))
    if n < 2 or vectors.dtype == object:
        return np.arange(len(vectors))
    centres = vectors[np.linspace(0, len(vectors) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = (vectors @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        size = np.bincount(near, minlength=n)[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return np.lexsort((np.arange(len(vectors)), near))


def block_bounds(q: np.ndarray, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(queries x blocks): no score in a block is above."""
    top, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    if vectors.dtype == object:
        return bounds
    size = np.diff(np.append(starts, len(vectors)))
    mean = np.add.reduceat(vectors, starts, axis=0) / size[:, None]
    away = vectors - np.repeat(mean, size, axis=0)
    radius = np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), starts))
    ball = q @ mean.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius
    return np.minimum(bounds, ball * (1 + 1e-9 * np.sign(ball)) + 1)  # room for rounding


def tile_topk(q: np.ndarray, vectors: np.ndarray, k: int, floors=None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query, row, score) of the k best rows of each query, equal scores by row, by query; and the share of scores computed.

    floors: for each query a score under which rows are not wanted (None: not known).
    """
    order = ordered(vectors, block)
    v = vectors[order]
    starts = np.arange(0, len(v), block)
    bounds = block_bounds(q, v, starts)
    kth = np.full(len(q), -np.inf, dtype=object if v.dtype == object else np.float64)
    if floors is not None:
        known = np.array([f is not None for f in floors])
        kth[known] = [f for f in floors if f is not None]
    query, row, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, v.dtype)
    computed = 0

    def best(query, row, score):
        by = np.lexsort((row, query)) if v.dtype == object else np.lexsort((row, -score, query))
        if v.dtype == object:
            by = np.array(sorted(by.tolist(), key=lambda i: (query[i], -score[i], row[i])), np.int64)
        query, row, score = query[by], row[by], score[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == k - 1
        kth[query[full]] = np.maximum(kth[query[full]], score[full])
        return query[place < k], row[place < k], score[place < k]

    waiting: list[tuple] = []
    for b in np.argsort(-bounds.max(axis=0, initial=0).astype(float), kind="stable"):
        asked = np.flatnonzero(bounds[:, b] >= kth)
        if len(asked):
            own = slice(starts[b], min(len(v), starts[b] + block))
            s = q[asked] @ v[own].T
            computed += s.size
            i, j = np.nonzero(s >= kth[asked][:, None])
            waiting.append((asked[i], order[own][j], s[i, j]))
            if sum(len(w[0]) for w in waiting) >= 4 * k * len(q):
                query, row, score = best(*(np.concatenate(x) for x in zip((query, row, score), *waiting, strict=True)))
                waiting = []
    query, row, score = best(*(np.concatenate(x) for x in zip((query, row, score), *waiting, strict=True)))
    return query, row, score, computed / max(1, len(q) * len(v))


def inner_product_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of vectors. A query's own row, one of
    the same id and vector, is left out if it is there."""
    kind = vectors.schema[id_col].dataType.simpleString()
    # more than k + 1 equal rows can't all be among the results
    docs = quantised(vectors, id_col, vec_col).groupBy("id", "v").agg(F.count("*").alias("n"))
    docs = saved(docs.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k + 1).cast("long"))))), "vectors")
    asked = saved(quantised(queries, id_col, vec_col).withColumn("q", F.monotonically_increasing_id()), "queries")
    shards = max(1, -(-docs.count() // SHARD))
    chunks = max(1, -(-asked.count() // CHUNK))

    def one_tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": right["q"].iloc[:0], "vec_id": left["id"].iloc[:0], "score": np.empty(0, np.int64), "own": np.empty(0, bool)})
        left = left.sort_values("id", kind="stable")
        d, q = matrices(list(left["v"]), list(right["v"]))
        floors = [None if pd.isna(f) else int(f) for f in right["floor"]]
        query, row, score, _ = tile_topk(q, d, k + 1, None if all(f is None for f in floors) else floors)
        bounded = [min(max(int(s), -(2**63)), 2**63 - 1) for s in score]
        ids = left["id"].to_numpy()[row]
        own = ids == right["id"].to_numpy()[query]
        own[own] = (d[row[own]] == q[query[own]]).all(axis=1)
        return pd.DataFrame({"q": right["q"].to_numpy()[query], "vec_id": ids, "score": np.array(bounded, np.int64), "own": own})

    def tiles(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select("q", "id", "v", "floor", "chunk", "shard")
        return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(one_tile, f"q long, vec_id {kind}, score long, own boolean")

    placed = docs.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    chunked = asked.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")).withColumn("floor", F.lit(None).cast("long"))
    every = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    if shards > 1:  # one shard for each chunk gives a score that the others must reach
        first = chunked.withColumn("shard", F.pmod(F.col("chunk"), F.lit(shards)).cast("int"))
        own = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).filter(F.pmod(F.col("chunk"), F.lit(shards)) == F.col("shard"))
        low = tiles(own, first).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k + 1).select("q", "least")
        chunked = chunked.drop("floor").join(saved(low, "floors"), "q", "left").withColumnRenamed("least", "floor")
    right = chunked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = tiles(every, right).join(asked.select("q", F.col("id").alias("query_id")), "q")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k + 1)
    # of rows equal to the query, one is its own
    own = F.coalesce(F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("q")), F.lit(k + 2))
    ranked = ranked.withColumn("at", own).filter(F.col("rank") != F.col("at"))
    ranked = ranked.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("at")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(vectors: DataFrame) -> DataFrame:
    return inner_product_topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e d ON q.r <> d.r WHERE q.vec_id % 100 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10"""
