"""Joins of dense vectors. Both compare bounded tiles with one matrix product each and emit only what passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a tile of the search for nearest ones.
TILE = 4096
#: Tiles of a join of pairs, and vectors in one: so many tiles as give work to all tasks, more only beyond the upper bound.
SIDES, SIDE_LEAST, SIDE_MOST = 8, 512, 1 << 16
#: Similarities computed at once in a task.
CELLS = 1 << 22


def sides(n: int, most: int = SIDE_MOST) -> int:
    """Tiles that n rows are dealt to where all pairs of tiles meet: each row is sent so many times."""
    return max(1, -(-n // most), min(SIDES, n // SIDE_LEAST))


def _tiled(vectors: DataFrame, tiles: int) -> DataFrame:
    return vectors.select("id", "v").withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)


def _units(rows: pd.Series) -> np.ndarray:
    m = _matrix(rows)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _unit_lists(lists: pa.ListArray) -> np.ndarray:
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def pairs_above(vectors: DataFrame, threshold: float, tile: int = SIDE_MOST) -> DataFrame:
    """(a, b, similarity) for pairs of ids a < b with a cosine of at least threshold, from (id, v).

    Every pair of tiles meets in one task, which holds two tiles and a strip of similarities. A vector is sent once for
    each tile; these have up to `tile` vectors, so that their number, and the shuffle for a vector, stays the same over
    a wide range of sizes.
    """
    tiles = sides(vectors.count(), tile)
    own = _tiled(vectors, tiles)
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    # the pair (i, j) of tiles, i <= j, has the vectors of both
    sent = own.withColumn("other", other).select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "v")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        at = rows.column("tile").to_numpy()
        left, right = (rows.filter(pa.array(at == k.as_py())).combine_chunks() for k in key)
        del rows
        if not left.num_rows or not right.num_rows:
            return
        x, y = (_unit_lists(t.column("v").combine_chunks()) for t in (left, right))
        a, b = (t.column("id").to_numpy() for t in (left, right))
        del left, right
        for at in range(0, len(x), step := max(1, CELLS // len(y))):
            s = x[at : at + step] @ y.T
            p, q = np.divmod(np.flatnonzero(s >= threshold - 1e-12), len(y))
            one, two = a[at + p], b[q]
            keep = one < two if key[0] == key[1] else one != two
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[keep]), pa.array(np.maximum(one, two)[keep]), pa.array(s[p, q][keep])], schema=schema)

    return sent.groupBy("i", "j").applyInArrow(meet, "a long, b long, similarity double")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of vectors for each row of queries, itself left out."""
    tiles, chunks = max(1, -(-vectors.count() // TILE)), max(1, -(-queries.count() // TILE))
    left = _tiled(vectors, tiles).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.select("id", "v").withColumns({"chunk": F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"), "tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})

    def best(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(asked):
            d, q, ids = _units(docs["v"]), _units(asked["v"]), docs["id"].to_numpy()
            for own, row in zip(asked["id"], q, strict=True):
                s = np.round(d @ row, 12)
                s[ids == own] = -np.inf
                # all that tie with the k-th are kept for the final ranking
                limit = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                out += [(own, i, x) for i, x in zip(ids[s >= limit], s[s >= limit], strict=True) if x >= least]
        return pd.DataFrame(out, columns=["query_id", "id", "similarity"]).astype({"query_id": "int64", "id": "int64", "similarity": "float64"})

    found = left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInPandas(best, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def centroids(members: DataFrame, key: str) -> DataFrame:
    """(key, centroid): the mean of v for each value of key; partial sums by component are made before the shuffle."""
    parts = members.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(key, F.col("c.m").alias("centroid"))
