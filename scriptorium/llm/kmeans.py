"""Exact k-means over whole numbers by exponion search.

A vector keeps an upper bound of the distance to its own centroid and a lower bound of that to any other. Both are moved
by what the centroids moved. If the upper bound is below the lower one, the nearest centroid is known. Otherwise the
distance to the own centroid is computed, and unless that settles it, only centroids inside a ball around the own one are
scanned, taken from its list of the others sorted by distance. With u the distance to the own centroid and s that from
there to the next one, nothing outside the radius 2u + s can be nearest or second nearest; the radius is inclusive, so
ties are seen, and the smaller number wins.

Vectors lie in blocks, one row of a table each, with their state. A round reads the last round's table and writes the
next: each block also has what its changed vectors add to and take from their centroids, so that a round brings sums of
k x components numbers to the driver, whatever the number of vectors. A lost executor costs parts of one round.

Assignments and centroids are exact: bounds only rule centroids out, with room for rounding, and what remains is decided
by whole numbers. Where squared distances fit into 64 bits they are computed so; blocks with larger components use Python's integers.

Defined cases: null vectors, vectors of another length, and vectors with null, NaN or infinite components take no part;
rows without id take part, but start no centroid; rows that share an id are vectors of their own, and of these the one
with the smaller components starts a centroid first; with fewer vectors than centroids there are as many as vectors;
equal vectors and ties go to the smaller number; a centroid without vectors stays; ids keep their type; distances beyond
a long are shown as the largest one; extra columns with any names are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scriptorium.llm.common import discard, saved

#: Vectors in a block.
BLOCK = 1024
#: Room for rounding when bounds are compared: relative and absolute.
ROOM, LEAST = 1e-9, 1e-6
LONG = 2**63 - 1


def bound(size: int) -> int:
    """Under this, squared distances of vectors fit into 64 bits."""
    return math.isqrt(2**62 // max(1, size)) // 2


def quantised(vectors: DataFrame, size: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): floor(1024 x) of the vectors that take part. Doubles hold these whole numbers exactly."""
    v = F.transform(F.col(vec_col), lambda x: 1024 * x.cast("double"))
    clean = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))  # larger doubles are whole
    return vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) == size)).filter(clean).select(F.col(id_col).alias("id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in order."""
    rank = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.filter("id IS NOT NULL").orderBy(rank, "v").limit(k).select("v").collect()
    return [[int(x) for x in r["v"]] for r in rows]


class Search:
    """Centroids of one round, with what the search needs of them."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None):
        self.whole = centroids
        self.wide = max((abs(x) for c in centroids for x in c), default=0) >= bound(len(centroids[0]))
        self.c = np.array(centroids, object if self.wide else np.int64)
        f = self.c.astype(np.float64)
        between = np.sqrt(np.array([[float(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) for y in centroids] for x in centroids])) if self.wide else np.sqrt(((f[:, None] - f[None]) ** 2).sum(axis=2))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, axis=1)  # sorted; a centroid itself may share its place
        k = len(centroids)
        self.next = np.array([min((d for j, d in zip(self.order[i], self.between[i], strict=True) if j != i), default=np.inf) for i in range(k)])
        moved = np.zeros(k) if before is None else np.array([float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for x, y in zip(centroids, before, strict=True)])
        self.moved = moved * (1 + ROOM) + LEAST * (moved > 0)
        # the largest move of any other centroid
        top = np.sort(self.moved)[::-1]
        self.others = np.where(self.moved == top[0], top[1] if k > 1 else 0.0, top[0])

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of rows of x to the centroids `which`, one for each row; exact."""
        if x.dtype == object or self.wide:
            return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(r, self.whole[j], strict=True)) for r, j in zip(x, which, strict=True)], object)
        d = x - self.c[which]
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Sets own, upper and lower for the vectors x in place. Returns how many distances to centroids were computed."""
        upper += self.moved[own]
        lower -= self.others[own]
        todo = np.flatnonzero(~(upper * (1 + ROOM) + LEAST < lower))
        if not len(todo):
            return 0
        mine = self.distances(x[todo], own[todo])
        upper[todo] = np.sqrt(mine.astype(np.float64))
        still = ~(upper[todo] * (1 + ROOM) + LEAST < lower[todo])
        computed = len(todo)
        todo, mine = todo[still], mine[still]
        held = own[todo]  # a copy: own changes below
        for j in np.unique(held).tolist():
            at = held == j
            rows, best = todo[at], mine[at]
            # inclusive, so that ties on the rim are seen
            radius = (2 * upper[rows] + self.next[j]) * (1 + ROOM) + LEAST
            reach = np.searchsorted(self.between[j], radius, side="right")
            number, second = np.full(len(rows), j), np.full(len(rows), np.inf, object if best.dtype == object else np.float64)
            best = best.copy()
            for place in range(int(reach.max(initial=0))):
                other = int(self.order[j, place])
                if other == j:
                    continue
                inside = np.flatnonzero(reach > place)
                d = self.distances(x[rows[inside]], np.full(len(inside), other))
                computed += len(inside)
                b, n, s = best[inside], number[inside], second[inside]
                wins = (d < b) | ((d == b) & (other < n))
                second[inside] = np.where(wins, b, np.minimum(s, d))
                best[inside], number[inside] = np.where(wins, d, b), np.where(wins, other, n)
            # a centroid outside the ball is farther than both that were found inside
            own[rows], upper[rows], lower[rows] = number, np.sqrt(best.astype(np.float64)), np.sqrt(second.astype(np.float64))
        return computed


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _vectors(row: dict) -> np.ndarray:
    if row["wide"]:
        return np.array([[int(float(y)) for y in r] for r in np.frombuffer(row["x"]).reshape(-1, row["size"])], object).reshape(-1, row["size"])
    width = len(row["x"]) // max(1, row["n"] * row["size"])
    return np.frombuffer(row["x"], np.dtype(f"i{width}")).reshape(row["n"], row["size"]).astype(np.int64)


def _packed(v: np.ndarray) -> tuple[bytes, bool]:
    """The block's vectors in as few bytes as hold them; (bytes, whether they need Python's integers)."""
    top = np.abs(v).max(initial=0)
    if top >= bound(v.shape[1]):
        return v.astype(np.float64).tobytes(), True
    return v.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64).tobytes(), False


def _moves(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
    """What changed vectors add to and take from each centroid."""
    out = []
    changed = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    touched = set(new[changed].tolist()) | (set() if old is None else set(old[changed].tolist()))
    for j in sorted(touched):
        came = changed[new[changed] == j]
        left = changed[:0] if old is None else changed[old[changed] == j]
        out.append({"c": j, "n": len(came) - len(left), "s": [Decimal(int(a)) for a in x[came].sum(axis=0) - x[left].sum(axis=0)]})
    return out


MOVES = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.decimal128(38, 0)))]))
BLOCKS = pa.schema([("ids", pa.binary()), ("x", pa.binary()), ("n", pa.int32()), ("size", pa.int32()), ("wide", pa.bool_()), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("moves", MOVES), ("computed", pa.int64())])
BLOCKS_SQL = "ids binary, x binary, n int, size int, wide boolean, own binary, upper binary, lower binary, moves array<struct<c:int,n:bigint,s:array<decimal(38,0)>>>, computed bigint"


def _row(ids: bytes, x: np.ndarray, packed: bytes, wide: bool, old, own, upper, lower, computed: int) -> dict:
    return {"ids": ids, "x": packed, "n": len(x), "size": x.shape[1], "wide": wide, "own": own.astype(np.int32).tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "moves": _moves(x, old, own), "computed": computed}


def first_round(centroids: list[list[int]], size: int):
    """Blocks of vectors from batches of rows (id, v), each vector assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                packed, wide = _packed(v)
                x = np.array([[int(a) for a in r] for r in v], object) if wide else v.astype(np.int64)
                own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
                computed = search.nearest(x, own, upper, lower)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([part.schema.field(0)])) as w:
                    w.write_batch(pa.record_batch([part.column(0)], schema=pa.schema([part.schema.field(0)])))
                yield pa.RecordBatch.from_pylist([_row(sink.getvalue().to_pybytes(), x, packed, wide, None, own, upper, lower, computed)], schema=BLOCKS)

    return run


def next_round(centroids: list[list[int]], before: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for row in _rows(batches):
            x = _vectors(row)
            old = np.frombuffer(row["own"], np.int32).astype(np.int64)
            own, upper, lower = old.copy(), np.frombuffer(row["upper"]).copy(), np.frombuffer(row["lower"]).copy()
            computed = search.nearest(x, own, upper, lower)
            yield pa.RecordBatch.from_pylist([_row(row["ids"], x, row["x"], row["wide"], old, own, upper, lower, computed)], schema=BLOCKS)

    return run


def unpacked(centroids: list[list[int]], schema: pa.Schema):
    """(id, cluster, distance) rows of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for row in _rows(batches):
            own = np.frombuffer(row["own"], np.int32)
            d = search.distances(_vectors(row), own)
            if d.dtype == object:
                d = np.array([min(int(x), LONG) for x in d], np.int64)
            ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), pa.array(own), pa.array(d, pa.int64())], schema=schema)

    return run


def moved_sums(blocks: DataFrame) -> list[tuple[int, int, list[int]]]:
    """(centroid, change of its count, changes of its sums): at most k rows."""
    one = blocks.select(F.explode("moves").alias("m")).select("m.c", "m.n", F.posexplode("m.s").alias("i", "s"))
    parts = one.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = parts.groupBy("c").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s")).collect()
    return [(r["c"], r["n"], [int(x["s"]) for x in r["s"]]) for r in rows]


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", seed: str = "3:") -> tuple[DataFrame, list[list[int]], float]:
    """((id, cluster, distance) of every vector, the final centroids, the share of vector-centroid distances computed)."""
    spark = vectors.sparkSession
    rows = quantised(vectors, size, id_col, vec_col)
    centroids = first_centroids(rows, k, seed)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not centroids:
        return rows.filter("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], 0.0
    count, sums = [0] * len(centroids), [[0] * size for _ in centroids]
    blocks, computed, total = None, 0, 0
    for done in range(rounds + 1):
        if blocks is None:
            new = saved(rows.mapInArrow(first_round(centroids, size), BLOCKS_SQL), "kmeans")
        else:
            new = saved(blocks.mapInArrow(next_round(centroids, before), BLOCKS_SQL), "kmeans")
            discard(blocks)
        blocks = new
        spent = blocks.agg(F.sum("computed").alias("c"), F.sum("n").alias("n")).first()
        computed, total = computed + spent["c"], total + spent["n"] * len(centroids)
        if done == rounds:
            break
        for c, n, s in moved_sums(blocks):
            count[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s, strict=True)]
        before = centroids
        centroids = [[s // count[c] for s in sums[c]] if count[c] else list(centroids[c]) for c in range(len(centroids))]
    shape = StructType([StructField("id", vectors.schema[id_col].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    found = blocks.mapInArrow(unpacked(centroids, to_arrow_schema(shape)), f"id {kind}, cluster int, distance long")
    return found, centroids, computed / max(1, total)


def op12_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found, centroids, _ = kmeans(vectors, k, rounds, size)
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    bounded = lambda x: min(x, LONG)
    facts = [(c, bounded(sums.get(c, 0)), bounded(sum(sums.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    per = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """The same by plain rounds: every vector against every centroid."""
    near = "SELECT r, c FROM (SELECT r, p.c, row_number() OVER (PARTITION BY r ORDER BY list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), p.c) AS n FROM w, {at} p) WHERE n = 1"
    parts = [
        f"w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INT) AS c, v AS m FROM w WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({near.format(at=f'm{i}')})",
            f"s{i} AS MATERIALIZED (SELECT c, list(CAST(CASE WHEN t >= 0 THEN t // n ELSE -((-t + n - 1) // n) END AS BIGINT) ORDER BY j) AS m FROM (SELECT c, j, sum(x) AS t, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i} JOIN w USING (r)) GROUP BY c, j) GROUP BY c)",
            f"m{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.m, o.m) AS m FROM m{i} o LEFT JOIN s{i} s USING (c))",
        ]
    parts += [
        f"f AS MATERIALIZED ({near.format(at=f'm{rounds}')})",
        f"d AS MATERIALIZED (SELECT w.vec_id, f.c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance, sha256(array_to_string(m, ',')) AS h FROM f JOIN w USING (r) JOIN m{rounds} USING (c))",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM d"
