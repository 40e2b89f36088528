"""Threshold joins of papers by several signals at once: cosine of vectors, shared authors, shared tags.

Papers lie in tiles of bounded size, by a hash of the id. Two papers are compared where their tiles meet, in one task, so
no pair leaves a task but those that pass. A paper is sent to the tiles where it may have a partner only:

- With weights w and a threshold T, no pair passes if each signal stays below a bound of its own and the weighted bounds
  sum to T at most. So a pair that passes reaches the bound of one signal.
- Sparse vectors that reach a cosine of t share a term of both prefixes. Terms are ordered from rare to frequent; a
  prefix leaves out the most frequent terms as long as their norm, which bounds what they can add, is under t.
- Sets that reach a Jaccard of j share a value among the first n - ceil(j n) + 1 of each, in the same order.
- Terms and values that more papers have than there are tiles (times HOT) send a paper to every tile, without a join; all
  others have few papers each, so no key of the routing join is frequent.
- Where many papers would go everywhere, none is routed: papers are packed in blocks, a few bytes an entry, and blocks
  meet in few large tiles.
- Dense vectors have no such prefix; they meet in every tile. So their tiles are large and few, and compared in strips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.operators.vectors import CELLS, SIDE_MOST, sides
from scriptorium.storage import saved

#: Papers in a tile; papers of a term, for each tile, from which on it counts as frequent.
TILE, HOT = 1024, 4
#: Share of papers that would be sent to every tile from which on all are packed and compared; papers in a tile of these at most.
WIDE, PAPERS = 0.25, 1 << 18
#: Terms of two tiles that are multiplied as dense matrices; products of the others made at once.
DENSE_TERMS, DENSE_LEAST, PRODUCTS = 1024, 512, 1 << 22
ENTRY = "array<struct<df:bigint,h:bigint,w:double>>"


def ordered_vectors(weights: DataFrame) -> DataFrame:
    """(id, v): vectors of norm 1 as entries (df, h, w), from (id, term, weight, df), rarest term first; empty ones go."""
    one = weights.filter("weight <> 0").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("term").alias("h"), F.col("weight").alias("w")))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    units = one.withColumn("norm", norm).filter("norm > 0")
    return units.select("id", F.transform("v", lambda x: F.struct(x["df"].alias("df"), x["h"].alias("h"), (x["w"] / F.col("norm")).alias("w"))).cast(ENTRY).alias("v"))


def ordered_sets(rows: DataFrame) -> DataFrame:
    """(id, v): sets as entries (df, h, 1), from (id, value), rarest value first."""
    own = rows.filter("value IS NOT NULL").select("id", F.xxhash64("value").alias("h")).distinct()
    counted = own.join(own.groupBy("h").agg(F.count("*").alias("df")), "h")
    return counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h", F.lit(1.0).alias("w")))).cast(ENTRY).alias("v"))


def cosine_prefix(v: Column, least: float) -> Column:
    """The entries of v that a vector with a cosine of `least` or more must share one of."""
    limit = (least * (1 - 1e-9)) ** 2

    def drop(s: Column, x: Column) -> Column:
        sum_ = s["sum"] + x["w"] * x["w"]
        return F.when(sum_ < limit, F.struct(sum_.alias("sum"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(4.0).alias("sum"), s["n"].alias("n")))

    spare = F.aggregate(F.reverse(v), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), drop)["n"]
    return F.slice(v, 1, F.size(v) - spare)


def jaccard_prefix(v: Column, least: float) -> Column:
    return F.slice(v, 1, F.size(v) - F.ceil(F.size(v) * least - 1e-9).cast("int") + 1)


def by_key(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(keys, starts, rows, values) of sparse rows (row, key, value), in the order of the keys: made once for all that
    they are multiplied with."""
    row, key, value = rows
    order = np.argsort(key, kind="stable")
    keys, counts = np.unique(key, return_counts=True)
    return keys, np.append(0, np.cumsum(counts)), row[order], value[order]


#: A block's sparse rows as by_key() has them; values that are all 1 are left out.
PACKED = "struct<keys:binary,counts:binary,rows:binary,values:binary>"


def packed_rows(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, bytes]:
    """PACKED of sparse rows (row, key, value) of at most 65,536 rows."""
    keys, starts, row, values = by_key(rows)
    values = b"" if (values == 1).all() else values.tobytes()
    return {"keys": keys.tobytes(), "counts": np.diff(starts).astype(np.int32).tobytes(), "rows": row.astype(np.uint16).tobytes(), "values": values}


def unpacked_rows(b: dict[str, bytes]) -> tuple[np.ndarray, ...]:
    starts, row = np.append(0, np.cumsum(np.frombuffer(b["counts"], np.int32))), np.frombuffer(b["rows"], np.uint16)
    values = np.frombuffer(b["values"]) if b["values"] else np.broadcast_to(1.0, len(row))
    return np.frombuffer(b["keys"], np.int64), starts, row, values


def in_blocks(rows: DataFrame, size: int, tiles: int, packed: Callable[[pa.Table], dict], columns: str) -> DataFrame:
    """(tile, columns ...): rows of up to `size` rows each, as packed() makes one, where they are, in turn for one tile after another."""

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = None, TaskContext.get().partitionId()
        row = lambda block: pa.RecordBatch.from_pylist([{"tile": tile % tiles} | packed(block.combine_chunks())], schema)
        for b in it:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows >= size:
                yield row(held.slice(0, size))
                held, tile = held.slice(size), tile + 1
        if held is not None and held.num_rows:
            yield row(held)

    schema = to_arrow_schema(StructType.fromDDL(f"tile int, {columns}"))
    return rows.mapInArrow(tasks, f"tile int, {columns}")


def met_blocks(blocks: DataFrame, tiles: int, block: Callable[[dict], object], found: Callable[[object, object], pa.RecordBatch], columns: str) -> DataFrame:
    """What found() makes of all pairs of blocks (tile, ...), each with itself too; block() reads one."""
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    sent = blocks.withColumn("other", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [[], []]
        for b in batches:
            for row in b.to_pylist():
                at[row["tile"] != key[0].as_py()].append(block(row))
        same = key[0] == key[1]
        for k, one in enumerate(at[0]):
            for two in at[0][k:] if same else at[1]:
                yield found(one, two)

    return sent.groupBy("i", "j").applyInArrow(meet, columns)


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def products(left: tuple, right: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Inner products of sparse rows of by_key(), frequent keys as matrices and the others one by one."""
    out = np.zeros(shape)
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    starts, others = left[1][i], right[1][j]
    n_left, n_right = left[1][i + 1] - starts, right[1][j + 1] - others
    both = n_left * n_right
    dense = np.flatnonzero(both >= DENSE_LEAST)
    dense = dense[np.argsort(-both[dense], kind="stable")[:DENSE_TERMS]]
    if len(dense):
        x, y = np.zeros((shape[0], len(dense))), np.zeros((shape[1], len(dense)))
        for m, rows, values, start, many in ((x, *left[2:], starts[dense], n_left[dense]), (y, *right[2:], others[dense], n_right[dense])):
            own = _ranges(start, many)
            m[rows[own], np.repeat(np.arange(len(dense)), many)] = values[own]
        out += x @ y.T
    rest = np.ones(len(both), bool)
    rest[dense] = False
    starts, others, n_left, n_right = starts[rest], others[rest], n_left[rest], n_right[rest]
    entry, key = _ranges(others, n_right), np.repeat(np.arange(len(n_right)), n_right)
    ends, at = np.cumsum(n_left[key]), 0
    while at < len(entry):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, side="right")))
        times = n_left[key[at:stop]]
        one, other = _ranges(starts[key[at:stop]], times), np.repeat(entry[at:stop], times)
        out += np.bincount(left[2][one].astype(np.int64) * shape[1] + right[2][other], left[3][one] * right[3][other], out.size).reshape(shape)
        at = stop
    return out


def _sparse(rows: pa.Table, name: str) -> tuple:
    lists = rows.column(name).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), flat.field("h").to_numpy(), flat.field("w").to_numpy()


def _cosines(left: pa.Table, right: pa.Table, dense: bool) -> np.ndarray:
    if not dense:
        return products(by_key(_sparse(left, "v")), by_key(_sparse(right, "v")), (left.num_rows, right.num_rows))
    x, y = (np.stack(t.column("d").to_numpy()) if t.num_rows else np.zeros((0, 0)) for t in (left, right))
    return x @ y.T


def _jaccards(left: pa.Table, right: pa.Table, name: str) -> np.ndarray:
    x, y = _sparse(left, name), _sparse(right, name)
    shared = products(by_key(x), by_key(y), (left.num_rows, right.num_rows))
    union = np.bincount(x[0], minlength=left.num_rows)[:, None] + np.bincount(y[0], minlength=right.num_rows)[None] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def rescaled(s: np.ndarray) -> np.ndarray:
    """A dense cosine up to 0.40 says nothing; above it counts as the square of its share of the rest."""
    return np.where(s <= 0.4, 0.0, ((s - 0.4) / 0.6) ** 2)


#: Weights of vectors, authors and tags; what makes an edge; bounds of the signals, which no edge stays below in all.
WEIGHTS, EDGE_LEAST = (0.75, 0.15, 0.10), 0.08
BOUNDS = (0.041, 0.10, 0.34)


def routed(docs: DataFrame, prefixes: list[Column], tiles: int) -> DataFrame:
    """(id, other): the other tiles that each row of docs (id, tile, ...) is sent to, its own included."""

    def keyed(n: int, prefix: Column) -> Column:
        return F.transform(prefix, lambda x: F.struct(F.xxhash64(F.lit(n), x["h"]).alias("key"), x["df"].alias("df")))

    items = F.flatten(F.array(*[keyed(n, p) for n, p in enumerate(prefixes)]))
    own = docs.select("id", "tile", items.alias("items")).withColumn("wide", F.exists("items", lambda x: x["df"] > HOT * tiles))
    rare = own.select("id", "tile", "wide", F.explode(F.filter("items", lambda x: x["df"] <= HOT * tiles)).alias("x")).select("id", "tile", "wide", "x.key")
    there = rare.select("key", F.col("tile").alias("other")).distinct()
    met = rare.filter("NOT wide").join(there, "key").select("id", "other")
    return met.union(own.filter("NOT wide").select("id", "tile")).union(own.filter("wide").select("id", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))).distinct()


class _Signals:
    def __init__(self, row: dict, columns: tuple[str, ...]):
        self.id = np.frombuffer(row["id"], np.int64)
        self.signals = [unpacked_rows(row[c]) for c in columns]
        self.sizes = [np.bincount(x[2], minlength=len(self.id)) for x in self.signals[1:]]


def packed_pairs(own: DataFrame, names: list[str], weights: tuple[float, ...], least: float, scale, size: int, tiles: int) -> DataFrame:
    """(a, b, weight) as signal_pairs() has it, of papers (id, v, names ...), all compared, packed in blocks of `size`."""
    columns = ("v", *names)
    packed = lambda rows: {"id": rows.column("id").to_numpy().tobytes()} | {c: packed_rows(_sparse(rows, c)) for c in columns}
    blocks = saved(in_blocks(own.select("id", *columns), size, tiles, packed, ", ".join(("id binary", *(f"{c} {PACKED}" for c in columns)))), "signal-blocks")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("weight", pa.float64())])

    def found(x: _Signals, y: _Signals) -> pa.RecordBatch:
        shape = len(x.id), len(y.id)
        s = products(x.signals[0], y.signals[0], shape)
        total = weights[0] * (s if scale is None else scale(s))
        for w, one, two, n, m in zip(weights[1:], x.signals[1:], y.signals[1:], x.sizes, y.sizes, strict=True):
            shared = products(one, two, shape)
            union = n[:, None] + m[None] - shared
            total += w * np.divide(shared, union, out=np.zeros(shape), where=union > 0)
        p, q = np.nonzero(total >= least)
        one, two = x.id[p], y.id[q]
        keep = one < two if x is y else one != two
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[keep]), pa.array(np.maximum(one, two)[keep]), pa.array(total[p, q][keep])], schema=schema)

    return met_blocks(blocks, tiles, lambda row: _Signals(row, columns), found, "a long, b long, weight double")


def signal_pairs(vectors: DataFrame, sets: list[DataFrame], weights: tuple[float, ...] = WEIGHTS, least: float = EDGE_LEAST, bounds: tuple[float, ...] | None = BOUNDS, dense: bool = False, scale=None, tile: int | None = None) -> DataFrame:
    """(a, b, weight) of ids a < b whose weighted signals sum to `least` or more: the cosine of their vectors, after
    `scale` if given, and the Jaccard of each of their sets.

    vectors: (id, v) of ordered_vectors(), or dense ones of norm 1; these are the papers that are compared. sets: (id, v)
    of ordered_sets(); a paper may have none. bounds: one for each signal, whose weighted sum is `least` at most; without
    them, and for dense vectors, every paper goes to every tile.
    """
    if bounds is not None and sum(w * b for w, b in zip(weights, bounds, strict=True)) > least + 1e-12:
        raise ValueError("the weighted bounds must not exceed the threshold")
    n = vectors.count()
    everywhere = dense or bounds is None
    tiles = sides(n, tile or SIDE_MOST) if everywhere else max(1, -(-n // (tile or TILE)))
    names = [f"s{i}" for i in range(len(sets))]
    own = vectors.select("id", F.col("v").alias("d" if dense else "v"))
    for name, one in zip(names, sets, strict=True):
        own = own.join(one.withColumnRenamed("v", name), "id", "left")
    own = own.withColumns({name: F.coalesce(name, F.array().cast(ENTRY)) for name in names} | {"tile": F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")})
    if everywhere or tiles == 1:
        sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    else:
        prefixes = [cosine_prefix(F.col("v"), bounds[0]), *(jaccard_prefix(F.col(name), b) for name, b in zip(names, bounds[1:], strict=True))]
        frequent = reduce(lambda x, y: x | y, (F.exists(p, lambda x: x["df"] > HOT * tiles) for p in prefixes))
        if own.agg(F.avg(frequent.cast("int"))).first()[0] > WIDE:
            return packed_pairs(own, names, weights, least, scale, tile or TILE, sides(n, PAPERS))
        sent = own.join(routed(own, prefixes, tiles), "id")
    sent = sent.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("weight", pa.float64())])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        at = rows.column("tile").to_numpy()
        whole, right = (rows.filter(pa.array(at == k.as_py())).combine_chunks() for k in key)
        del rows
        if not whole.num_rows or not right.num_rows:
            return
        for lo in range(0, whole.num_rows, step := max(1, CELLS // right.num_rows)):
            left = pa.Table.from_batches(whole.slice(lo, step).to_batches()).take(np.arange(min(step, whole.num_rows - lo)))
            s = _cosines(left, right, dense)
            total = weights[0] * (s if scale is None else scale(s))
            for w, name in zip(weights[1:], names, strict=True):
                total = total + w * _jaccards(left, right, name)
            p, q = np.nonzero(total >= least)
            one, two = left.column("id").to_numpy()[p], right.column("id").to_numpy()[q]
            keep = one < two if key[0] == key[1] else one != two
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[keep]), pa.array(np.maximum(one, two)[keep]), pa.array(total[p, q][keep])], schema=schema)

    return sent.groupBy("i", "j").applyInArrow(meet, "a long, b long, weight double")
