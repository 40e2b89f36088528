"""Graphs of papers and authors: edges (src, dst, type, weight, confidence) and nodes (id, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.functions.text import sentences as split
from scriptorium.functions.text import token_array
from scriptorium.operators.signals import in_blocks, met_blocks
from scriptorium.operators.vectors import sides
from scriptorium.storage import discard, saved

#: What a type of edge says.
VERBS = {"RELATED": "is related", "EXTENDS": "extends", "SUPPORTS": "supports", "CONTRADICTS": "contradicts", "METHODOLOGY": "shares methods"}
DIRECTED = ("EXTENDS", "SUPPORTS", "CONTRADICTS")


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """(a, b, columns ...): each edge from either end."""
    end = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e"), *columns).select("e.a", "e.b", *columns)


#: Links that a task packs at once.
PACKED = 1 << 18
PLACED = "x int, y int, two boolean, at binary, to binary, w binary"


def packed_weights(w: np.ndarray) -> bytes:
    """Weights as whole millionths where that is exact, else as they are."""
    whole = np.rint(w * 1e6)
    exact = len(w) and (np.abs(whole) < 2**31).all() and (whole / 1e6 == w).all()
    return b"m" + whole.astype(np.int32).tobytes() if exact else b"d" + w.tobytes()


def unpacked_weights(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32, offset=1) / 1e6 if b[:1] == b"m" else np.frombuffer(b, np.float64, offset=1)


def packed_ids(ids: np.ndarray) -> bytes:
    """Bytes of equal place lie together, so that the shuffle's compression leaves little of the high ones."""
    return np.ascontiguousarray(ids, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_ids(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def packed_rising(ids: np.ndarray) -> bytes:
    """Sorted ids by their differences, likewise, without the high bytes that none has."""
    planes = np.diff(ids, prepend=0).astype(np.int64).view(np.uint8).reshape(-1, 8)
    width = int(np.flatnonzero(planes.any(axis=0)).max(initial=0)) + 1
    return bytes([width]) + planes[:, :width].T.tobytes()


def unpacked_rising(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return np.cumsum(out.view(np.int64).ravel())


def packed_neighbours(edges: DataFrame) -> DataFrame:
    """(a, many, n): of each node that an edge ends at its different neighbours, packed. No row holds a list of them."""
    schema = pa.schema([("a", pa.int64()), ("many", pa.int64()), ("n", pa.binary())])

    def packed(a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        own = [packed_rising(b[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(a[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array(own, pa.binary())], schema=schema)

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for rows in it:
            a, b = (np.append(x, rows.column(i).to_numpy()) for i, x in enumerate((a, b)))
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            a, b = a[new], b[new]
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
            if len(cuts) > 1:  # the last node may go on
                yield packed(a, b, cuts)
                a, b = a[cuts[-1] :], b[cuts[-1] :]
        if len(a):
            yield packed(a, b, np.array([0, len(a)]))

    ends = both_ways(edges).filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return ends.repartition("a").sortWithinPartitions("a", "b").mapInArrow(tasks, "a long, many long, n binary")


def packed_links(links: DataFrame) -> DataFrame:
    """(x, y, two, src, dst, w): links (x, y, two, src, dst, w) of the same tiles packed in one row, without a shuffle."""
    schema = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("two", pa.bool_()), ("src", pa.binary()), ("dst", pa.binary()), ("w", pa.binary())])

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        x, y, two, src, dst, w = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(6))
        order = np.lexsort((dst, src, two, y, x))
        x, y, two, src, dst, w = (c[order] for c in (x, y, two, src, dst, w))
        cuts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (two[1:] != two[:-1]), True])
        own = [slice(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        first = cuts[:-1]
        return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.array(two[first]), *[pa.array([put(c[o]) for o in own], pa.binary()) for put, c in ((packed_ids, src), (packed_ids, dst), (packed_weights, w))]], schema=schema)

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in it:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PACKED:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    return links.mapInArrow(tasks, "x int, y int, two boolean, src binary, dst binary, w binary")


def placed_links(packed: DataFrame, members: DataFrame, tiles: int) -> DataFrame:
    """(x, y, two, at, to, w): for each pair of tiles its links, ends as places in the tiles' sorted ids (tile, ids).

    The place after the last one stands for an end that is no node.
    """
    none, every = F.lit(None), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    known = members.select("tile", "ids", every.alias("other"))
    rows = packed.select("x", "y", F.lit(0).alias("role"), "two", "src", "dst", "w", none.cast("array<long>").alias("ids"))
    for role, x, y in ((1, "tile", "other"), (2, "other", "tile")):
        rows = rows.union(known.select(x, y, F.lit(role), none.cast("boolean"), *[none.cast("binary")] * 3, "ids"))
    schema = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("two", pa.bool_()), ("at", pa.binary()), ("to", pa.binary()), ("w", pa.binary())])

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        role = rows.column("role").to_numpy()
        links, *ends = (rows.filter(pa.array(role == r)) for r in range(3))
        ids = [t.column("ids").combine_chunks().flatten().to_numpy() for t in ends]
        out = []
        for two in (False, True):
            own = links.filter(links.column("two") if two else pa.compute.invert(links.column("two"))).to_pylist()
            if own:
                at, to = (np.concatenate([unpacked_ids(r[c]) for r in own]) for c in ("src", "dst"))
                places = []
                for end, known in ((at, ids[0]), (to, ids[1])):
                    spot = np.searchsorted(known, end)
                    found = np.append(known, 0)[spot] == end
                    found &= spot < len(known)
                    places.append(np.where(found, spot, len(known)).astype(np.min_scalar_type(len(known))).tobytes())
                out.append((key[0].as_py(), key[1].as_py(), two, *places, packed_weights(np.concatenate([unpacked_weights(r["w"]) for r in own]))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    return rows.groupBy("x", "y").applyInArrow(place, PLACED)


def moved(blocks: DataFrame, state: DataFrame, tiles: int, totals: bool = False) -> DataFrame:
    """(tile, sums): what the links of blocks hand on from the nodes' values (tile, v) to the nodes of each tile, a row a
    task and tile. With totals, the weights that lead out of each node instead."""
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    first = state.select(F.col("tile").alias("x"), every.alias("y"), F.col("v").alias("vx"))
    second = state.select(every.alias("x"), F.col("tile").alias("y"), F.col("v").alias("vy"))
    met = blocks.join(first.hint("shuffle_hash"), ["x", "y"], "left").join(second.hint("shuffle_hash"), ["x", "y"], "left")

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in it:
            for r in range(b.num_rows):
                x, y, two, at, to, w, vx, vy = (b.column(i)[r].as_py() for i in range(8))
                one, other = np.frombuffer(vx or b""), np.frombuffer(vy or b"")
                at, to = np.frombuffer(at, np.min_scalar_type(len(one))), np.frombuffer(to, np.min_scalar_type(len(other)))
                w = unpacked_weights(w)
                ways = [(x, at, len(one), None), (y, to, len(other), None)] if totals else [(y, to, len(other), (one, at)), (x, at, len(one), (other, to))]
                for tile, place, n, source in ways[: 1 + two]:
                    value = w if source is None else w * np.append(source[0], 0.0)[source[1]]
                    sums[tile] = sums.get(tile, 0) + np.bincount(place, value, n + 1)[:n]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["tile", "sums"])

    return met.select("x", "y", "two", "at", "to", "w", "vx", "vy").mapInArrow(tasks, "tile int, sums binary")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """(id, rank), the largest being 1. Undirected types count both ways, weights split a node's rank, self loops do
    not count, and the rank of nodes without out-edges is spread evenly. Ids are whole numbers.

    Nodes lie in tiles and links in blocks, one for each pair of tiles, a few bytes a link. A link is shuffled when it is
    packed and when its block is kept; a round then shuffles only the nodes' ranks, once for each tile, and sums of
    tasks by tile. Each round's ranks are written.
    """
    id_type = nodes.schema["id"].dataType
    ids = saved(nodes.select(F.col("id").cast("long").alias("id")).distinct(), "pagerank-nodes")
    n = ids.count()
    if not n:
        return nodes.select("id").distinct().withColumn("rank", F.lit(0.0))
    tiles = sides(n)
    tile = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(tiles)).cast("int")
    members = saved(ids.filter("id IS NOT NULL").groupBy(tile("id").alias("tile")).agg(F.array_sort(F.collect_list("id")).alias("ids")), "pagerank-tiles")
    two = F.coalesce(~F.col("type").isin(*DIRECTED), F.lit(False))
    links = edges.filter("src <> dst AND weight IS NOT NULL").select(tile("src").alias("x"), tile("dst").alias("y"), two.alias("two"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("w"))
    blocks = placed_links(packed_links(links), members, tiles).repartition("x", "y").persist()

    def settled(rows: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """(tile, rank, v, lost) from the tiles' totals (tile, total) and sums (tile, sums): the nodes' ranks, what they
        hand on for a link of weight 1, and the rank of nodes without links."""

        def settle(rows: pa.Table) -> pa.Table:
            total = np.frombuffer(next(x for x in rows.column("total").to_pylist() if x is not None))
            rank = one(total, np.sum([np.frombuffer(x) for x in rows.column("sums").to_pylist() if x is not None] or [np.zeros(len(total))], axis=0))
            v = np.divide(rank, total, out=np.zeros(len(total)), where=total != 0)
            return pa.table({"tile": rows.column("tile")[:1], "rank": [rank.tobytes()], "v": [v.tobytes()], "lost": [float(rank[total == 0].sum())], "top": [float(rank.max())]})

        return saved(rows.groupBy("tile").applyInArrow(settle, "tile int, rank binary, v binary, lost double, top double"), "pagerank")

    zero = members.select("tile", F.to_binary(F.repeat(F.lit("00"), 8 * F.size("ids")), F.lit("hex")).alias("total"))
    own = zero.select("tile", "total", F.lit(None).cast("binary").alias("sums"))
    with_sums = lambda of, sums: of.union(sums.select("tile", F.lit(None).cast("binary"), "sums"))
    out = settled(with_sums(own, moved(blocks, zero.withColumnRenamed("total", "v"), tiles, totals=True)), lambda total, sums: sums)
    own = out.select("tile", F.col("rank").alias("total"), F.lit(None).cast("binary").alias("sums"))
    state = settled(own, lambda total, sums: np.full(len(total), 1.0 / n))
    for _ in range(iterations):
        lost = state.agg(F.sum("lost")).first()[0]  # one number
        base = (1 - damping + damping * lost) / n
        new = settled(with_sums(own, moved(blocks, state, tiles)), lambda total, sums, base=base: base + damping * sums)
        discard(state)
        state = new
    blocks.unpersist()
    top = state.agg(F.max("top")).first()[0]  # one number

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0)[r].values.cast(pa.int64()), pa.array(np.frombuffer(b.column(1)[r].as_py()) / top)], names=["id", "rank"])

    found = members.join(state.select("tile", "rank").hint("shuffle_hash"), "tile").select("ids", "rank")
    return found.mapInArrow(rows, "id long, rank double").withColumn("id", F.col("id").cast(id_type))


def merged_edges(similar: DataFrame, explicit: DataFrame) -> DataFrame:
    """Similarity edges and explicit ones; an explicit edge replaces the similarity edge of its pair."""
    pair = lambda df: df.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    kept = similar.join(pair(explicit), (F.least("src", "dst") == F.col("lo")) & (F.greatest("src", "dst") == F.col("hi")), "left_anti")
    return kept.select("src", "dst", "type", "weight").unionByName(explicit.select("src", "dst", "type", F.greatest(F.lit(0.1), F.col("confidence")).alias("weight")))


def degree(edges: DataFrame, weight: str = "weight") -> DataFrame:
    return both_ways(edges, weight).groupBy(F.col("a").alias("id")).agg(F.sum(weight).alias("degree"), F.count("*").alias("links"))


def incident_confidence(edges: DataFrame) -> DataFrame:
    mean = F.avg("confidence")
    return both_ways(edges, "confidence").groupBy(F.col("a").alias("id")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("confidence"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    kinds = ("RELATED", "EXTENDS", "SUPPORTS", "CONTRADICTS", "METHODOLOGY")
    return both_ways(edges, "type").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("connections"), *[F.count_if(F.col("type") == k).alias(k.lower()) for k in kinds])


def importance(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """(id, importance): .35 citations, .25 rank, .20 degree, .10 activity, .10 mean confidence; each in 0..1."""
    related, sure = F.sum(F.when(F.col("type") == "RELATED", F.col("weight"))), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("confidence")))
    around = both_ways(edges, "type", "weight", "confidence").groupBy(F.col("a").alias("id")).agg(related.alias("degree"), sure.alias("confidence"))
    rows = nodes.select("id", "citations").join(ranks, "id", "left").join(around, "id", "left")
    rows = rows.join(activity, "id", "left") if activity is not None else rows.withColumn("activity", F.lit(0.0))
    tops = F.broadcast(rows.agg(F.max("citations").alias("most"), F.max("degree").alias("widest")))  # one row
    part = lambda x, top: F.when(top > 0, F.coalesce(x, F.lit(0)) / top).otherwise(0.0)
    total = 0.35 * part(F.col("citations"), F.col("most")) + 0.25 * F.coalesce("rank", F.lit(0.0)) + 0.20 * F.coalesce(part(F.col("degree"), F.col("widest")), F.lit(0.0)) + 0.10 * F.coalesce("activity", F.lit(0.0)) + 0.10 * F.coalesce("confidence", F.lit(0.0))
    return rows.crossJoin(tops).select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("importance"))


def percentile(scores: DataFrame, column: str) -> DataFrame:
    """rank and whole-number percentile over all rows. The rank counts greater values, by value, not by row."""
    counts = scores.groupBy(column).agg(F.count("*").alias("c"))
    greater = F.coalesce(F.sum("c").over(Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("c").over(Window.partitionBy(F.lit(0)))
    places = counts.select(column, (greater + 1).alias("rank"), n.alias("n"))
    return scores.join(places, column).withColumn("percentile", F.round(100.0 * (F.col("n") - F.col("rank") + 1) / F.col("n")).cast("long")).drop("n")


#: Nodes in a block, whose nodes reached are bits of one table.
BLOCK = 1024
#: Neighbours of a block unpacked at once, and bytes of packed neighbours in a tile of blocks.
STRIP, TILE_BYTES = 1 << 18, 1 << 27


class _Near:
    def __init__(self, row: dict):
        self.id, self.centre = np.frombuffer(row["id"], np.int64), np.frombuffer(row["centre"], bool)
        self.counts, self.sizes, self.packed = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["sizes"], np.int64), row["near"]

    def strips(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, row, neighbour) by row, of as many rows as have about STRIP neighbours."""
        strip, end = np.cumsum(self.counts) // STRIP, np.cumsum(self.sizes)
        cuts = np.flatnonzero(np.append(True, strip[1:] != strip[:-1])).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(strip)], strict=True):
            near = [unpacked_rising(self.packed[end[i] - self.sizes[i] : end[i]]) for i in range(lo, hi)]
            yield slice(lo, hi), np.repeat(np.arange(lo, hi), self.counts[lo:hi]), np.concatenate(near)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours, and for each of them, and for one that is none, the rows that have it, as bits."""
        known = np.empty(0, np.int64)
        for _, _, near in self.strips():
            known = np.union1d(known, near)
        bits = np.zeros((len(known) + 1, -(-len(self.id) // 64) * 64 // 8), np.uint8)
        for _, row, near in self.strips():
            np.bitwise_or.at(bits, (np.searchsorted(known, near), row // 8), (128 >> row % 8).astype(np.uint8))
        return known, bits.view(np.uint64)


def two_hops(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """ego() for two hops: a node is reached from those that it is linked to or has a neighbour in common with.

    Nodes are packed with their neighbours in blocks that meet in up to 8 tiles, or more where a tile would hold over
    TILE_BYTES; a node there is a bit. No path and no pair is shuffled: pairs leave the task that finds them.
    """
    ends = packed_neighbours(edges).withColumnRenamed("a", "id")
    known = saved(ends.join(centres.select("id", F.lit(True).alias("centre")).distinct(), "id", "left"), "neighbours")
    count, size = known.agg(F.count("*"), F.sum(F.length("n"))).first()
    tiles = max(sides(count), -(-(size or 0) // TILE_BYTES))

    def packed(rows: pa.Table) -> dict:
        lists, centre = rows.column("n").combine_chunks(), rows.column("centre").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        sizes = pa.compute.binary_length(lists).to_numpy().astype(np.int64)
        return {"id": rows.column("id").to_numpy().tobytes(), "centre": centre.tobytes(), "counts": rows.column("many").to_numpy().tobytes(), "sizes": sizes.tobytes(), "near": b"".join(lists.to_pylist())}

    last = []

    def found(one: _Near, two: _Near) -> pa.RecordBatch:
        if not last or last[0] is not one:
            last[:] = [one, *one.table()]
        near, bits = last[1:]
        reached = np.zeros((len(two.id), len(one.id)), bool)
        order = np.argsort(one.id)
        for rows, row, other in two.strips():
            at = np.minimum(np.searchsorted(near, other), len(near) - 1)
            at[near[at] != other] = len(near)
            counts = two.counts[rows]
            own = np.bitwise_or.reduceat(bits[at], np.cumsum(counts) - counts, axis=0)  # every node here has a neighbour
            reached[rows] = np.unpackbits(own.view(np.uint8), axis=1, count=len(one.id))
            place = np.minimum(np.searchsorted(one.id[order], other), len(order) - 1)
            linked = one.id[order[place]] == other
            reached[row[linked], order[place[linked]]] = True
        q, p = np.nonzero(reached)
        a, b, ways = one.id[p], two.id[q], [one.centre[p] & (one.id[p] != two.id[q])]
        if one is not two:
            a, b, ways = np.append(a, b), np.append(b, a), [*ways, two.centre[q]]
        keep = np.concatenate(ways)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["centre", "id"])

    blocks = saved(in_blocks(known.select("id", "centre", "many", "n"), BLOCK, tiles, packed, "id binary, centre binary, counts binary, sizes binary, near binary"), "node-blocks")
    own = centres.filter("id IS NOT NULL").select(F.col("id").alias("centre"), "id").distinct()
    return own.union(met_blocks(blocks, tiles, _Near, found, "centre long, id long"))


def ego(edges: DataFrame, centres: DataFrame, hops: int = 2) -> DataFrame:
    """(centre, id): all nodes within the hops of each centre, itself included. Ids are whole numbers."""
    if hops == 2:
        return two_hops(edges, centres)
    step = both_ways(edges).distinct()
    reached = centres.select(F.col("id").alias("centre"), "id")
    for _ in range(hops):
        further = reached.join(step, F.col("id") == F.col("a")).select("centre", F.col("b").alias("id"))
        reached = reached.union(further).distinct()
    return reached


#: Neighbours in a tile of nodes, and of those compared at once; bits of a table of neighbours that is made at once.
TILE_LINKS, STRIP_LINKS, TABLE_BITS = 1 << 23, 1 << 20, 1 << 26


def shared_counts(left: tuple, right: tuple, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For rows p of left and q of right the number of values that both have; left and right are (row, value), distinct.

    Rows that are dense enough are compared as bits, others by searching the shorter one's values in the longer one.
    """
    values, at = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    (lr, lv), (rr, rv) = (left[0], at[: len(left[1])]), (right[0], at[len(left[1]) :])
    n, m = (int(r.max(initial=-1)) + 1 for r in (lr, rr))
    sizes, others = np.bincount(lr, minlength=n), np.bincount(rr, minlength=m)
    out = np.zeros(len(p), np.int64)
    if len(values) / 64 < 100 * np.minimum(sizes[p], others[q]).mean():
        width = max(1, TABLE_BITS // (8 * 64 * (n + m))) * 64
        for lo in range(0, len(values), width):
            bits = []
            for r, v, rows in ((lr, lv, n), (rr, rv, m)):
                own = (v >= lo) & (v < lo + width)
                table = np.zeros((rows, width), bool)
                table[r[own], v[own] - lo] = True
                bits.append(np.packbits(table, axis=1).view(np.uint64))
            for i in range(0, len(p), step := max(1, (1 << 22) // bits[0].shape[1])):
                out[i : i + step] += np.bitwise_count(bits[0][p[i : i + step]] & bits[1][q[i : i + step]]).sum(axis=1, dtype=np.int64)
        return out
    u = len(values)
    keys = [np.sort(r * u + v) for r, v in ((lr, lv), (rr, rv))]
    swap = sizes[p] > others[q]
    for one, two, chosen, a, b, count in ((keys[0], keys[1], ~swap, p, q, sizes), (keys[1], keys[0], swap, q, p, others)):
        start, pairs = np.cumsum(count) - count, np.flatnonzero(chosen & (count[a] > 0))
        upto, lo = np.cumsum(count[a[pairs]]), 0
        while lo < len(pairs):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 21), side="right")))
            own = pairs[lo:hi]
            many = count[a[own]]
            wanted = one[np.repeat(start[a[own]] - np.cumsum(many) + many, many) + np.arange(many.sum())] % u + np.repeat(b[own], many) * u
            place = np.minimum(np.searchsorted(two, wanted), max(0, len(two) - 1))
            out[own] = np.bincount(np.repeat(np.arange(len(own)), many)[two[place] == wanted], minlength=len(own)) if len(two) else 0
            lo = hi
    return out


def common_neighbours(edges: DataFrame, tile_links: int = TILE_LINKS, strip_links: int = STRIP_LINKS) -> DataFrame:
    """(src, dst, common) for the edges of the graph: neighbours that both ends have through other than RELATED edges.

    Nodes lie in tiles of about `tile_links` neighbours, each node's packed as one row; edges go, packed too, where their
    ends' tiles meet. There nodes with about `strip_links` neighbours of either tile are unpacked at once. Nothing is
    shuffled for a neighbour of an edge, but each node's row once for each tile. Ids are whole numbers.
    """
    edges = saved(edges.select("src", "dst", (F.col("type") != "RELATED").alias("near")), "edges")
    near = saved(packed_neighbours(edges.filter("near")), "neighbours")
    tiles = max(1, -(-(near.agg(F.sum("many")).first()[0] or 0) // tile_links))
    tile = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(tiles)).cast("int")
    none = F.lit(None).cast("binary")
    own = near.withColumn("tile", tile("a")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    nodes = own.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "a", "many", "n", none.alias("src"), none.alias("dst"))
    ends = edges.filter("src IS NOT NULL AND dst IS NOT NULL").withColumns({"i": F.least(tile("src"), tile("dst")), "j": F.greatest(tile("src"), tile("dst"))})
    links = packed_links(ends.select("i", "j", F.lit(False).alias("two"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(0.0).alias("w")))
    links = links.select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("many"), none.alias("n"), "src", "dst")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("common", pa.int64())])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, many, asked = {}, {}, []
        for b in batches:
            for a, size, n, src, dst in zip(*(b.column(c).to_pylist() for c in ("a", "many", "n", "src", "dst")), strict=True):
                if src is None:
                    lists[a], many[a] = n, size
                else:
                    asked.append(np.stack([unpacked_ids(src), unpacked_ids(dst)], axis=1))
        if not asked or not lists:
            return
        ids = np.sort(np.fromiter(lists, np.int64, len(lists)))
        ends = np.concatenate(asked)
        del asked
        places = np.minimum(np.searchsorted(ids, ends), len(ids) - 1).astype(np.int32)
        places = places[(ids[places] == ends).all(axis=1)]
        del ends
        strip = np.cumsum([many[v] for v in ids.tolist()]) // strip_links
        places = places[np.lexsort((places[:, 1], places[:, 0], strip[places[:, 1]], strip[places[:, 0]]))]
        places = places[np.append(True, (places[1:] != places[:-1]).any(axis=1))[: len(places)]]
        met = strip[places]
        cuts = np.flatnonzero(np.append(True, (met[1:] != met[:-1]).any(axis=1))[: len(met)]).tolist()
        del met
        for lo, hi in zip(cuts, [*cuts[1:], len(places)], strict=True):
            sides, parts = [np.unique(x, return_inverse=True) for x in places[lo:hi].T], []
            for used, _ in sides:
                rows = [unpacked_rising(lists[v]) for v in ids[used].tolist()]
                parts.append((np.repeat(np.arange(len(used), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)))
            common = shared_counts(*parts, sides[0][1], sides[1][1])
            pairs, some = ids[places[lo:hi]], common > 0
            yield pa.RecordBatch.from_arrays([pa.array(pairs[some, 0]), pa.array(pairs[some, 1]), pa.array(common[some])], schema=schema)

    return nodes.union(links).groupBy("i", "j").applyInArrow(meet, "src long, dst long, common long")


def reading_path(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, kind, place, other): must-read first, predecessors, successors, newer works and contradictions of each node.

    An incoming directed edge leads to the must-read of largest importance; ties go by the larger edge confidence.
    """
    facts = nodes.select(F.col("id").alias("other"), "year").join(scores.select(F.col("id").alias("other"), "importance"), "other")
    own = nodes.select("id", F.col("year").alias("own_year"))
    incoming = edges.filter(F.col("type").isin(*DIRECTED)).select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", "confidence")
    outgoing = edges.filter(F.col("type").isin(*DIRECTED)).select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", "confidence")
    around = both_ways(edges, "type", "confidence").select(F.col("a").alias("id"), F.col("b").alias("other"), "type", "confidence")

    def top(rows: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
        ranked = rows.join(facts, "other").join(own, "id").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order, "other")))
        return ranked.filter(F.col("place") <= n).select("id", F.lit(kind).alias("kind"), "place", "other")

    by_importance = F.desc(F.round("importance", 6))
    newer = around.join(facts.select("other", F.col("year").alias("y")), "other").join(own.withColumnRenamed("own_year", "o"), "id").filter("y > o").drop("y", "o")
    parts = (
        top(incoming, "MUST_READ", [by_importance, F.desc("confidence")], 1),
        top(incoming, "PREDECESSOR", [F.desc("year")], 3),
        top(outgoing, "SUCCESSOR", [by_importance], 3),
        top(newer, "NEWER", [F.desc("year")], 2),
        top(around.filter(F.col("type") == "CONTRADICTS"), "CONTRADICTION", [by_importance], 2),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similar_by_graph(edges: DataFrame, k: int = 5) -> DataFrame:
    near = both_ways(edges.filter(F.col("type").isin("RELATED", "METHODOLOGY")), "confidence")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "b"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select(F.col("a").alias("id"), F.col("b").alias("other"), "place")


def roles(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, role): foundational, latest, methodological, significant or plain, in that order of precedence."""
    out_ext = edges.filter(F.col("type") == "EXTENDS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("extended_by"))
    in_ext = edges.filter(F.col("type") == "EXTENDS").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("extending"))
    method = both_ways(edges.filter(F.col("type") == "METHODOLOGY")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("methods"))
    r = nodes.select("id", "year").join(scores, "id").join(out_ext, "id", "left").join(in_ext, "id", "left").join(method, "id", "left").fillna(0, ["extended_by", "extending", "methods"])
    role = (
        F.when((F.col("importance") > 0.7) & (F.col("extending") == 0) & (F.col("extended_by") > 0), "FOUNDATIONAL")
        .when((F.col("year") > 0) & (F.col("extended_by") == 0) & (F.col("extending") > 0), "LATEST")
        .when(F.col("methods") > 1, "METHODOLOGICAL")
        .when(F.col("importance") > 0.5, "SIGNIFICANT")
        .otherwise("PLAIN")
    )
    return r.select("id", role.alias("role"))


#: Nodes of the forests of a task, which begins new ones beyond.
FOREST_NODES = 1 << 18


class _Forest:
    """Edges that join parts of a graph, as they come. Most others are told by the parts as they were a while ago."""

    def __init__(self):
        self.parent, self.ids, self.parts, self.late = {}, np.empty(0, np.int64), np.empty(0, np.int64), 0

    def root(self, v: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    def add(self, a: np.ndarray, b: np.ndarray, known: set) -> np.ndarray:
        """Which of the edges join parts, leaving out those in `known`."""
        keep, maybe = np.zeros(len(a), bool), np.ones(len(a), bool)
        if len(self.ids):
            at, to = (np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1) for x in (a, b))
            maybe = (self.ids[at] != a) | (self.ids[to] != b) | (self.parts[at] != self.parts[to])
        for k in np.flatnonzero(maybe).tolist():
            v, w = int(a[k]), int(b[k])
            if (min(v, w), max(v, w)) not in known:
                keep[k] = v == w and v not in self.parent
                x, y = self.root(v), self.root(w)
                if x != y:
                    self.parent[x], keep[k] = y, True
        self.late += int(maybe.sum())
        if self.late > len(self.parent) // 4 + 4096:
            ids = np.sort(np.fromiter(self.parent, np.int64, len(self.parent)))
            self.ids, self.parts, self.late = ids, np.array([self.root(v) for v in ids.tolist()], np.int64), 0
        return keep


def certificate(edges: DataFrame, forests: int) -> DataFrame:
    """(src, dst): edges with the same components as all and, with two forests, the same bridges; ids are whole numbers.

    Each task keeps a spanning forest of its edges and, with two, one of those that are left. Of the edges across any cut
    it so keeps all, or that many at least. What it keeps is in proportion to its nodes, whatever its edges.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, known = _Forest(), _Forest(), set()
        for b in it:
            whole = pa.compute.and_(b.column(0).is_valid(), b.column(1).is_valid())
            if b.num_rows and not pa.compute.all(whole).as_py():
                yield pa.RecordBatch.from_arrays(b.filter(pa.compute.invert(whole)).columns, schema=schema)
                b = b.filter(whole)
            src, dst = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            keep = one.add(src, dst, set())
            if forests > 1:
                known.update(zip(np.minimum(src, dst)[keep].tolist(), np.maximum(src, dst)[keep].tolist(), strict=True))
                rest = np.flatnonzero(~keep & (src != dst))
                keep[rest[two.add(src[rest], dst[rest], known)]] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep])], schema=schema)
            if len(one.parent) > FOREST_NODES:
                one, two, known = _Forest(), _Forest(), set()

    if any(f.dataType.simpleString() not in ("bigint", "int") for f in edges.select("src", "dst").schema):
        return edges.select("src", "dst")
    kinds = {c: edges.schema[c].dataType for c in ("src", "dst")}
    found = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).mapInArrow(tasks, "src long, dst long")
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, by spreading minima until nothing changes."""
    step = saved(both_ways(certificate(edges, 1)).distinct(), "component-edges")
    labels = saved(step.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "components")
    while True:
        heard = step.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(heard, F.col("id") == F.col("a")).select("id", F.least("component", "m").alias("component"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = saved(lower.join(hop, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "components")
        if not new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").take(1):
            return new
        labels = new


def bridge_edges_by_rank(betweenness: DataFrame) -> DataFrame:
    """Edges at or above the value in place max(1, m/10) of the descending list."""
    m = betweenness.count()
    if not m:
        return betweenness
    place = max(1, m // 10)
    limit = betweenness.orderBy(F.desc("betweenness")).limit(min(place + 1, m)).agg(F.min("betweenness").alias("limit"))
    return betweenness.crossJoin(F.broadcast(limit)).filter(F.col("betweenness") >= F.col("limit")).drop("limit")  # one row


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(both_ways(edges).select(F.col("a").alias("id")), "id", "left_anti")


def coauthor_edges(paper_authors: DataFrame) -> DataFrame:
    """(a, b, papers): rows of pairs of authors on a paper; repeated rows count. Papers have few authors each."""
    x = paper_authors.select("paper_id", F.col("author_id").alias("a"))
    y = paper_authors.select("paper_id", F.col("author_id").alias("b"))
    return x.join(y, "paper_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("papers"))


def communities(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, community) by synchronous weighted label propagation; ties go to the smaller label, a node's own label
    counts once, and the rounds end when no label changes or a former state returns."""
    step = saved(pairs.select("a", "b", "papers").union(pairs.select("b", "a", "papers")), "community-edges")
    labels = saved(step.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")), "communities")
    states = set()
    for _ in range(rounds):
        votes = step.join(labels, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "community", F.col("papers").cast("double").alias("w")).union(labels.select("id", "community", F.lit(1.0)))
        tally = votes.groupBy("id", "community").agg(F.sum("w").alias("w"))
        best = tally.groupBy("id").agg(F.max(F.struct("w", (-F.col("community")).alias("m")))["m"].alias("m")).select("id", (-F.col("m")).alias("community"))
        labels = saved(best, "communities")
        state = labels.agg(F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first()[0]
        if state in states:
            break
        states.add(state)
    return labels


def bridge_authors(pairs: DataFrame, community: DataFrame) -> DataFrame:
    """Authors whose co-authors lie in two communities or more."""
    step = pairs.select("a", "b").union(pairs.select("b", "a"))
    seen = step.join(community, F.col("b") == F.col("id")).groupBy(F.col("a").alias("author")).agg(F.countDistinct("community").alias("communities"))
    return seen.filter("communities >= 2")


def sentence_ranks(words: list[list[str]], rounds: int = 30, damping: float = 0.85, enough: float = 1e-4) -> np.ndarray:
    """The rank of each sentence by its words: PageRank over the cosines of the sentences' TF-IDF vectors.

    The matrix of cosines is kept as the incidence of sentences and words, so that memory grows with the text and not
    with the square of its sentences.
    """
    n, at = len(words), {}
    cells = [i * (1 << 32) + at.setdefault(w, len(at)) for i, own in enumerate(words) for w in own]
    cell, count = np.unique(np.array(cells, np.int64), return_counts=True)
    row, col = cell >> 32, cell & (1 << 32) - 1
    df = np.bincount(col, minlength=len(at))
    value = count * np.maximum(config.IDF_FLOOR, np.log(n / (1.0 + df)))[col]
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / norm[row]
    own = (norm > 0).astype(float)  # what a sentence has in common with itself, which doesn't count
    times = lambda x: np.bincount(row, value * np.bincount(col, value * x[row], len(at))[col], n) - own * x
    total = np.maximum(times(np.ones(n)), 0)
    total[total < 1e-12] = 0
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * times(np.divide(rank, total, out=np.zeros(n), where=total > 0))
        done = np.abs(new - rank).sum() < enough
        rank = new
        if done:
            break
    return rank


def textrank(docs: DataFrame, sentences: int = 3) -> DataFrame:
    """(id, summary): the best sentences of each text in their order, equal ranks by place; each text is ranked on its own."""
    rows = docs.select("id", split(F.col("text")).alias("s"))
    rows = rows.select("id", "s", F.when(F.size("s") > sentences, F.transform("s", token_array)).alias("w"))

    def one(parts, words) -> str:
        if words is None:
            return " ".join(parts)
        rank = sentence_ranks([list(w) for w in words])
        best = sorted(np.lexsort((np.arange(len(rank)), -np.round(rank, 9)))[:sentences])
        return " ".join(parts[i] for i in best)

    def batches(it):
        for b in it:
            yield pd.DataFrame({"id": b["id"], "summary": [one(s, w) for s, w in zip(b["s"], b["w"], strict=True)]})

    return rows.filter("s[0] IS NOT NULL").mapInPandas(batches, "id long, summary string")
