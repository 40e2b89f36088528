r"""Near-duplicate groups by one-permutation MinHash.

Each text becomes the set of its distinct shingles of `width` words (64-bit hashes of the exact words). One permutation
fills BINS bins with the smallest hash of each; empty bins copy a random filled one (optimal densification); ROWS bins
make a band. Texts with equal sets are one class from the start. Classes that share a band form a bucket; its most
connected class is the centre of a star, and only centre-member pairs are candidates. Every candidate is confirmed on
the two full sets, computed again from the texts.

Small sets have an exact way beside the bands, since many of their bins are copies: two sets that are linked share one
of the rarest shingles, if of n shingles the n - ceil(0.8 n) + 1 rarest are taken. Sets of up to REACH shingles, the
largest that a set of SMALL can be linked with, form buckets by these; sets over SMALL form bands.

A star can miss a link between two members whose common centre is like only one of them. Members that were not
confirmed against their centre are therefore compared with the members of their bucket in other groups, unless a bound
rules a link out: linked sets differ in size by a quarter at most, which is part of the join's key, and two sets of n
and m shingles are linked only if they differ in at most (n + m) / 9, and they differ in at least as many as their
parity bitmaps do. A large bucket is dealt over tasks in pieces of PIECE members. What remains is the chance that a
pair of larger sets shares no band: (1 - 0.8**ROWS)**BANDS = 1e-7 at a similarity of exactly 0.8 if bins were
independent, less above; copied bins are not, so the README has measured figures by size.

Defined cases: null and empty texts have the empty set and no links; a text of under `width` words has one shingle;
repeated rows are exact copies and give a row each; ids may be of any type that has an order; a group's component_id is
its smallest id, null only if no member has an id; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discard, saved, small_batches

#: Words of a shingle, and the most that a caller can ask for.
WIDTH, MOST_WIDTH = 4, 16
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Similarity as a fraction of whole numbers: PART * intersection >= NEED * union.
PART, NEED = 100, 80
#: Largest sets of the exact way alone, and the largest that they can be linked with.
SMALL = 64
REACH = SMALL * PART // NEED
#: Members of a bucket in a piece; ratio of sizes of two neighbouring cells (over PART / NEED); salts of a group.
PIECE, CELL, SALTS = 512, 1.26, 16
MEMO = 1 << 18
#: Bits of a parity bitmap.
PARITY = 1024
_random = np.random.default_rng(20_240_517)
STEPS = _random.integers(0, 2**63, MOST_WIDTH + ROWS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Which bin an empty bin copies, attempt by attempt.
DONORS = _random.integers(0, BINS, (64, BINS))


class WordHashes(dict):
    """Hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; ASCII letters count in lower case, ASCII white space separates."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    if n < width:
        return mixed((w * STEPS[:n]).sum(keepdims=True) + STEPS[-1:] * np.uint64(n))
    h = w[: n - width + 1] * STEPS[0]
    for i in range(1, width):
        h += w[i : n - width + 1 + i] * STEPS[i]
    return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value a bin: its smallest hash, or for an empty bin that of a random filled one."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = np.zeros(BINS, bool)
    out = np.zeros(BINS, np.uint64)
    at = bins[first].astype(np.int64)
    filled[at], out[at] = True, shingles[first]
    empty = np.flatnonzero(~filled)
    for donors in DONORS:
        if not len(empty):
            return out
        d = donors[empty]
        ok = filled[d]
        out[empty[ok]] = out[d[ok]]
        empty = empty[~ok]
    if len(empty):  # few shingles: the next filled bin
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS) * STEPS[MOST_WIDTH : MOST_WIDTH + ROWS]
    return mixed(rows.sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * STEPS[-2])


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles fall on it. Two bitmaps differ in no more bits than their sets in shingles."""
    odd = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, key, bands, bits, few): key names the shingle set and is null for the empty one; few is the set
    itself up to REACH shingles, bands are those of a set over SMALL."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in it:
            n, keys, bands, bits, few = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text or b"", words, width)
                n.append(len(s))
                keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_hashes(signature(s)).view(np.int64) if len(s) > SMALL else None)
                bits.append(parity(s) if len(s) else None)
                few.append(s.view(np.int64) if 0 < len(s) <= REACH else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *[pa.array(x, longs) for x in (bands, bits, few)]], names=["id", "n_shingles", "key", "bands", "bits", "few"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(batches, f"id {kind}, n_shingles long, key binary, bands array<long>, bits array<long>, few array<long>")


def rare_shingles(classes: DataFrame) -> DataFrame:
    """(band, key, n): the shingles by which a small set meets every set that it can be linked with, as buckets.

    In the order of rising frequency, a set's first n - ceil(0.8 n) + 1 shingles; those that no other set has lead
    nowhere and only count.
    """
    one = classes.filter("few IS NOT NULL").select("key", "n", F.explode("few").alias("gram"))
    shared = one.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1")
    own = one.join(shared, "gram").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))  # REACH at most
    prefix = F.col("n") - F.floor((F.col("n") * NEED + PART - 1) / PART) + 1
    wanted = prefix - (F.col("n") - F.size("g"))
    return own.filter(wanted > 0).select(F.explode(F.slice("g", F.lit(1), wanted.cast("int"))["gram"]).alias("band"), "key", "n")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(key, shingles) of the classes in wanted (key, id), computed from the text of the row with that id."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in it:
            sets = [shingle_set(t or b"", words, width) for t in b.column(1).to_pylist()]
            keep = [len(s) > 0 and xxhash.xxh128_digest(s.tobytes()) == k for s, k in zip(sets, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), pa.array([s.tobytes() for s, k in zip(sets, keep, strict=True) if k], pa.binary())], names=["key", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = texts.join(wanted.hint("shuffle_hash"), texts["id"].eqNullSafe(wanted["id"])).select("key", "text").mapInArrow(batches, "key binary, shingles binary")
    return found.groupBy("key").agg(F.first("shingles").alias("shingles"))  # ids may repeat


def small_sets(classes: DataFrame) -> DataFrame:
    """(key, shingles) of the classes whose sets came with their sketches."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(s, np.int64).tobytes() for s in b.column(1).to_pylist()], pa.binary())], names=["key", "shingles"])

    return classes.filter("few IS NOT NULL").select("key", "few").mapInArrow(batches, "key binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, total): sizes of the intersection and union for each pair (a, b) of keys."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            shared, total = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                shared.append(both)
                total.append(len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])

    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("t")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(batches, "a binary, b binary, shared long, total long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) by alternating large and small stars; root is the smallest node."""
    e = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "edges")
    mark = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == mark or not state[0]:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u"), F.col("u"))).distinct()
        mark = state
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u"), F.col("v")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        last, e = e, saved(small.filter("v <> u").distinct(), "edges")
        discard(last)


def size_allows(n, m):
    return F.least(n, m) * PART >= F.greatest(n, m) * NEED


def open_candidates(seen: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys within a band that no star settles, from (band, key, n, c, linked, root, bits).

    A member not linked with its centre meets all others of another group whose size allows a link. Sizes fall in cells
    so wide that linked sets lie in one or in neighbours; of a band's others, each piece is a key of its own.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col("c") / PIECE)).cast("int")
    placed = seen.withColumn("cell", F.floor(F.log(F.col("n").cast("double")) / math.log(CELL)).cast("int"))
    loose = placed.filter(~F.col("linked")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    loose = loose.withColumn("near", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).alias("x")
    others = placed.withColumn("piece", F.pmod(F.xxhash64("key"), pieces).cast("int")).alias("y")
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(PARITY // 64)), F.lit(0))
    # PART * (n + m - d) >= NEED * (n + m + d), where d counts the shingles in which the sets differ
    may_link = differ * (PART + NEED) <= (F.col("x.n") + F.col("y.n")) * (PART - NEED)
    once = F.col("y.linked") | (F.col("x.key") < F.col("y.key"))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.piece") == F.col("y.piece")) & (F.col("x.near") == F.col("y.cell"))
    return loose.join(others, same & (F.col("x.root") != F.col("y.root")) & once & size_allows(F.col("x.n"), F.col("y.n")) & may_link).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    prep = saved(sketches(docs, id_col, text_col, width), "sketches")
    classes = saved(prep.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("few").alias("few")), "classes")
    rare = saved(rare_shingles(classes), "rare")
    rows = classes.filter("bands IS NOT NULL").select(F.explode("bands").alias("band"), "key", F.col("n")).union(rare)
    several = rows.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    buckets = saved(rows.join(several, "band"), "buckets")
    discard(rare)
    popular = buckets.groupBy("key").agg(F.sum("c").alias("pop"))
    centres = buckets.join(popular, "key").groupBy("band").agg(F.max(F.struct("pop", "key", "n")).alias("centre")).select("band", "centre.*").select("band", F.col("key").alias("a"), F.col("n").alias("na"))
    centres = saved(centres, "centres")
    # a member that its centre's size rules out is as unconfirmed as one that fails the comparison
    stars = buckets.join(centres, "band").filter(F.col("key") != F.col("a")).select("a", "na", F.col("key").alias("b"), F.col("n").alias("nb"))
    first = saved(stars.filter(size_allows(F.col("na"), F.col("nb"))).select("a", "b").distinct(), "stars")
    wanted = buckets.filter(F.col("n") > REACH).select("key").distinct().join(classes.select("key", "id"), "key")
    sets = saved(full_sets(docs, wanted, id_col, text_col, width).union(small_sets(classes.join(buckets.select("key").distinct(), "key", "left_semi"))), "sets")
    checked = saved(confirmed(first, sets), "checked")
    discard(first)
    links = checked.filter(F.col("shared") * PART >= F.col("total") * NEED).select("a", "b")
    groups = saved(components(links), "groups")

    # members not confirmed against their centre, each the centre of its own star over other groups of the bucket
    linked = (F.col("key") == F.col("a")) | F.coalesce(F.col("shared") * PART >= F.col("total") * NEED, F.lit(False))
    seen = buckets.join(centres, "band").join(checked.withColumnRenamed("b", "key"), ["a", "key"], "left").select("band", "key", "n", "c", linked.alias("linked"))
    seen = seen.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed_bands = seen.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    seen = saved(seen.join(mixed_bands, "band", "left_semi").join(classes.select("key", "bits"), "key"), "seen")
    discard(buckets, centres, checked)
    open_pairs = saved(open_candidates(seen), "open")
    more = confirmed(open_pairs, sets).filter(F.col("shared") * PART >= F.col("total") * NEED)
    # groups are stars already, so only links between them are new
    final = saved(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b"))), "components")
    discard(seen, open_pairs, sets, groups)

    # a group may hold a third of all classes: its smallest id is handed out under several salts
    members = final.join(classes.select(F.col("key").alias("node"), "id"), "node").select("node", "root", "id")
    lowest = members.groupBy("root").agg(F.min("id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = final.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    by_class = salted.join(lowest, ["root", "salt"]).select(F.col("node").alias("key"), "component_id")
    named = classes.select("key", F.col("id").alias("own")).join(by_class, "key", "left").select("key", F.when(F.col("component_id").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    plain = prep.filter("key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = prep.filter("key IS NOT NULL").select("id", "n_shingles", "key").join(named, "key").select("id", "n_shingles", "component_id").unionByName(plain)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_neardup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * shared >= 80 * (len(a.grams) + len(b.grams) - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
