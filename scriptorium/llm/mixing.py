"""Mixing sources to target weights with a low-discrepancy schedule, in Spark expressions only.

Targets: sources share the words of all documents by weight; a target stops at MAX_REPEATS times the source's size and
the excess goes to the others by weight (one pass over the sources sorted by size / weight gives the fixed point).

Stream: a source's documents, in the order of a hash of id and text, form a stream of words. It is cut into equal blocks
(of about BLOCK words; sources of up to BLOCK * LEAST_BLOCKS words get LEAST_BLOCKS smaller ones).

Schedule: slot n takes the point frac(n * golden ratio), in 32-bit whole numbers; cumulative weights (in blocks) map
it to a source, and the k-th slot of a source takes block k modulo its number of blocks, up to MAX_REPEATS rounds.

Ranks within a source and offsets within a stream are prefix sums in two levels (groups, then rows of a group), so a
source with a third of all rows is dealt over many tasks. Equal rows are one row with a count there (COPIES at most),
so a row that is repeated any number of times is no group of its own. Only the table of sources meets in one place.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 times; null and repeated ids are told apart by their texts; rows equal in id, source and text lie in the stream
one after the other, and which of them gets which count is open; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import saved

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK, LEAST_BLOCKS = 128, 64
#: Rows in a group of the two-level prefix sums.
GROUP_ROWS = 2048
#: Equal rows that are one row of the stream.
COPIES = 1 << 16
SLOT_GROUP = 65536
#: floor(2**32 / golden ratio), odd: the Weyl step of the golden-ratio sequence.
GOLDEN = 2654435769
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    parts = F.split(text, SPACE)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, n_blocks, first, share, slots) from (source, source_size).

    first and share are the source's interval of the schedule, in blocks; slots is the sum of all shares.
    The table of sources is small; it alone is sorted in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    w = sizes.withColumns({"place": n, "weight": weight, "cap": repeats * F.col("source_size")})
    # full sources are a prefix in the order of cap / weight
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    w = w.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # a source after the first that is not full is not full either
    w = w.withColumn("full", F.min(F.col("full").cast("int")).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    w = w.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))  # that of the first, as it falls from there
    w = w.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")))
    size = F.col("source_size")
    w = w.withColumn("n_blocks", F.greatest(F.ceil(size / BLOCK), F.least(size, F.lit(LEAST_BLOCKS).cast("long"))).cast("long"))
    w = w.withColumn("share", F.when(size > 0, F.col("target") * F.col("n_blocks") / size).otherwise(0.0))
    first = F.coalesce(F.sum("share").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return w.withColumns({"first": first, "slots": F.sum("share").over(every)}).select("source", "place", "source_size", "target", "n_blocks", "first", "share", "slots")


def point(n: Column) -> Column:
    """The golden-ratio point of slot n, in 0 .. 2**32 - 1, without overflow."""
    high, low = F.shiftright(n, 16) % 65536, n % 65536
    return ((high * GOLDEN) % 65536 * 65536 + low * GOLDEN) % (1 << 32)


def running(rows: DataFrame, keys: list[str], group: str, order: list, value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over earlier rows of the same keys, in the order of group, then order."""
    sums = rows.groupBy(*keys, group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inner.join(sums, [*keys, group]).withColumn(name, F.col("__base") + F.col("__own")).drop("__base", "__own")


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """(slot, place, block): the mix in order; slots of a source beyond its last round are left out."""
    spark = sources.sparkSession
    slots = spark.range(n_slots).withColumn("x", point(F.col("id")) / float(1 << 32) * F.lit(float(n_slots)))
    # the points lie on the scale of the sum of shares, and each source's interval on the same
    scale = sources.withColumns({"lo": F.col("first") / F.col("slots") * n_slots, "hi": (F.col("first") + F.col("share")) / F.col("slots") * n_slots}).filter("share > 0")
    # equi-join through cells of the scale: an interval lists the cells that it touches, a slot its own
    cells = 4096
    cell = lambda x: F.least(F.floor(x / n_slots * cells), F.lit(cells - 1))
    wide = scale.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).select("cell", "place", "lo", "hi", "n_blocks")
    hit = slots.withColumn("cell", cell(F.col("x"))).join(wide, "cell").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    mine = hit.select(F.col("id").alias("slot"), "place", "n_blocks", F.floor(F.col("id") / SLOT_GROUP).alias("group"), F.lit(1).cast("long").alias("one"))
    ranked = running(mine, ["place"], "group", ["slot"], "one", "rank")
    return ranked.filter(F.col("rank") < MAX_REPEATS * F.col("n_blocks")).select("slot", "place", (F.col("rank") % F.col("n_blocks")).alias("block"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, slots): documents with place, size, start in their source's stream, source_size and target; the schedule."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit("mix"), "doc_id", "text").alias("hash"))
    sized = saved(sized, "mix-sizes")
    n = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(targets(n), "mix-sources")
    total = sources.agg(F.max("slots").alias("slots"), F.sum("source_size")).first()
    n_slots = max(1, round(total["slots"] or 0))
    groups = max(1, sized.count() // GROUP_ROWS)
    rows = sized.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    rows = rows.withColumn("n", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("part") * COPIES)).withColumn("total", F.col("n") * F.col("size"))
    # the sources are as many as their distinct values: Spark broadcasts them only below its size limit
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    # consecutive ranges of the hash, so that the order does not depend on their number
    placed = placed.withColumn("group", F.floor((F.shiftright("hash", 32) + (1 << 31)) * groups / float(1 << 32)))
    streamed = running(placed, ["place"], "group", ["hash", "size", "doc_id", "part"], "total", "start")
    streamed = streamed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    return streamed.drop("group", "n", "part", "total", "copy"), schedule(sources, n_slots)


def block_pieces(streamed: DataFrame) -> DataFrame:
    """(place, start, block, words): how each document with words lies over the blocks of its source's stream."""
    size, blocks = F.col("source_size"), F.col("n_blocks")
    length = size / blocks  # in doubles: a product of whole numbers could overflow
    at = lambda word: F.floor(word / length).cast("long")  # the block, up to rounding
    edge = lambda block: F.when(block >= blocks, size).otherwise(F.floor(block * length)).cast("long")
    spread = streamed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.greatest(at(F.col("start")) - 1, F.lit(0)), F.least(at(F.col("start") + F.col("size")) + 1, blocks - 1))))
    words = F.least(F.col("start") + F.col("size"), edge(F.col("block") + 1)) - F.greatest(F.col("start"), edge(F.col("block")))
    return spread.withColumn("words", words).filter("words > 0").select("place", "start", "block", "words")


def mixed_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs."""
    streamed, slots = mix(docs)
    times = slots.groupBy("place", "block").agg(F.count("*").alias("times"))
    taken = block_pieces(streamed).join(times, ["place", "block"]).groupBy("place", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # (place, start) names one document among those with words
    mine = streamed.join(taken.withColumn("any", F.lit(True)), (streamed["place"] == taken["place"]) & (streamed["start"] == taken["start"]) & (streamed["size"] > 0), "left")
    return mine.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9_mix(docs: DataFrame) -> DataFrame:
    return mixed_counts(docs)
