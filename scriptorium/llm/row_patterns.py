"""Row pattern matching over each client's clicks, in Spark's own expressions: A (D+ U+)+ P?

The rows of a client that hold a large share of the table are cut into slices of time, so that no task holds a client.
Cuts are quantiles of such clients' times; there are at most as many as SLICES. A slice knows the last row before it and
the first one after it. Within a slice, rows that follow each other as D or U form a segment; nothing beyond a segment
and the row behind it can be in a match that starts there. Segments that run over a cut are joined: two a slice at most.

transform() encodes what follows each start in its segment as a text, one character a row: the letter that the row fits,
as a capital if it would also do as P, which depends on the start's cents. regexp_extract then reads lengths and letters
off this text; its quantifiers need not give anything back, as no character is in two classes of (D+ U+)+.

Defined cases: rows without client or time take no part; a null, NaN or infinite value fits no letter; repeated rows
count once, extra columns included, so rows that differ in these alone are several; rows of one client, time and click_id
follow each other by kind, cents (null first) and a hash of their other columns; a null click_id comes first and is
given as null; a null kind is neither error nor click; any number of rows may tie in time, those of a client and
microsecond stay in one slice; a segment is one row of its task, as its longest match is in the result; extra columns with
any names are not read beyond that hash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import saved

#: Slices that the rows of frequent clients are cut into: so many for each shuffle partition, and at most so many.
SLICES_EACH, SLICES = 4, 4096
GAP = "INTERVAL 30 MINUTES"
PATTERN = "^((?:[dD]++[uU]++)++)([DUP]?)"


def clean_rows(clicks: DataFrame) -> DataFrame:
    """(client_id, ts, click_id, kind, cents, other): the rows that take part, repeated ones still repeated."""
    x = 100 * F.col("value").cast("double") + 0.5
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    rest = [c for c in clicks.columns if c not in ("client_id", "ts", "click_id", "kind")]
    rows = clicks.filter(F.col("client_id").isNotNull() & F.col("ts").isNotNull())
    return rows.select("client_id", "ts", "click_id", "kind", F.when(finite, F.floor(x)).alias("cents"), F.xxhash64(*rest).alias("other"))


def time_cuts(rows: DataFrame) -> list[tuple]:
    """(client_id, times at which the client's rows are cut, as text and in order) of frequent clients.

    A client is frequent if it has more than 1 / slices of all rows, so there are fewer such clients than slices, and
    fewer cuts than twice that.
    """
    slices = min(SLICES, SLICES_EACH * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = rows.count() / slices
    frequent = rows.groupBy("client_id").agg(F.count("*").alias("n")).filter(F.col("n") > max(1, least)).collect()
    if not frequent:
        return []
    step = {r["client_id"]: max(1, int(slices * least / r["n"])) for r in frequent}
    at = F.percentile_approx("ts", [i / slices for i in range(1, slices)], 4 * slices)
    marks = rows.filter(F.col("client_id").isin(list(step))).groupBy("client_id").agg(F.transform(at, lambda x: x.cast("string")).alias("at"))
    found = ((r["client_id"], list(dict.fromkeys(r["at"][step[r["client_id"]] - 1 :: step[r["client_id"]]]))) for r in marks.collect())
    return [(client, cuts) for client, cuts in found if cuts]


def cut_map(rows: DataFrame, cuts: list[tuple]) -> Column:
    """The cuts by client, as a constant: joins by client would meet a frequent client's rows in one key."""
    client, ts = (rows.schema[c].dataType.simpleString() for c in ("client_id", "ts"))
    keys = F.array(*[F.lit(c).cast(client) for c, _ in cuts])
    return F.map_from_arrays(keys, F.array(*[F.array(*map(F.lit, own)).cast(f"array<{ts}>") for _, own in cuts]))


def place(cuts: Column, x: Column) -> Column:
    """How many of the sorted cuts are at or below x, by bisection."""

    def bisected(own: Column) -> Column:
        def halve(at: Column, _: Column) -> Column:
            mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            open_, below = at["lo"] < at["hi"], F.get(own, mid) <= x
            return F.struct(F.when(open_ & below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(at["hi"]).alias("hi"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(own) + 1)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi")), halve)["lo"]

    return F.transform(F.array(cuts), bisected)[0]  # bound as an element, so that the cuts are looked up once


ORDER = ("ts", "click_id", "kind", "cents", "other")


def facts() -> Column:
    return F.struct(*ORDER)


def sliced(rows: DataFrame, cuts: list[tuple]) -> tuple[DataFrame, DataFrame | None]:
    """rows with slice, the number of their client's slice; (client_id, slice, before, after): the last row before each slice and the first one after it."""
    if not cuts:
        return rows.withColumn("slice", F.lit(0)), None
    frequent = F.col("client_id").isin([client for client, _ in cuts])
    placed = rows.withColumn("slice", F.when(frequent, place(cut_map(rows, cuts)[F.col("client_id")], F.col("ts"))).otherwise(0))
    ends = placed.filter(frequent).groupBy("client_id", "slice").agg(F.min(facts()).alias("first"), F.max(facts()).alias("last"))
    by = Window.partitionBy("client_id").orderBy("slice")
    around = ends.select("client_id", "slice", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    return placed, saved(around, "slice-ends")


def lettered(rows: DataFrame, around: DataFrame | None) -> DataFrame:
    """Distinct rows with i, their place in client and slice, letter (d, u or null), p (whether they do as P but for the
    start's cents), segment (the place of its first row; null before a slice's first), what follows, and runs_on, whether
    the segment goes on in the next slice."""
    keys = ["client_id", "slice"]
    rows = rows.repartition(*keys).select(*keys, *ORDER).distinct()
    by = Window.partitionBy(*keys).orderBy(*ORDER)
    rows = rows.withColumns({"i": F.row_number().over(by), "prev": F.lag(facts()).over(by), "ahead": F.lead(facts()).over(by)})
    rows = rows.withColumns({"follow": F.col("ahead"), "ends": F.col("ahead").isNull()})
    if around is not None:
        rows = rows.join(F.broadcast(around), keys, "left")  # a row a slice of a frequent client
        rows = rows.withColumns({"prev": F.coalesce("prev", F.when(F.col("i") == 1, F.col("before"))), "follow": F.coalesce("ahead", "after")})

    def letter(at: Column, prev: Column) -> Column:
        near = (at["ts"] <= prev["ts"] + F.expr(GAP)) & (at["kind"] != "error")
        return F.when(near & (at["cents"] < prev["cents"]), "d").when(near & (at["cents"] > prev["cents"]), "u")

    def last(at: Column, prev: Column) -> Column:
        return F.coalesce((at["ts"] <= prev["ts"] + F.expr(GAP)) & (at["kind"] == "click") & at["cents"].isNotNull(), F.lit(False))

    follow = F.col("follow")
    rows = rows.select(
        *keys, "i", "click_id", "cents", letter(facts(), F.col("prev")).alias("letter"), last(facts(), F.col("prev")).alias("p"), letter(follow, facts()).alias("next_letter"),
        F.when(last(follow, facts()), F.struct(follow["click_id"].alias("id"), follow["cents"].alias("cents"))).alias("tail"), "ends",
    )
    begun = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment", F.last(F.when(F.col("letter").isNull(), F.col("i")), ignorenulls=True).over(begun))
    # a row with no neighbour in a segment can't be in a match but as P, which its predecessor knows
    rows = rows.filter("letter IS NOT NULL OR next_letter IS NOT NULL")
    return rows.withColumn("runs_on", F.col("ends") & F.col("next_letter").isNotNull())


def segments(rows: DataFrame) -> DataFrame:
    """(client_id, slice, segment, runs_on, rows): each segment's rows within its slice, in order."""
    row = F.struct("i", "click_id", "cents", "letter", "p", (F.col("next_letter") == "d").alias("starts"), "tail", "slice")
    return rows.groupBy("client_id", "slice", "segment").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.bool_or("runs_on").alias("runs_on"))


def joined_segments(pieces: DataFrame) -> DataFrame:
    """(client_id, rows) of the segments that run over a cut, from their pieces."""
    by = Window.partitionBy("client_id").orderBy("slice", F.col("segment").isNotNull())
    chained = pieces.withColumn("chain", F.count("segment").over(by))
    part = F.struct("slice", F.col("segment").isNotNull().alias("own"), "rows")
    return chained.groupBy("client_id", "chain").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("client_id", F.flatten("parts.rows").alias("rows"))


def segment_matches(rows: Column) -> Column:
    """An array with a match for each start of the segment that has one."""
    n = F.size(rows)
    tail = F.element_at(rows, -1)["tail"]

    def code(r: Column, least: Column) -> Column:
        return F.when(r["p"] & (r["cents"] >= least), F.upper(r["letter"])).otherwise(r["letter"])

    def start(r: Column, i: Column) -> Column:
        rest = F.array_join(F.transform(F.slice(rows, i + 2, n), lambda x: code(x, r["cents"])), "")
        ending = F.when(tail["cents"] >= r["cents"], "P").otherwise("")
        return F.when(r["starts"], F.struct(i.alias("i"), F.concat(rest, ending).alias("text")))

    def read(x: Column) -> Column:
        core, p = F.regexp_extract(x["text"], PATTERN, 1), F.regexp_extract(x["text"], PATTERN, 2)
        return F.struct(x["i"].alias("i"), F.length(core).alias("length"), F.length(p).alias("p"), F.concat(F.lit("A"), F.upper(core), F.when(p != "", "P").otherwise("")).alias("labels"))

    starts = F.filter(F.transform(rows, start), lambda x: x.isNotNull())
    found = F.filter(F.transform(starts, read), lambda x: x["length"] > 0)

    def match(x: Column) -> Column:
        first = F.get(rows, x["i"])
        inside = F.slice(rows, x["i"] + 1, x["length"] + 1)
        after = F.get(rows, x["i"] + x["length"] + 1)
        # P is a row of the segment or the one behind it
        p_id = F.when(after.isNotNull(), after["click_id"]).otherwise(tail["id"])
        p_cents = F.when(after.isNotNull(), after["cents"]).otherwise(tail["cents"])
        total = F.aggregate(inside, F.lit(0).cast("long"), lambda s, r: s + r["cents"])
        return F.struct(
            first["slice"].alias("slice"), first["i"].alias("at"), first["click_id"].alias("first_id"), F.when(x["p"] > 0, p_id).otherwise(F.element_at(inside, -1)["click_id"]).alias("last_id"),
            (x["length"] + 1 + x["p"]).cast("long").alias("n_rows"), (total + F.when(x["p"] > 0, p_cents).otherwise(0)).alias("sum_cents"), x["labels"].alias("labels"),
        )

    return F.transform(found, match)


def row_pattern_matches(clicks: DataFrame) -> DataFrame:
    """(client_id, match_no, first_id, last_id, n_rows, sum_cents, labels) of every match, from clicks (click_id, ts, client_id, kind, value, ...)."""
    rows = clean_rows(clicks)
    cuts = time_cuts(rows)
    pieces = segments(lettered(*sliced(rows, cuts)))
    apart = F.col("segment").isNotNull() & ~F.col("runs_on")
    # a table with the matches of whole segments, and the rows of the few pieces that lie at a cut
    kept = pieces.select("client_id", "slice", "segment", F.when(apart, segment_matches(F.col("rows"))).alias("matches"), F.when(~apart, F.col("rows")).alias("rows"))
    kept = saved(kept.filter("rows IS NOT NULL OR size(matches) > 0"), "segments")
    found = kept.filter("rows IS NULL").select("client_id", F.explode("matches").alias("m"))
    if cuts:
        whole = joined_segments(kept.filter("rows IS NOT NULL").select("client_id", "slice", "segment", "rows"))
        found = found.unionByName(whole.select("client_id", F.explode(segment_matches(F.col("rows"))).alias("m")))
    found = found.select("client_id", "m.*")
    by = Window.partitionBy("client_id", "slice").orderBy("at")
    numbered = found.withColumn("place", F.row_number().over(by).cast("long"))
    if not cuts:
        numbered = numbered.withColumn("match_no", F.col("place"))
    else:
        per_slice = found.filter(F.col("client_id").isin([client for client, _ in cuts])).groupBy("client_id", "slice").agg(F.count("*").alias("n"))
        earlier = F.sum("n").over(Window.partitionBy("client_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        offsets = saved(per_slice.select("client_id", "slice", earlier.alias("earlier")), "match-counts")
        numbered = numbered.join(F.broadcast(offsets), ["client_id", "slice"], "left").withColumn("match_no", F.col("place") + F.coalesce("earlier", F.lit(0)))  # a row a slice
    return numbered.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels")


def op11_patterns(clicks: DataFrame) -> DataFrame:
    found = row_pattern_matches(clicks)
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


#: In a segment whose second row is a D, everything to the last U matches (D+ U+)+.
ORACLE = """
WITH o AS (SELECT client_id, ts, click_id, kind, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS c,
    row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS i
  FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)),
l AS (SELECT *, coalesce(ts <= lag(ts) OVER w + INTERVAL 30 MINUTE AND kind = 'click' AND c IS NOT NULL, false) AS p,
    CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE AND kind <> 'error' THEN CASE WHEN c < lag(c) OVER w THEN 'D' WHEN c > lag(c) OVER w THEN 'U' END END AS letter
  FROM o WINDOW w AS (PARTITION BY client_id ORDER BY i)),
s AS (SELECT *, count(*) FILTER (WHERE letter IS NULL) OVER (PARTITION BY client_id ORDER BY i) AS seg, sum(c) OVER (PARTITION BY client_id ORDER BY i) AS run, lead(letter) OVER (PARTITION BY client_id ORDER BY i) AS next FROM l),
t AS (SELECT client_id, seg, min(i) AS lo, max(i) FILTER (WHERE letter = 'U') AS hi, string_agg(coalesce(letter, '-'), '' ORDER BY i) AS letters FROM s GROUP BY ALL),
m AS (SELECT s.client_id, s.i, s.click_id AS first_id, u.click_id AS u_id, p.click_id AS p_id, p.p AND p.c >= s.c AS has_p, p.c AS p_c, t.hi - s.i + 1 AS n, u.run - s.run + s.c AS total, 'A' || substr(t.letters, s.i - t.lo + 2, t.hi - s.i) AS labels
  FROM s JOIN t USING (client_id, seg) JOIN s u ON u.client_id = s.client_id AND u.i = t.hi LEFT JOIN s p ON p.client_id = s.client_id AND p.i = t.hi + 1 WHERE s.next = 'D' AND t.hi > s.i)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY i) AS match_no, first_id, CASE WHEN has_p THEN p_id ELSE u_id END AS last_id, n + CASE WHEN has_p THEN 1 ELSE 0 END AS n_rows,
  CAST(total + CASE WHEN has_p THEN p_c ELSE 0 END AS BIGINT) AS sum_cents, sha256(labels || CASE WHEN has_p THEN 'P' ELSE '' END) AS labels_sha256 FROM m"""
