"""The library: filters, smart queries, counts and statistics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def library_view(user_library: DataFrame, papers: DataFrame, collections: DataFrame) -> DataFrame:
    """Library rows with their paper and, where there is one, their collection's name."""
    named = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    return user_library.join(papers.withColumnRenamed("id", "paper_id"), "paper_id").join(named, "collection_id", "left")


def library_filter(view: DataFrame, collection_id: int | None = None, status: str | None = None, favorites: bool = False, include_deleted: bool = True) -> DataFrame:
    """Optional filters, ANDed; trashed papers stay unless include_deleted is off."""
    wanted: list[Column] = []
    if collection_id is not None:
        wanted.append(F.col("collection_id") == collection_id)
    if status:
        wanted.append(F.col("read_status") == status)
    if favorites:
        wanted.append(F.col("is_favorite"))
    if not include_deleted:
        wanted.append(~F.col("is_deleted"))
    return reduce(DataFrame.filter, wanted, view)


YEAR_TOKEN = re.compile(r"year(>=|<=|=)(.*)")


def smart_query(view: DataFrame, text: str, tags: DataFrame, authors: DataFrame) -> DataFrame:
    """Rows that satisfy every token: year>=N, year<=N, year=N, tag:X, author:X, else a part of the title.

    A year that is no number is true; no tokens mean all rows. X and title parts match without case, and % and _ in
    them are wildcards. Tags and authors, (paper_id, name), are left semi joins.
    """
    for token in (text or "").split():
        low = token.lower()
        if m := YEAR_TOKEN.fullmatch(low):
            if re.fullmatch(r"[+-]?\d+", m[2]):
                n = int(m[2])
                view = view.filter({">=": F.col("year") >= n, "<=": F.col("year") <= n, "=": F.col("year") == n}[m[1]])
        elif low.startswith("tag:"):
            view = view.join(tags.filter(F.col("name").ilike(f"%{token[4:]}%")).select("paper_id"), "paper_id", "left_semi")
        elif low.startswith("author:"):
            view = view.join(authors.filter(F.col("name").ilike(f"%{token[7:]}%")).select("paper_id"), "paper_id", "left_semi")
        else:
            view = view.filter(F.col("title").ilike(f"%{token}%"))
    return view


def smart_collection(view: DataFrame, text: str, tags: DataFrame, authors: DataFrame, status: str | None = None, favorites: bool = False) -> DataFrame:
    return library_filter(smart_query(view, text, tags, authors), status=status, favorites=favorites, include_deleted=False)


def recently(view: DataFrame, column: str, days: int, as_of: str) -> DataFrame:
    return view.filter(F.col(column) >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def keyword_search(papers: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Papers with any of the terms in title or abstract, most cited first."""
    has = lambda t: F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(t)) | F.contains(F.lower(F.coalesce("abstract_text", F.lit(""))), F.lit(t))
    hits = papers.filter(reduce(lambda a, b: a | b, (has(t.lower()) for t in terms), F.lit(False)))
    return hits.orderBy(F.desc("citation_count"), "id").limit(limit)


def text_filter(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    n = F.lit(needle.lower())
    return rows.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), n) for c in columns)))


def palette(items: DataFrame, needle: str) -> DataFrame:
    """At most 15 matches of label or subtitle; the first 12 when nothing is asked."""
    return text_filter(items, needle, "label", "subtitle").orderBy("label", "id").limit(15) if needle else items.orderBy("label", "id").limit(12)


def year_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Unknown years pass."""
    return rows.filter((F.coalesce("year", F.lit(0)) == 0) | F.col("year").between(low, high))


def collection_counts(collections: DataFrame, user_library: DataFrame) -> DataFrame:
    n = user_library.groupBy("collection_id").agg(F.count("*").alias("n"))
    return collections.join(n, F.col("id") == F.col("collection_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def papers_by_year(papers: DataFrame, last: int = 10) -> DataFrame:
    """Counts of the last distinct years after 1900, in ascending order."""
    counts = papers.filter("year > 1900").groupBy("year").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("year")).limit(last).orderBy("year")


def top_venues(papers: DataFrame, n: int = 8) -> DataFrame:
    return papers.filter("coalesce(venue, '') <> ''").groupBy("venue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue").limit(n)


def library_stats(view: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row: totals, favourites, read share, recent additions, span of years and their whole mean."""
    known = F.when(F.col("year") > 0, F.col("year"))
    recent = F.col("added_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return view.agg(
        F.count("*").alias("total"),
        F.count_if("is_favorite").alias("favorites"),
        F.count_if(F.col("read_status") == "READ").alias("papers_read"),
        F.round(F.avg((F.col("read_status") == "READ").cast("double")) * 100, 6).alias("read_percent"),
        F.count_if(recent).alias("recent"),
        F.min(known).alias("first_year"),
        F.max(known).alias("last_year"),
        F.floor(F.avg(known)).cast("long").alias("mean_year"),
    )


def result_insights(papers: DataFrame, as_of: int) -> DataFrame:
    """(rule, value) of the rules that hold for a set of results; venues are compared without case."""
    age = F.lit(as_of) - F.col("year")
    known = F.col("year") > 0
    facts = papers.agg(
        F.count("*").alias("n"), F.count_if(known).alias("dated"), F.count_if(known & (age <= 3)).alias("recent"), F.count_if(known & (age >= 5)).alias("old"), F.avg("citation_count").alias("mean")
    )
    top = papers.filter("coalesce(venue, '') <> ''").groupBy(F.lower("venue").alias("v")).agg(F.count("*").alias("c")).agg(F.max("c").alias("top"))
    f = facts.crossJoin(top)  # one row each
    share = F.col("recent") * 100.0 / F.col("dated")
    rules = F.array(
        F.when((F.col("dated") > 0) & (share >= 70), F.struct(F.lit("FAST_MOVING").alias("rule"), F.round(share, 6).alias("value"))),
        F.when((F.col("dated") > 0) & (share <= 30) & (F.col("old") > F.floor(F.col("dated") / 2)), F.struct(F.lit("MATURE").alias("rule"), F.round(share, 6).alias("value"))),
        F.when((F.col("n") > 3) & (F.col("top") >= F.floor(F.col("n") / 2)), F.struct(F.lit("LOW_DIVERSITY").alias("rule"), F.col("top").cast("double").alias("value"))),
        F.when(F.col("mean") >= 100, F.struct(F.lit("HIGH_IMPACT").alias("rule"), F.round("mean", 6).alias("value"))),
    )
    return f.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.*")
