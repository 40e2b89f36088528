"""Snapshots: each operator reads tables and returns the next version of one; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import normal_title


def filled(old: str, new: str):
    """old, or new where old is blank."""
    return F.coalesce(F.nullif(F.trim(F.col(old)), F.lit("")), F.col(new))


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either by paper_id; a row in both takes title, citation_count and abstract_text from new."""
    n = new.select("paper_id", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "paper_id"]).withColumn("__new", F.lit(True))
    both = old.withColumn("__old", F.lit(True)).join(n, "paper_id", "full_outer")
    changed = ("title", "citation_count", "abstract_text")
    value = lambda c: F.when(F.col("__new") if c in changed else F.col("__old").isNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("paper_id", *[value(c) for c in old.columns if c != "paper_id"])


def resolve_identity(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, matched_id, rule): each new row's match by paper_id, else doi, else title and year, else none.

    A row that one rule matched takes no part in the next; of several matches the smallest id counts.
    """
    rules = (("PAPER_ID", lambda t: [F.col("paper_id")]), ("DOI", lambda t: [F.lower("doi")]), ("TITLE_YEAR", lambda t: [F.lower("title"), F.col("year")]))
    rest, found = new, None
    for rule, key in rules:
        left = rest.select("new_id", *[k.alias(f"k{i}") for i, k in enumerate(key(rest))]).dropna()
        right = old.select(F.col("id").alias("matched_id"), *[k.alias(f"k{i}") for i, k in enumerate(key(old))]).dropna()
        keys = [c for c in left.columns if c != "new_id"]
        hits = left.join(right.groupBy(*keys).agg(F.min("matched_id").alias("matched_id")), keys).select("new_id", "matched_id", F.lit(rule).alias("rule"))
        found = hits if found is None else found.unionByName(hits)
        rest = rest.join(hits, "new_id", "left_anti")
    return found.unionByName(rest.select("new_id", F.lit(None).cast("long").alias("matched_id"), F.lit("INSERT").alias("rule")))


def federated_merge(records: DataFrame, strict_doi: bool = False) -> DataFrame:
    """One row for each record found by several sources (priority, id, doi, title, abstract_text, venue, citation_count).

    The key is the doi, else the title; the first source leads and later ones fill its blanks. strict_doi drops
    records without doi, as the published behaviour does.
    """
    doi = F.nullif(F.lower(F.trim("doi")), F.lit(""))
    keyed = records.filter(doi.isNotNull()) if strict_doi else records
    keyed = keyed.withColumn("key", F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("title:"), normal_title(F.col("title")))))
    text = lambda c: F.min(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct("priority", "id", F.col(c).alias("x"))))["x"].alias(c)
    count = F.min(F.when(F.col("citation_count") > 0, F.struct("priority", "id", F.col("citation_count").alias("x"))))["x"]
    return keyed.groupBy("key").agg(F.min(F.struct("priority", "id"))["id"].alias("id"), F.min("priority").alias("priority"), text("title"), text("abstract_text"), text("venue"), F.coalesce(count, F.lit(0)).alias("citation_count"), F.count("*").alias("n_records"))


def enrich(papers: DataFrame, metadata: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """papers with blanks of the columns filled from metadata (id, ...)."""
    m = metadata.select("id", *[F.col(c).alias(f"new_{c}") for c in columns])
    return papers.join(m, "id", "left").select(*[filled(c, f"new_{c}").alias(c) if c in columns else F.col(c) for c in papers.columns])


def set_flag(rows: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    """rows with the column set where the id is listed."""
    marked = ids.select("paper_id").distinct().withColumn("__hit", F.lit(True))
    return rows.join(marked, "paper_id", "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of new rows that share a key the first in column order stays."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key] or key))
    fresh = new.withColumn("__n", first).filter("__n = 1").drop("__n").join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh)


KEPT_STATUSES = ("SAVED", "DISMISSED", "INVESTIGATED")


def upsert_gaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Gaps of either by gap_id, new values first; a status that the user set survives."""
    n = new.select("gap_id", F.col("score").alias("new_score"), F.col("status").alias("new_status"))
    both = old.join(n, "gap_id", "full_outer")
    status = F.when(F.col("status").isin(*KEPT_STATUSES), F.col("status")).otherwise(F.coalesce("new_status", "status"))
    return both.select("gap_id", F.coalesce("new_score", "score").alias("score"), status.alias("status"))


def score_history(history: DataFrame, gaps: DataFrame, recorded_at) -> DataFrame:
    """The history with a row appended for each gap."""
    return history.unionByName(gaps.select("gap_id", "score", F.lit(recorded_at).alias("recorded_at")))


def delete_collection(user_library: DataFrame, collection_id: int) -> DataFrame:
    """Entries of the collection lose it."""
    return user_library.withColumn("collection_id", F.when(F.col("collection_id") != collection_id, F.col("collection_id")))


def keep_best(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """For each key the row of the largest value; ties go by the smallest tie column."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), tie))).filter("__n = 1").drop("__n")
