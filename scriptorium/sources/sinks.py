"""Exports of papers (names, year, title, venue, doi, citation_count) as CSV, BibTeX and RIS, a part file a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import citations
from scriptorium.functions.text import escape_latex, full_authors

FIELDS = ("names", "year", "title", "venue", "doi")


def export_csv(papers: DataFrame, path: str) -> None:
    """Seven columns; quotes are doubled."""
    rows = papers.select("title", full_authors(F.col("names")).alias("authors"), "year", "venue", "doi", "citation_count", F.coalesce("url", F.lit("")).alias("url") if "url" in papers.columns else F.lit("").alias("url"))
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def export_bibtex(papers: DataFrame, path: str, escape: bool = False) -> None:
    """An entry a paper, with a blank line after each; escape protects characters that LaTeX reads."""
    p = papers.withColumn("title", escape_latex(F.col("title"))) if escape else papers
    p.select(F.concat(citations.bibtex(*[F.col(c) for c in FIELDS]), F.lit("\n")).alias("value")).write.text(path)


def export_ris(papers: DataFrame, path: str) -> None:
    papers.select(F.concat(citations.ris(*[F.col(c) for c in FIELDS]), F.lit("\n")).alias("value")).write.text(path)
