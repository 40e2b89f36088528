"""Bibliographic records: RIS, BibTeX, and payloads captured from services.

Files are read by Spark's own readers; executors never open a path. Every reader returns
(type, title, abstract_text, doi, year, venue, authors, keywords), one row a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import first_year, unescape_latex

RECORD = "type string, title string, abstract_text string, doi string, year int, venue string, authors array<string>, keywords array<string>"
#: RIS tags of each field, the first present counts.
RIS_TAGS = {"title": ("TI", "T1", "CT"), "abstract_text": ("AB", "N2"), "doi": ("DO", "DOI"), "year": ("PY", "Y1", "DA"), "venue": ("JO", "T2", "JF", "BT")}
RIS_LISTS = {"authors": ("AU", "A1"), "keywords": ("KW",)}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row a file."""
    return spark.read.text(path, wholetext=True)


def ris_records(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Records of RIS texts (value): lines "XX  - text", from TY to ER. lenient takes any spaces around the hyphen."""
    records = files.select(F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"(?m)^ER[ \t]*-.*$")).alias("r")).filter(F.col("r").rlike(r"(?m)^TY"))
    line = r"(?m)^([A-Z][A-Z0-9]{1,2}) *- *(.*)$" if lenient else r"(?m)^([A-Z][A-Z0-9]{1,2})  - ?(.*)$"
    tags = F.regexp_extract_all("r", F.lit(line), 1)
    values = F.transform(F.regexp_extract_all("r", F.lit(line), 2), lambda v: F.trim(v))
    rows = records.select(F.arrays_zip(tags.alias("t"), values.alias("v")).alias("f"))
    of = lambda names: F.transform(F.filter("f", lambda x: x["t"].isin(*names) & (x["v"] != "")), lambda x: x["v"])
    first = lambda names: F.coalesce(*[F.get(of((n,)), F.lit(0)) for n in names])
    return rows.select(
        first(("TY",)).alias("type"), first(RIS_TAGS["title"]).alias("title"), first(RIS_TAGS["abstract_text"]).alias("abstract_text"),
        F.regexp_replace(first(RIS_TAGS["doi"]), r"^https?://(dx\.)?doi\.org/", "").alias("doi"), first_year(F.coalesce(first(RIS_TAGS["year"]), F.lit(""))).alias("year"),
        first(RIS_TAGS["venue"]).alias("venue"), of(RIS_LISTS["authors"]).alias("authors"), of(RIS_LISTS["keywords"]).alias("keywords"),
    )


ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*[{(]\s*([^,\s]*)\s*,")
FIELD = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")


def braced(text: str, at: int) -> tuple[str, int]:
    """The value that begins at `at` (braces, quotes or a bare word) and where it ends; braces nest."""
    if at < len(text) and text[at] in '{"':
        stop, depth, i = ("}" if text[at] == "{" else '"'), 0, at + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == stop and depth == 0:
                return text[at + 1 : i], i + 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            i += 1
        return text[at + 1 :], len(text)
    m = re.compile(r"[^,}\s]*").match(text, at)
    return m.group(), m.end()


def bibtex_entries(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    at = 0
    while m := ENTRY.search(text, at):
        at, fields = m.end(), {}
        while f := FIELD.match(text, at):
            value, at = braced(text, f.end())
            fields[f.group(1).lower()] = re.sub(r"\s+", " ", value).strip()
            more = re.compile(r"\s*,").match(text, at)
            if not more:
                break
            at = more.end()
        if m.group(1).lower() not in ("comment", "string", "preamble"):
            yield m.group(1).lower(), fields


def bibtex_records(files: DataFrame) -> DataFrame:
    """Records of BibTeX texts (value). Braces nest, so entries are parsed in Python; what follows is Spark's."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame([(kind, f.get("title"), f.get("abstract"), f.get("doi"), f.get("year") or f.get("date"), f.get("journal") or f.get("booktitle"), f.get("author"), f.get("keywords")) for text in b["value"] if text for kind, f in bibtex_entries(text)], columns=["type", "title", "abstract_text", "doi", "year", "venue", "author", "keywords"], dtype="object")

    raw = files.select("value").mapInPandas(parse, "type string, title string, abstract_text string, doi string, year string, venue string, author string, keywords string")
    names = F.transform(F.split(F.coalesce("author", F.lit("")), r"(?i)\s+and\s+"), lambda a: F.trim(unescape_latex(a)))
    # "Last, First" becomes "First Last"
    names = F.transform(names, lambda a: F.when(a.contains(","), F.concat_ws(" ", F.trim(F.regexp_extract(a, ",(.*)$", 1)), F.trim(F.substring_index(a, ",", 1)))).otherwise(a))
    words = F.transform(F.split(F.coalesce("keywords", F.lit("")), "[,;]"), lambda k: F.trim(k))
    keep = lambda a: F.filter(a, lambda x: x != "")
    kind = F.when(F.col("type").isin("inproceedings", "conference", "proceedings"), "CONF").when(F.col("type").isin("book", "inbook"), "BOOK").otherwise("JOUR")
    return raw.select(kind.alias("type"), unescape_latex(F.col("title")).alias("title"), unescape_latex(F.col("abstract_text")).alias("abstract_text"), "doi", first_year(F.coalesce("year", F.lit(""))).alias("year"), unescape_latex(F.col("venue")).alias("venue"), keep(names).alias("authors"), keep(words).alias("keywords"))


def bibtex_lenient(files: DataFrame) -> DataFrame:
    """(cite_key, title, year, doi, venue, author) of BibTeX texts (value) by regular expressions alone.

    For texts that the strict parser gives up on: an entry runs to the next line that begins with @, braces need not
    balance, and a field's value ends at its own closing mark on the line.
    """
    entries = files.select(F.explode(F.split("value", r"(?m)^\s*(?=@)")).alias("e")).filter(F.col("e").rlike(r"^@\w+\s*[{(]"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("e", rf"(?im)^\s*{name}\s*=\s*[{{\"]?(.*?)[}}\"]?\s*,?\s*$", 1)), F.lit(""))
    out = entries.select(F.nullif(F.trim(F.regexp_extract("e", r"^@\w+\s*[{(]\s*([^,\s]*)", 1)), F.lit("")).alias("cite_key"), *[field(n).alias(n) for n in ("title", "year", "doi", "journal", "author")])
    return out.select("cite_key", F.coalesce("title", F.lit("")).alias("title"), first_year(F.coalesce("year", F.lit(""))).alias("year"), "doi", F.col("journal").alias("venue"), "author")


POSTED = "title string, authors array<string>, year int, doi string, journal string, abstract string, url string"


def ingest_posted(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Records posted to a folder as JSON lines, taken up by a stream: what was there before is not read again.

    Records without a title are left out. The same checkpoint and out go on where the last run ended.
    """
    from scriptorium.streaming.events import run_to_table

    rows = spark.readStream.schema(POSTED).json(folder)
    run_to_table(rows.filter("title IS NOT NULL").withColumnRenamed("journal", "venue"), out, checkpoint, mode="append")


def import_auto(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("ris", "bib", "bibtex"):
        raise ValueError(f"unsupported file type: {suffix}")
    files = read_text(spark, path)
    return ris_records(files) if suffix == "ris" else bibtex_records(files)


def text_of_inverted_index(payload: Column) -> Column:
    """Words in order of position, from {"word": [positions]} as JSON."""
    entries = F.map_entries(F.from_json(payload, "map<string,array<int>>"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


OPENALEX = "results array<struct<display_name:string,doi:string,publication_year:int,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,primary_location:struct<source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>>>"
CROSSREF = "message struct<items:array<struct<DOI:string,title:array<string>,`container-title`:array<string>,`is-referenced-by-count`:int,abstract:string,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>>>>"
EUROPE_PMC = "resultList struct<result:array<struct<title:string,doi:string,pubYear:string,citedByCount:int,abstractText:string,journalTitle:string,authorString:string>>>"


def openalex_records(payloads: DataFrame) -> DataFrame:
    """Records of captured result pages (value, JSON)."""
    r = payloads.select(F.explode(F.from_json("value", OPENALEX)["results"]).alias("r"))
    positions = F.flatten(F.transform(F.map_entries("r.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return r.select(F.col("r.display_name").alias("title"), F.array_join(F.transform(F.array_sort(positions), lambda x: x["w"]), " ").alias("abstract_text"), F.regexp_replace("r.doi", r"^https?://doi\.org/", "").alias("doi"), F.coalesce("r.publication_year", F.lit(0)).alias("year"), F.coalesce("r.cited_by_count", F.lit(0)).alias("citation_count"), F.col("r.primary_location.source.display_name").alias("venue"), F.col("r.authorships.author.display_name").alias("authors"))


def crossref_records(payloads: DataFrame) -> DataFrame:
    """Records with a doi and a title; the year of print, else online."""
    r = payloads.select(F.explode(F.from_json("value", CROSSREF)["message"]["items"]).alias("r"))
    year = F.coalesce(F.col("r.published-print.date-parts")[0][0], F.col("r.published-online.date-parts")[0][0], F.lit(0))
    names = F.transform(F.coalesce("r.author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", a["given"], a["family"]))
    out = r.select(F.get("r.title", F.lit(0)).alias("title"), F.col("r.abstract").alias("abstract_text"), F.col("r.DOI").alias("doi"), year.alias("year"), F.coalesce("r.is-referenced-by-count", F.lit(0)).alias("citation_count"), F.get("r.container-title", F.lit(0)).alias("venue"), names.alias("authors"))
    return out.filter("coalesce(doi, '') <> '' AND coalesce(title, '') <> ''")


def europe_pmc_records(payloads: DataFrame) -> DataFrame:
    r = payloads.select(F.explode(F.from_json("value", EUROPE_PMC)["resultList"]["result"]).alias("r"))
    names = F.filter(F.transform(F.split(F.coalesce("r.authorString", F.lit("")), ","), lambda a: F.regexp_replace(F.trim(a), r"\.$", "")), lambda a: a != "")
    return r.select("r.title", F.col("r.abstractText").alias("abstract_text"), "r.doi", first_year(F.coalesce("r.pubYear", F.lit(""))).alias("year"), F.coalesce("r.citedByCount", F.lit(0)).alias("citation_count"), F.col("r.journalTitle").alias("venue"), names.alias("authors"))


def pivot_items(values: DataFrame, fields: list[str], creators: DataFrame) -> DataFrame:
    """Items of an attribute-value store (item_id, field, value), with creators (item_id, place, name) in order."""
    wide = values.groupBy("item_id").pivot("field", fields).agg(F.first("value", ignorenulls=True))
    names = creators.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("c")).select("item_id", F.col("c.name").alias("authors"))
    return wide.join(names, "item_id", "left")
