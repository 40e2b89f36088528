"""Queries over imports, exports and streams. Texts are rendered from the tables, written, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import citations
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import BIBTEX, RIS, cited_papers
from scriptorium.sources import records, sinks
from scriptorium.storage import scratch_path, table
from scriptorium.streaming import events

FIELDS = ("names", "year", "title", "venue", "doi")


def papers(spark, d):
    """Papers with names and single-line titles, as record formats hold them."""
    p = cited_papers(spark, d).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return p.withColumn("title", F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}.,-]+", " ")))


CLEAN = r"trim(regexp_replace(title, '[^\p{L}\p{N}.,-]+', ' ', 'g'))"


@query("ris_import", f"SELECT {CLEAN} AS title, year, doi, venue, array_to_string(names, ';') AS authors FROM cited_papers")
def ris_import(spark, d):
    """Every paper written as RIS text and imported again."""
    path = scratch_path(spark, "ris")
    sinks.export_ris(papers(spark, d), path)
    found = records.ris_records(records.read_text(spark, path))
    return found.select(F.coalesce("title", F.lit("")).alias("title"), "year", "doi", "venue", F.array_join("authors", ";").alias("authors"))


@query("ris_import_lenient", f"SELECT {CLEAN} AS title, year FROM cited_papers")
def ris_import_lenient(spark, d):
    text = papers(spark, d).select(F.regexp_replace(citations.ris(*[F.col(c) for c in FIELDS]), "  - ", " - ").alias("value"))
    return records.ris_records(text, lenient=True).select(F.coalesce("title", F.lit("")).alias("title"), "year")


@query("bibtex_import", f"SELECT {CLEAN} AS title, year, doi, venue, array_to_string(names, ';') AS authors FROM cited_papers")
def bibtex_import(spark, d):
    path = scratch_path(spark, "bib")
    sinks.export_bibtex(papers(spark, d), path)
    return records.bibtex_records(records.read_text(spark, path)).select("title", "year", "doi", "venue", F.array_join("authors", ";").alias("authors"))


@query("export_csv", f"SELECT {CLEAN} AS title, CASE WHEN len(names) = 0 THEN 'Unknown Authors' ELSE array_to_string(names, ', ') END AS authors, CAST(year AS INT) AS year, venue, doi FROM cited_papers")
def export_csv(spark, d):
    """What a reader finds in the exported CSV."""
    path = scratch_path(spark, "csv")
    sinks.export_csv(papers(spark, d), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', schema="title string, authors string, year int, venue string, doi string, citation_count int, url string")
    return back.select(F.coalesce("title", F.lit("")).alias("title"), "authors", "year", "venue", "doi")


CLEANED = f"(SELECT * REPLACE ({CLEAN} AS title) FROM cited_papers)"
ESCAPED = r"(SELECT * REPLACE (regexp_replace(coalesce(title, ''), '([&%$#_])', '\\\1', 'g') AS title) FROM "
EXPORTED = "SELECT value, count(*) AS n FROM (SELECT unnest(string_split({}, chr(10))) AS value FROM {}) WHERE value <> '' GROUP BY value"


@query("export_bibtex", EXPORTED.format(BIBTEX, f"{ESCAPED}{CLEANED})"))
def export_bibtex(spark, d):
    path = scratch_path(spark, "bib")
    sinks.export_bibtex(papers(spark, d), path, escape=True)
    return spark.read.text(path).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


@query("export_ris", EXPORTED.format(RIS, CLEANED))
def export_ris(spark, d):
    path = scratch_path(spark, "ris")
    sinks.export_ris(papers(spark, d), path)
    return spark.read.text(path).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


@query("openalex_parse", f"SELECT {CLEAN} AS title, 'a b a' AS abstract_text, coalesce(doi, '') AS doi, year, venue, array_to_string(names, ';') AS authors FROM cited_papers")
def openalex_parse(spark, d):
    """Captured result pages, made from the papers, parsed."""
    author = F.transform("names", lambda n: F.struct(F.struct(n.alias("display_name")).alias("author")))
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("b"), F.array(F.lit(1)))
    item = F.struct(F.col("title").alias("display_name"), F.concat(F.lit("https://doi.org/"), F.coalesce("doi", F.lit(""))).alias("doi"), F.col("year").alias("publication_year"), F.lit(3).alias("cited_by_count"), index.alias("abstract_inverted_index"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), author.alias("authorships"))
    pages = papers(spark, d).select(F.to_json(F.struct(F.array(item).alias("results"))).alias("value"))
    return records.openalex_records(pages).select("title", "abstract_text", "doi", "year", "venue", F.array_join("authors", ";").alias("authors"))


@query("crossref_parse", f"SELECT {CLEAN} AS title, doi, year, venue, array_to_string(names, ';') AS authors FROM cited_papers WHERE coalesce(doi, '') <> '' AND {CLEAN} <> ''")
def crossref_parse(spark, d):
    name = F.transform("names", lambda n: F.struct(F.regexp_replace(n, r"\s+\S+$", "").alias("given"), F.regexp_extract(n, r"(\S+)$", 1).alias("family")))
    item = F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), F.array("venue").alias("container-title"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("published-online"), name.alias("author"))
    pages = papers(spark, d).select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("value"))
    return records.crossref_records(pages).select("title", "doi", "year", "venue", F.array_join("authors", ";").alias("authors"))


@query("europepmc_parse", f"SELECT {CLEAN} AS title, doi, year, venue, array_to_string(list_transform(names, lambda n: replace(n, ',', '')), ';') AS authors FROM cited_papers")
def europepmc_parse(spark, d):
    item = F.struct("title", "doi", F.col("year").cast("string").alias("pubYear"), F.col("venue").alias("journalTitle"), F.concat(F.array_join("names", ", "), F.lit(".")).alias("authorString"))
    pages = papers(spark, d).select(F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("resultList"))).alias("value"))
    return records.europe_pmc_records(pages).select("title", "doi", "year", "venue", F.array_join("authors", ";").alias("authors"))


@query("stream_event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark, d):
    """Extension: the stream's windows, equal to the batch's."""
    return events.streamed_counts(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


@query("batch_event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def batch_event_counts(spark, d):
    return events.window_counts(table(spark, d, "events"))


@query("embedding_queue", "SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_queue(spark, d):
    return events.unembedded(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


