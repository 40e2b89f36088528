"""Queries over the library: scans, filters, joins, counts, statistics and snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import scoring, text
from scriptorium.operators import library, merge
from scriptorium.plans import adapters as views
from scriptorium.plans.registry import TABLES, query
from scriptorium.storage import table

r6 = lambda c: F.round(c, 6)
NOW = views.AS_OF_TS


def view(spark, d):
    return library.library_view(views.user_library(spark, d), views.papers(spark, d), views.collections(spark, d))


TABLES["library"] = """SELECT u.*, p.title, p.abstract_text, p.year, p.citation_count, p.doi, p.venue, c.name AS collection FROM user_library u JOIN papers p ON p.id = u.paper_id LEFT JOIN collections c ON c.id = u.collection_id"""


@query("scan_papers", "SELECT id, title, year, citation_count, doi, venue FROM papers")
def scan_papers(spark, d):
    return views.papers(spark, d).drop("abstract_text")


@query("library_view", "SELECT paper_id, collection_id, collection, title, is_favorite, is_deleted, read_status FROM library")
def library_view(spark, d):
    return view(spark, d).select("paper_id", "collection_id", "collection", "title", "is_favorite", "is_deleted", "read_status")


@query("inner_join", "SELECT u.paper_id, p.year, p.venue FROM user_library u JOIN papers p ON p.id = u.paper_id")
def inner_join(spark, d):
    return views.user_library(spark, d).join(views.papers(spark, d), F.col("paper_id") == F.col("id")).select("paper_id", "year", "venue")


@query("left_join", "SELECT u.paper_id, c.name FROM user_library u LEFT JOIN collections c ON c.id = u.collection_id + 2")
def left_join(spark, d):
    """Entries with their collection; some have none."""
    return views.user_library(spark, d).join(views.collections(spark, d), F.col("collection_id") + 2 == F.col("id"), "left").select("paper_id", "name")


@query("semi_join", "SELECT id FROM papers WHERE EXISTS (SELECT 1 FROM paper_tags t JOIN tags ON tags.id = t.tag_id WHERE t.paper_id = papers.id AND name LIKE 'NATION_1%')")
def semi_join(spark, d):
    t = views.paper_tags(spark, d).join(views.tags(spark, d), F.col("tag_id") == F.col("id")).filter(F.col("name").like("NATION_1%"))
    return views.papers(spark, d).select("id").join(t.select(F.col("paper_id").alias("id")), "id", "left_semi")


@query("anti_join", "SELECT id FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def anti_join(spark, d):
    """Papers without an embedding; an anti join, as the key is never null."""
    return views.papers(spark, d).select("id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query("unindexed_papers", "SELECT id FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings) AND coalesce(abstract_text, '') <> ''")
def unindexed_papers(spark, d):
    """The embedding queue: papers with a text that no vector covers yet, each once."""
    p = views.papers(spark, d).filter("coalesce(abstract_text, '') <> ''").select("id").dropDuplicates(["id"])
    return p.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query("library_filter", "SELECT paper_id FROM library WHERE collection_id = 2 AND read_status = 'READ'")
def library_filter(spark, d):
    return library.library_filter(view(spark, d), collection_id=2, status="READ").select("paper_id")


SMART = "year>=2010 year<=2022 the tag:nation_1 author:ana"
SMART_SQL = """title ILIKE '%the%' AND year >= 2010 AND year <= 2022 AND EXISTS (SELECT 1 FROM paper_tags t JOIN tags ON tags.id = t.tag_id WHERE t.paper_id = library.paper_id AND name ILIKE '%nation_1%')
  AND EXISTS (SELECT 1 FROM paper_authors a JOIN authors ON authors.id = a.author_id WHERE a.paper_id = library.paper_id AND name ILIKE '%ana%')"""


def named_tags(spark, d):
    return views.paper_tags(spark, d).join(views.tags(spark, d), F.col("tag_id") == F.col("id")).select("paper_id", "name")


def named_authors(spark, d):
    return views.paper_authors(spark, d).join(views.authors(spark, d), F.col("author_id") == F.col("id")).select("paper_id", "name")


@query("smart_query", f"SELECT paper_id, year FROM library WHERE {SMART_SQL}")
def smart_query(spark, d):
    return library.smart_query(view(spark, d), SMART, named_tags(spark, d), named_authors(spark, d)).select("paper_id", "year")


@query("smart_collection", f"SELECT paper_id, year FROM library WHERE {SMART_SQL.replace('%the%', '%e%')} AND NOT is_deleted AND is_favorite")
def smart_collection(spark, d):
    return library.smart_collection(view(spark, d), SMART.replace("the", "e"), named_tags(spark, d), named_authors(spark, d), favorites=True).select("paper_id", "year")


@query("recently_added", f"SELECT paper_id FROM library WHERE added_at >= TIMESTAMP '{NOW}' - INTERVAL 25 DAYS")
def recently_added(spark, d):
    return library.recently(view(spark, d), "added_at", 25, NOW).select("paper_id")


@query("recently_read", f"SELECT paper_id FROM library WHERE read_status = 'READ' AND added_at >= TIMESTAMP '{NOW}' - INTERVAL 24 DAYS")
def recently_read(spark, d):
    return library.recently(view(spark, d), "added_at", 24, NOW).filter(F.col("read_status") == "READ").select("paper_id")


for name, condition in (
    ("unsorted", "coalesce(collection_id, 0) <= 1 AND NOT is_deleted"),
    ("trashed", "is_deleted"),
    ("active", "NOT is_deleted"),
    ("my_publications", "is_mine AND NOT is_deleted"),
    ("favorites", "is_favorite"),
):

    @query(name, f"SELECT paper_id, title FROM library WHERE {condition}")
    def flagged(spark, d, condition=condition):
        return view(spark, d).filter(condition).select("paper_id", "title")


@query("local_search", "SELECT id, citation_count FROM papers WHERE contains(lower(title), 'ring') OR contains(lower(abstract_text), 'ring') OR contains(lower(title), 'heit') OR contains(lower(abstract_text), 'heit') ORDER BY citation_count DESC, id LIMIT 20")
def local_search(spark, d):
    return library.keyword_search(views.papers(spark, d), ["ring", "heit"]).select("id", "citation_count")


@query("lookup_doi", "SELECT id, doi FROM papers WHERE doi IN ('10.1/5', '10.1/17', '10.1/100')")
def lookup_doi(spark, d):
    return views.papers(spark, d).filter(F.col("doi").isin("10.1/5", "10.1/17", "10.1/100")).select("id", "doi")


@query("text_filter", "SELECT id FROM papers WHERE contains(lower(title), 'ing') OR contains(lower(venue), 'src7')")
def text_filter(spark, d):
    return library.text_filter(views.papers(spark, d), "ing", "title").select("id").union(library.text_filter(views.papers(spark, d), "src7", "venue").select("id")).distinct()


@query("year_range", "SELECT id, year FROM papers WHERE year = 0 OR year BETWEEN 2005 AND 2012")
def year_range(spark, d):
    return library.year_range(views.papers(spark, d), 2005, 2012).select("id", "year")


@query("palette_filter", "SELECT id, title AS label FROM papers WHERE contains(lower(title), 'on') OR contains(lower(venue), 'on') ORDER BY title, id LIMIT 15")
def palette_filter(spark, d):
    items = views.papers(spark, d).select("id", F.col("title").alias("label"), F.col("venue").alias("subtitle"))
    return library.palette(items, "on").select("id", "label")


@query("paper_tags", "SELECT paper_id, array_to_string(list(name ORDER BY name), ',') AS tags FROM paper_tags JOIN tags ON tags.id = tag_id GROUP BY paper_id")
def paper_tags(spark, d):
    return named_tags(spark, d).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tags"))


@query("collection_counts", "SELECT c.id, c.name, (SELECT count(*) FROM user_library u WHERE u.collection_id = c.id) AS n FROM collections c")
def collection_counts(spark, d):
    return library.collection_counts(views.collections(spark, d), views.user_library(spark, d))


@query("count_all", "SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM user_library) AS entries, (SELECT count(*) FROM authors) AS authors")
def count_all(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(views.papers(spark, d), "papers").crossJoin(n(views.user_library(spark, d), "entries")).crossJoin(n(views.authors(spark, d), "authors"))


@query("papers_by_year", "SELECT year, n FROM (SELECT year, count(*) AS n FROM papers WHERE year > 1900 GROUP BY year ORDER BY year DESC LIMIT 10) ORDER BY year")
def papers_by_year(spark, d):
    return library.papers_by_year(views.papers(spark, d))


@query("top_venues", "SELECT venue, count(*) AS n FROM papers WHERE coalesce(venue, '') <> '' GROUP BY venue ORDER BY n DESC, venue LIMIT 8")
def top_venues(spark, d):
    return library.top_venues(views.papers(spark, d))


@query("library_stats", f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_favorite) AS favorites, count(*) FILTER (WHERE read_status = 'READ') AS papers_read, round(avg(CASE WHEN read_status = 'READ' THEN 1.0 ELSE 0.0 END) * 100, 6) AS read_percent,
  count(*) FILTER (WHERE added_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS) AS recent, min(year) FILTER (WHERE year > 0) AS first_year, max(year) FILTER (WHERE year > 0) AS last_year, CAST(floor(avg(year) FILTER (WHERE year > 0)) AS BIGINT) AS mean_year FROM library""")  # fmt: skip
def library_stats(spark, d):
    return library.library_stats(view(spark, d), NOW)


@query("result_insights", f"""SELECT rule, CAST(value AS DOUBLE) AS value FROM (SELECT unnest([{{'rule': CASE WHEN dated > 0 AND share >= 70 THEN 'FAST_MOVING' END, 'value': round(share, 6)}},
  {{'rule': CASE WHEN dated > 0 AND share <= 30 AND old > dated // 2 THEN 'MATURE' END, 'value': round(share, 6)}}, {{'rule': CASE WHEN n > 3 AND top >= n // 2 THEN 'LOW_DIVERSITY' END, 'value': CAST(top AS DOUBLE)}},
  {{'rule': CASE WHEN mean >= 100 THEN 'HIGH_IMPACT' END, 'value': round(mean, 6)}}], recursive := true) FROM (SELECT count(*) AS n, count(*) FILTER (WHERE year > 0) AS dated, count(*) FILTER (WHERE year > 0 AND {views.AS_OF_YEAR} - year <= 3) * 100.0 / count(*) FILTER (WHERE year > 0) AS share,
  count(*) FILTER (WHERE year > 0 AND {views.AS_OF_YEAR} - year >= 5) AS old, avg(citation_count) AS mean, (SELECT max(c) FROM (SELECT count(*) AS c FROM papers WHERE coalesce(venue, '') <> '' GROUP BY lower(venue))) AS top FROM papers)) WHERE rule IS NOT NULL""")  # fmt: skip
def result_insights(spark, d):
    return library.result_insights(views.papers(spark, d), views.AS_OF_YEAR)


@query("user_activity", f"""SELECT paper_id, CAST(round(least(1.0, CASE WHEN is_favorite THEN 0.3 ELSE 0 END + CASE read_status WHEN 'READ' THEN 0.4 WHEN 'READING' THEN 0.2 ELSE 0 END + CASE WHEN trim(notes) <> '' THEN 0.2 ELSE 0 END
  + CASE WHEN date_diff('day', CAST(added_at AS DATE), DATE '{NOW[:10]}') BETWEEN 0 AND 90 THEN 0.1 * (1 - date_diff('day', CAST(added_at AS DATE), DATE '{NOW[:10]}') / 90.0) ELSE 0 END), 6) AS DOUBLE) AS score FROM library""")  # fmt: skip
def user_activity(spark, d):
    return view(spark, d).select("paper_id", r6(scoring.user_activity(F.col("is_favorite"), F.col("read_status"), F.col("notes"), F.col("added_at"), F.to_date(F.lit(NOW)))).alias("score"))


@query("recent_searches", "SELECT event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 20")
def recent_searches(spark, d):
    """The newest twenty of one kind of event, as a search log."""
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(kind), "event_type", "left_semi").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts")


# --- snapshots


def incoming(spark, d):
    """Papers as another source has them: some known, some new, with other titles and counts."""
    i = F.col("id")
    p = views.papers(spark, d).filter(i % 3 == 0)
    return p.select((i + F.when(i % 2 == 0, 0).otherwise(1000000)).alias("paper_id"), F.concat(F.lit("New "), "title").alias("title"), F.concat("abstract_text", F.lit(".")).alias("abstract_text"), "year", (F.col("citation_count") + 1).alias("citation_count"), "doi", "venue")


TABLES["incoming"] = "SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 1000000 END AS paper_id, concat('New ', title) AS title, concat(abstract_text, '.') AS abstract_text, year, citation_count + 1 AS citation_count, doi, venue FROM papers WHERE id % 3 = 0"


@query("upsert_papers", """SELECT coalesce(p.id, i.paper_id) AS paper_id, md5(CASE WHEN i.paper_id IS NOT NULL THEN concat(i.title, i.abstract_text) ELSE concat(p.title, p.abstract_text) END) AS digest,
  CAST(CASE WHEN i.paper_id IS NOT NULL THEN i.citation_count ELSE p.citation_count END AS INT) AS citation_count, CASE WHEN p.id IS NOT NULL THEN p.venue ELSE i.venue END AS venue FROM papers p FULL OUTER JOIN incoming i ON i.paper_id = p.id""")  # fmt: skip
def upsert_papers(spark, d):
    merged = merge.upsert_papers(views.papers(spark, d).withColumnRenamed("id", "paper_id"), incoming(spark, d))
    return merged.select("paper_id", F.md5(F.concat("title", "abstract_text")).alias("digest"), "citation_count", "venue")


@query("resolve_identity", """WITH b AS (SELECT paper_id AS new_id, paper_id, CASE WHEN paper_id % 2 = 0 THEN doi END AS doi, replace(title, 'New ', '') AS title, year FROM incoming),
  o AS (SELECT id, id AS paper_id, doi, title, year FROM papers),
  m AS (SELECT new_id, (SELECT min(id) FROM o WHERE o.paper_id = b.paper_id) AS a, (SELECT min(id) FROM o WHERE lower(o.doi) = lower(b.doi)) AS c, (SELECT min(id) FROM o WHERE lower(o.title) = lower(b.title) AND o.year = b.year) AS t FROM b)
  SELECT new_id, coalesce(a, c, t) AS matched_id, CASE WHEN a IS NOT NULL THEN 'PAPER_ID' WHEN c IS NOT NULL THEN 'DOI' WHEN t IS NOT NULL THEN 'TITLE_YEAR' ELSE 'INSERT' END AS rule FROM m""")  # fmt: skip
def resolve_identity(spark, d):
    i = F.col("paper_id")
    new = incoming(spark, d).select(i.alias("new_id"), "paper_id", F.when(i % 2 == 0, F.col("doi")).alias("doi"), F.replace("title", F.lit("New "), F.lit("")).alias("title"), "year")
    return merge.resolve_identity(new, views.papers(spark, d).select("id", F.col("id").alias("paper_id"), "doi", "title", "year"))


def harvested(spark, d):
    """The papers as three sources report them, with blanks that differ."""
    p = views.papers(spark, d)
    i = F.col("id")
    source = lambda n: p.filter(i % (n + 1) == 0).select(F.lit(n).alias("priority"), "id", "doi", "title", F.when(i % 4 != n, F.col("abstract_text")).alias("abstract_text"), F.when(i % 5 != n, F.col("venue")).otherwise("").alias("venue"), F.when(i % 3 != n, F.col("citation_count")).otherwise(0).alias("citation_count"))
    return source(0).union(source(1)).union(source(2))


TABLES["harvested"] = " UNION ALL ".join(f"SELECT {n} AS priority, id, doi, title, CASE WHEN id % 4 <> {n} THEN abstract_text END AS abstract_text, CASE WHEN id % 5 <> {n} THEN venue ELSE '' END AS venue, CASE WHEN id % 3 <> {n} THEN citation_count ELSE 0 END AS citation_count FROM papers WHERE id % {n + 1} = 0" for n in range(3))


@query("federated_merge", """SELECT key, arg_min(id, (priority, id)) AS id, min(priority) AS priority, md5(arg_min(abstract_text, (priority, id)) FILTER (WHERE trim(coalesce(abstract_text, '')) <> '')) AS abstract,
  arg_min(venue, (priority, id)) FILTER (WHERE trim(coalesce(venue, '')) <> '') AS venue, CAST(coalesce(arg_min(citation_count, (priority, id)) FILTER (WHERE citation_count > 0), 0) AS INT) AS citation_count, count(*) AS n_records
  FROM (SELECT *, coalesce('doi:' || nullif(lower(trim(doi)), ''), 'title:' || trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 \t\n\r]', '', 'g'))) AS key FROM harvested) GROUP BY key""")  # fmt: skip
def federated_merge(spark, d):
    return merge.federated_merge(harvested(spark, d)).select("key", "id", "priority", F.md5("abstract_text").alias("abstract"), "venue", "citation_count", "n_records")


@query("enrich_metadata", "SELECT id, coalesce(nullif(trim(doi), ''), concat('10.9/', id)) AS doi, venue FROM papers")
def enrich_metadata(spark, d):
    p = views.papers(spark, d).select("id", "doi", "venue")
    found = p.select("id", F.concat(F.lit("10.9/"), F.col("id").cast("string")).alias("doi"), F.lit("other").alias("venue"))
    return merge.enrich(p, found, ("doi", "venue"))


@query("soft_delete", "SELECT paper_id, is_deleted OR paper_id % 6 = 0 AS is_deleted FROM user_library")
def soft_delete(spark, d):
    u = views.user_library(spark, d).select("paper_id", "is_deleted")
    return merge.set_flag(u, u.filter("paper_id % 6 = 0"), "is_deleted", F.lit(True))


@query("restore", "SELECT paper_id, is_deleted AND paper_id % 2 <> 0 AS is_deleted FROM user_library")
def restore(spark, d):
    u = views.user_library(spark, d).select("paper_id", "is_deleted")
    return merge.set_flag(u, u.filter("paper_id % 2 = 0"), "is_deleted", F.lit(False))


@query("purge", "SELECT paper_id FROM user_library WHERE NOT is_deleted")
def purge(spark, d):
    u = views.user_library(spark, d)
    return u.join(u.filter("is_deleted").select("paper_id"), "paper_id", "left_anti").select("paper_id")


@query("toggle_favorite", "SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM user_library")
def toggle_favorite(spark, d):
    u = views.user_library(spark, d).select("paper_id", "is_favorite")
    return merge.set_flag(u, u.filter("paper_id % 5 = 0"), "is_favorite", ~F.col("is_favorite"))


@query("set_status", "SELECT paper_id, CASE WHEN paper_id % 9 = 0 THEN 'READ' ELSE read_status END AS read_status FROM user_library")
def set_status(spark, d):
    u = views.user_library(spark, d).select("paper_id", "read_status")
    return merge.set_flag(u, u.filter("paper_id % 9 = 0"), "read_status", F.lit("READ"))


@query("move_collection", "SELECT paper_id, CASE WHEN paper_id % 8 = 0 THEN 3 ELSE collection_id END AS collection_id FROM user_library")
def move_collection(spark, d):
    u = views.user_library(spark, d).select("paper_id", "collection_id")
    return merge.set_flag(u, u.filter("paper_id % 8 = 0"), "collection_id", F.lit(3).cast("long"))


@query("delete_collection", "SELECT paper_id, CASE WHEN collection_id <> 4 THEN collection_id END AS collection_id FROM user_library")
def delete_collection(spark, d):
    return merge.delete_collection(views.user_library(spark, d).select("paper_id", "collection_id"), 4)


def gaps_before(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select((i % 500).alias("gap_id"), F.col("value").alias("score"), F.element_at(F.array(*map(F.lit, ("NEW", "SAVED", "DISMISSED", "REVIEWED"))), (i % 4 + 1).cast("int")).alias("status"), i)


TABLES["gap_rows"] = "SELECT event_id % 500 AS gap_id, value AS score, (['NEW', 'SAVED', 'DISMISSED', 'REVIEWED'])[CAST(event_id % 4 + 1 AS INT)] AS status, event_id FROM events"


@query("dedup_best", "SELECT gap_id, round(score, 6) AS score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, event_id) AS n FROM gap_rows) WHERE n = 1")
def dedup_best(spark, d):
    return merge.keep_best(gaps_before(spark, d), "gap_id", "score", "event_id").select("gap_id", r6("score").alias("score"), "event_id")


TABLES["old_gaps"] = "SELECT gap_id, score, status FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY event_id) AS n FROM gap_rows) WHERE n = 1 AND gap_id < 400"
TABLES["new_gaps"] = "SELECT gap_id, score, 'NEW' AS status FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, event_id) AS n FROM gap_rows) WHERE n = 1 AND gap_id >= 100"


@query("upsert_gaps", "SELECT coalesce(n.gap_id, o.gap_id) AS gap_id, round(coalesce(n.score, o.score), 6) AS score, CASE WHEN o.status IN ('SAVED', 'DISMISSED', 'INVESTIGATED') THEN o.status ELSE coalesce(n.status, o.status) END AS status FROM old_gaps o FULL OUTER JOIN new_gaps n ON n.gap_id = o.gap_id")
def upsert_gaps(spark, d):
    rows = gaps_before(spark, d)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("gap_id").orderBy("event_id"))).filter("n = 1 AND gap_id < 400").select("gap_id", "score", "status")
    best = merge.keep_best(rows, "gap_id", "score", "event_id").filter("gap_id >= 100").select("gap_id", "score", F.lit("NEW").alias("status"))
    return merge.upsert_gaps(first, best).withColumn("score", r6("score"))


@query("score_history", "SELECT gap_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY gap_id ORDER BY ts, event_id) AS INT) AS place FROM gap_rows JOIN events USING (event_id)")
def score_history(spark, d):
    rows = gaps_before(spark, d).join(table(spark, d, "events").select("event_id", "ts"), "event_id")
    return rows.select("gap_id", r6("score").alias("score"), F.row_number().over(Window.partitionBy("gap_id").orderBy("ts", "event_id")).alias("place"))


@query("eav_pivot", """SELECT l_orderkey AS item_id, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS field1, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS field2, max(l_quantity) FILTER (WHERE l_linenumber = 3) AS field3 FROM lineitem GROUP BY l_orderkey""")
def eav_pivot(spark, d):
    """Attribute rows to columns, in one aggregate instead of a subquery a field."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_quantity"))
    return rows.select("item_id", *[F.col(str(i)).alias(f"field{i}") for i in (1, 2, 3)])


@query("inverted_abstract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, repeat('w' || CAST(json_extract(props, '$.k') AS VARCHAR) || ' v ', 2) || 'z' AS abstract FROM events")
def inverted_abstract(spark, d):
    """A text from its inverted index, {word: [positions]}, as a bibliographic service returns it."""
    from scriptorium.sources.records import text_of_inverted_index

    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    payload = F.concat(F.lit('{"w'), F.col("k").cast("string"), F.lit('": [0, 2], "v": [1, 3], "z": [4]}'))
    return e.select("event_id", "k", text_of_inverted_index(payload).alias("abstract"))


@query("titles_normalised", "SELECT id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 \t\n\r]', '', 'g')) AS title FROM papers")
def titles_normalised(spark, d):
    return views.papers(spark, d).select("id", text.normal_title(F.col("title")).alias("title"))
