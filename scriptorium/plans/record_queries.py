"""Queries over annotations, edits, caches, debounced runs and small text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.functions import scoring, text
from scriptorium.operators import cluster, entities, gaps, graph, lexical, records
from scriptorium.plans import adapters as views
from scriptorium.plans import gap_queries, graph_queries, text_queries
from scriptorium.plans.registry import TABLES, query
from scriptorium.sources import records as readers
from scriptorium.storage import saved, scratch_path, table

r6 = lambda c: F.round(c, 6)


# --- texts


@query("classifier_tokens", f"""SELECT id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(list_sort(w), ' ')) AS digest FROM (SELECT id, list_distinct(list_filter(string_split_regex(lower(coalesce(abstract_text, '')), '[^a-z0-9-]+'), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(repr(w) for w in config.STOP_WORDS)}))) AS w FROM papers)""")
def classifier_tokens(spark, d):
    """The distinct words that the relationship classifier compares."""
    w = views.papers(spark, d).select("id", text.classifier_tokens(F.col("abstract_text")).alias("w"))
    return w.select("id", F.size("w").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("digest"))


@query("clean_author", r"SELECT id, trim(regexp_replace(regexp_replace(concat('<b>', name, '</b>  <i>', id, '</i> '), '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS name FROM authors")
def clean_author(spark, d):
    a = views.authors(spark, d)
    return a.select("id", text.clean_author(F.concat(F.lit("<b>"), "name", F.lit("</b>  <i>"), F.col("id").cast("string"), F.lit("</i> "))).alias("name"))


@query("truncate", "SELECT id, CASE WHEN length(title) > 40 THEN concat(substring(title, 1, 40), '...') ELSE title END AS title FROM papers")
def truncate(spark, d):
    return views.papers(spark, d).select("id", text.truncated(F.col("title"), 40).alias("title"))


@query("format_duration", "SELECT event_id, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS duration FROM (SELECT event_id, CAST(event_id * 37 % 20000 AS BIGINT) AS s FROM events)")
def format_duration(spark, d):
    return table(spark, d, "events").select("event_id", scoring.duration(F.col("event_id") * 37 % 20000).alias("duration"))


@query("bands", """SELECT event_id, CASE WHEN value >= 75 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN value / 100 >= 0.7 THEN 'HIGH' WHEN value / 100 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS evidence,
  CASE WHEN value >= 80 THEN 'Excellent' WHEN value >= 60 THEN 'Strong' WHEN value >= 40 THEN 'Moderate' ELSE 'Weak' END AS strength FROM events""")  # fmt: skip
def bands(spark, d):
    """Labels of scores: severity, evidence and strength."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", scoring.severity(v).alias("severity"), scoring.evidence_band(v / 100).alias("evidence"), scoring.strength(v).alias("strength"))


@query("custom_weights", f"SELECT b.query_id, b.id, CAST(round(least(100.0, 0.5 * percent + 0.25 * 100 * coalesce(cosine, 0) + 0.25 * {text_queries.CITED_SCORE}), 6) AS DOUBLE) AS score FROM bm25_percent b LEFT JOIN tfidf_cosines c ON c.query_id = b.query_id AND c.id = b.id JOIN papers p ON p.id = b.id")
def custom_weights(spark, d):
    """The composite rank with the user's own weights, which are divided by their sum."""
    rows = entities.composite_rank(views.papers(spark, d), text_queries.scored(spark, d), views.AS_OF_YEAR, weights={"bm25": 2.0, "cosine": 1.0, "citation": 1.0})
    return rows.select("query_id", "id", r6("score").alias("score"))


# --- records


TABLES["annotations"] = "SELECT event_id AS id, event_id % 50 AS pdf_id, event_id * 7 % 9 AS page, value AS y FROM events"


def annotations(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), (i % 50).alias("pdf_id"), (i * 7 % 9).alias("page"), F.col("value").alias("y"))


@query("annotation_reads", "SELECT id, pdf_id, page, CAST(row_number() OVER (PARTITION BY pdf_id ORDER BY page, y, id) AS INT) AS place FROM annotations")
def annotation_reads(spark, d):
    return records.annotations_of(annotations(spark, d)).select("id", "pdf_id", "page", "place")


@query("annotation_page", "SELECT id, CAST(row_number() OVER (ORDER BY y, id) AS INT) AS place FROM annotations WHERE pdf_id = 7 AND page = 4")
def annotation_page(spark, d):
    return records.annotations_of(annotations(spark, d), 7, 4).select("id", "place")


@query("label_detail", "SELECT id, 'far' AS zoom FROM scores WHERE importance >= 0.6 OR id % 50 = 0 UNION ALL SELECT id, 'middle' FROM scores WHERE importance >= 0.25 OR id % 50 = 0 UNION ALL SELECT id, 'near' FROM scores")
def label_detail(spark, d):
    """Which nodes show their label at three zooms."""
    s = graph_queries.scores(spark, d).select("id", "importance", (F.col("id") % 50 == 0).alias("is_anchor"))
    at = lambda zoom, name: records.labelled_nodes(s, zoom).select("id", F.lit(name).alias("zoom"))
    return at(0.3, "far").union(at(0.6, "middle")).union(at(1.0, "near"))


@query("idea_entries", "SELECT query_id, id, is_favorite, read_status FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, id) AS n FROM tfidf_cosines) JOIN user_library ON paper_id = id WHERE n <= 20 AND NOT is_deleted")
def idea_entries(spark, d):
    """The nearest papers of an idea as entries of the library; papers that are not in it drop out."""
    from scriptorium.operators import lexical

    best = lexical.topk(text_queries.cosines(spark, d, 20).withColumn("cosine", r6("cosine")), 20, "cosine")
    own = views.user_library(spark, d).filter(~F.col("is_deleted")).select(F.col("paper_id").alias("id"), "is_favorite", "read_status")
    return best.join(own, "id").select("query_id", "id", "is_favorite", "read_status")


TABLES["edits"] = "SELECT id, CASE WHEN id % 6 = 0 THEN concat('T', id) END AS title, CASE WHEN id % 4 = 0 THEN 1999 END AS year FROM papers WHERE id % 2 = 0"


@query("edit_metadata", "SELECT p.id, coalesce(e.title, p.title) AS title, CAST(coalesce(e.year, p.year) AS INT) AS year, venue FROM papers p LEFT JOIN edits e ON e.id = p.id")
def edit_metadata(spark, d):
    p = views.papers(spark, d).select("id", "title", "year", "venue")
    i = F.col("id")
    edits = p.filter(i % 2 == 0).select("id", F.when(i % 6 == 0, F.concat(F.lit("T"), i.cast("string"))).alias("title"), F.when(i % 4 == 0, 1999).alias("year"))
    return records.edit_metadata(p, edits, ("title", "year"))


@query("replace_authors", "SELECT paper_id, CAST(author_order AS BIGINT) AS author_order, name FROM paper_authors JOIN authors ON author_id = id WHERE paper_id % 3 <> 0 UNION ALL SELECT paper_id, CAST(n AS BIGINT), concat('Editor ', n) FROM (SELECT DISTINCT paper_id FROM paper_authors WHERE paper_id % 3 = 0), range(1, 3) t(n)")
def replace_authors(spark, d):
    rows = views.paper_authors(spark, d).join(views.authors(spark, d), F.col("author_id") == F.col("id")).select("paper_id", F.col("author_order").cast("long").alias("author_order"), "name")
    edited = rows.filter("paper_id % 3 = 0").select("paper_id").distinct().withColumn("names", F.array(F.lit("Editor 1"), F.lit("Editor 2")))
    return records.replace_authors(rows, edited)


@query("upsert_vectors", "SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new' ELSE 'old' END AS origin, CAST(len(v) AS BIGINT) AS dims FROM vectors UNION ALL SELECT id + 1000000, 'new', CAST(len(v) AS BIGINT) FROM vectors WHERE id % 3 = 0 AND id % 2 <> 0")
def upsert_vectors(spark, d):
    """Vectors computed again: newer ones of known papers replace, older ones don't, those of new papers are added."""
    old = views.vectors(spark, d).select("id", F.lit("m1").alias("model"), "v", F.lit(5).alias("at"))
    i = F.col("id")
    new = old.filter(i % 3 == 0).select(F.when(i % 2 == 0, i).otherwise(i + 1000000).alias("id"), "model", "v", F.lit(6).alias("at"))
    late = old.filter(i % 5 == 0).withColumn("at", F.lit(4))
    merged = records.upsert_vectors(old, new.unionByName(late))
    return merged.select("id", F.when(F.col("at") == 6, "new").otherwise("old").alias("origin"), F.size("v").cast("long").alias("dims"))


@query("entity_cache", f"""SELECT id, 'TASK' AS entity_type, 'cached' AS entity_value FROM papers WHERE id % 4 = 0 UNION ALL SELECT DISTINCT id, entity_type, entity_value FROM ({' UNION ALL '.join(text_queries.entity_sql(*r) for r in config.ENTITY_RULES)}) WHERE id % 4 > 1""")
def entity_cache(spark, d):
    """A quarter of the papers is cached with an entity, a quarter as having none; the others are computed."""
    docs = text_queries.docs(spark, d)
    i = F.col("id")
    cache = docs.filter(i % 4 <= 1).select("id", F.when(i % 4 == 0, "TASK").alias("entity_type"), F.when(i % 4 == 0, "cached").alias("entity_value"))
    return records.cached_entities(docs, cache, entities.extract)


# --- runs and imports


@query("debounced_runs", """SELECT event_type AS source, min(ts) AS first_at, max(ts) + INTERVAL 1 HOUR AS run_at, count(*) AS changes FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_id, event_type, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY event_type, run""")  # fmt: skip
def debounced_runs(spark, d):
    """Changes by kind of event; an hour stands for the seconds that a desktop waits, as events lie further apart."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    out = records.debounced(rows, "1 hour")
    return out.select("source", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("run_at").cast("timestamp_ntz").alias("run_at"), "changes")


@query("bibtex_fallback", "SELECT concat('k', id) AS cite_key, trim(regexp_replace(title, '[^\\p{L}\\p{N}.,-]+', ' ', 'g')) AS title, year, doi FROM papers")
def bibtex_fallback(spark, d):
    """Entries read by regular expressions alone, as where the strict parser gives up: here the closing brace is missing."""
    p = views.papers(spark, d).withColumn("title", F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}.,-]+", " ")))
    lines = F.concat(F.lit("@article{k"), F.col("id").cast("string"), F.lit(",\n title = {"), F.coalesce("title", F.lit("")), F.lit("},\n year = "), F.col("year").cast("string"), F.coalesce(F.concat(F.lit(',\n doi = "'), "doi", F.lit('"')), F.lit("")), F.lit("\n"))
    return readers.bibtex_lenient(p.select(lines.alias("value"))).select("cite_key", "title", "year", "doi")


@query("local_ingest", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(year) AS BIGINT) AS years, count(doi) AS dois FROM papers")
def local_ingest(spark, d):
    """Records that a browser posts, one JSON object a line in a watched folder, read by a stream and counted."""
    folder, out = scratch_path(spark, "posted"), scratch_path(spark, "ingested")
    views.papers(spark, d).select("title", "year", "doi", F.col("venue").alias("journal")).write.json(folder)
    readers.ingest_posted(spark, folder, out, scratch_path(spark, "ingest-state"))
    rows = spark.read.parquet(out)
    return rows.agg(F.count("*").alias("n"), F.sum("year").cast("long").alias("years"), F.count("doi").alias("dois"))


# --- knowledge and gaps


@query("knowledge_context", """WITH e AS (SELECT DISTINCT cluster, entity_type, entity_value FROM g_entity JOIN g_cluster USING (paper_id)), k AS (SELECT cluster, count(*) AS entities, count(*) FILTER (WHERE entity_type = 'METHOD') AS methods FROM e GROUP BY cluster),
  y AS (SELECT cluster, min(year) AS first_year, max(year) AS last_year FROM paper_year JOIN g_cluster USING (paper_id) GROUP BY cluster), l AS (SELECT x.cluster AS ca, z.cluster AS cb FROM orders JOIN g_cluster x ON x.paper_id = o_orderkey JOIN g_cluster z ON z.paper_id = o_custkey WHERE o_orderkey <> o_custkey),
  i AS (SELECT ca AS cluster, count(*) AS n FROM l WHERE ca = cb GROUP BY ca), o AS (SELECT cluster, count(*) AS n FROM (SELECT ca AS cluster FROM l WHERE ca <> cb UNION ALL SELECT cb FROM l WHERE ca <> cb) GROUP BY cluster)
  SELECT s.cluster, papers, coalesce(entities, 0) AS entities, coalesce(methods, 0) AS methods, first_year, last_year, coalesce(i.n, 0) AS inner_links, coalesce(o.n, 0) AS outer_links FROM (SELECT cluster, count(DISTINCT paper_id) AS papers FROM g_cluster GROUP BY cluster) s
  LEFT JOIN k ON k.cluster = s.cluster LEFT JOIN y ON y.cluster = s.cluster LEFT JOIN i ON i.cluster = s.cluster LEFT JOIN o ON o.cluster = s.cluster""")  # fmt: skip
def knowledge_context(spark, d):
    c = gap_queries.context(spark, d)
    return records.knowledge(c.cluster, c.entities, c.years, c.edges)


@query("uncertainty", """SELECT g.gap_id, f.factor, f.direction, round(CAST(f.impact AS DOUBLE), 6) AS impact FROM (SELECT t.gap_id, unnest(list_filter([{'factor': 'OVERLAP', 'direction': 'STRENGTHENS', 'impact': least(1.0, overlap)},
  CASE WHEN shared >= 3 THEN {'factor': 'SHARED_CONCEPTS', 'direction': 'STRENGTHENS', 'impact': least(1.0, shared / 10.0)} END, CASE WHEN coalesce(links, 0) <= 1 THEN {'factor': 'FEW_CROSS_LINKS', 'direction': 'STRENGTHENS', 'impact': 0.8} END,
  CASE WHEN x.papers < 5 OR y.papers < 5 THEN {'factor': 'SMALL_CLUSTER', 'direction': 'WEAKENS', 'impact': 0.4} END], lambda u: u IS NOT NULL)) AS f FROM g_topic t JOIN g_overlap o ON o.x = t.x AND o.y = t.y LEFT JOIN g_cross c ON c.x = t.x AND c.y = t.y JOIN g_size x ON x.cluster = t.x JOIN g_size y ON y.cluster = t.y) g""")  # fmt: skip
def uncertainty(spark, d):
    """What strengthens or weakens each topic gap."""
    c = gap_queries.context(spark, d)
    rows = gaps.topic_gaps(c).select("gap_id", "x", "y").join(gaps.entity_overlap(c), ["x", "y"]).join(gaps.cross_edges(c), ["x", "y"], "left")
    factors = records.uncertainty_factors(F.col("shared"), F.col("overlap"), F.coalesce("links", F.lit(0)), F.col("papers_x"), F.col("papers_y"))
    return rows.select("gap_id", F.explode(factors).alias("f")).select("gap_id", "f.factor", "f.direction", r6("f.impact").alias("impact"))


TABLES["edge_terms"] = """SELECT src, dst, array_to_string(list(term ORDER BY place), ', ') AS terms FROM (SELECT src, dst, x.term, row_number() OVER (PARTITION BY src, dst ORDER BY round(least(x.weight, y.weight), 6) DESC, x.term) AS place FROM edges JOIN weights x ON x.id = src JOIN weights y ON y.id = dst AND y.term = x.term) WHERE place <= 3 GROUP BY src, dst"""
TABLES["edge_common"] = "SELECT e.src, e.dst, count(DISTINCT x.b) AS common FROM edges e JOIN both_ways x ON x.a = e.src AND x.type <> 'RELATED' JOIN both_ways y ON y.a = e.dst AND y.b = x.b AND y.type <> 'RELATED' GROUP BY e.src, e.dst"
TABLES["edge_authors"] = "SELECT DISTINCT src, dst, true AS same FROM edges JOIN paper_authors x ON x.paper_id = src JOIN paper_authors y ON y.paper_id = dst AND y.author_id = x.author_id"


@query("edge_facts", """SELECT e.src, e.dst, CAST(round(weight * 100) AS BIGINT) AS percent, coalesce(terms, '') AS terms, coalesce(same, false) AS same_authors, coalesce(common, 0) AS common, concat(CASE type WHEN 'RELATED' THEN 'is related' WHEN 'EXTENDS' THEN 'extends' WHEN 'SUPPORTS' THEN 'supports' WHEN 'CONTRADICTS' THEN 'contradicts' ELSE 'shares methods' END,
  CASE WHEN terms IS NOT NULL THEN concat('; terms ', terms) ELSE '' END, CASE WHEN same THEN '; same authors' ELSE '' END, CASE WHEN common > 0 THEN concat('; neighbours ', common) ELSE '' END) AS reason FROM edges e LEFT JOIN edge_terms t ON t.src = e.src AND t.dst = e.dst LEFT JOIN edge_common c ON c.src = e.src AND c.dst = e.dst LEFT JOIN edge_authors a ON a.src = e.src AND a.dst = e.dst""")  # fmt: skip
def edge_facts(spark, d):
    """Why two papers are linked: similarity, the terms that weigh most in both, authors, common neighbours; and the reason in words."""
    e = saved(views.edges(spark, d), "edges")
    pair = ["src", "dst"]
    linked = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    met = lambda weights, n: cluster.shared_lists(weights, linked, n).select(F.col("a").alias("src"), F.col("b").alias("dst"), "terms")
    terms = met(lexical.weighted_terms(graph_queries.words_of(spark, d), cluster.ends_of(linked)), 3).withColumn("terms", F.array_join("terms", ", "))
    own = views.paper_authors(spark, d).select(F.col("paper_id").alias("id"), F.col("author_id").cast("string").alias("term"), F.lit(1.0).alias("weight")).filter("term IS NOT NULL").distinct()
    same = met(own, 1).select(*pair, F.lit(True).alias("same"))
    rows = e.join(terms, pair, "left").join(same, pair, "left").join(graph.common_neighbours(e), pair, "left")
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in graph.VERBS.items() for x in kv]), F.col("type"))
    part = lambda when, *text: F.when(when, F.concat(*text)).otherwise("")
    reason = F.concat(verb, part(F.col("terms").isNotNull(), F.lit("; terms "), F.col("terms")), part(F.col("same"), F.lit("; same authors")), part(F.col("common") > 0, F.lit("; neighbours "), F.col("common").cast("string")))
    return rows.select(*pair, F.round(F.col("weight") * 100).cast("long").alias("percent"), F.coalesce("terms", F.lit("")).alias("terms"), F.coalesce("same", F.lit(False)).alias("same_authors"), F.coalesce("common", F.lit(0)).cast("long").alias("common"), reason.alias("reason"))


@query("largest_jump", "SELECT id, CAST(arg_min(i, (-(h - before), i)) AS INT) AS place FROM (SELECT id, i, h, lag(h) OVER (PARTITION BY id ORDER BY i) AS before FROM (SELECT o_custkey AS id, o_totalprice AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i FROM orders)) WHERE before IS NOT NULL GROUP BY id")
def largest_jump(spark, d):
    """The first largest difference of successive heights, as it cuts a tree of merges; here of a customer's prices."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("h"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("i"))
    return cluster.jumps(o, "id", "i", "h").select("id", F.col("i").alias("place"))


@query("cite_graph_degree", "SELECT a AS id, count(*) AS links, round(sum(weight), 6) AS degree FROM both_ways GROUP BY a")
def cite_graph_degree(spark, d):
    return graph.degree(views.edges(spark, d)).select("id", "links", r6("degree").alias("degree"))
