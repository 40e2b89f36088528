"""Queries on research gaps and on evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import scoring
from scriptorium.operators import evaluation, gaps
from scriptorium.plans import adapters as views
from scriptorium.plans.registry import TABLES, query
from scriptorium.plans.text_queries import bm25_topk
from scriptorium.storage import table

r6 = lambda c: F.round(c, 6)
AS_OF = views.AS_OF_ORDERS


def context(spark, d) -> gaps.Context:
    """Orders as papers: clusters by segment and nation, methods by brand and size, tasks by type, links by number; venues and citations are the documents'."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    of = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("paper_id"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("cluster"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = lambda kind, value: F.struct(F.lit(kind).alias("t"), value.alias("v"))
    both = F.array(one("METHOD", F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))), one("TASK", F.col("p_type")))
    entities = lines.select(F.col("l_orderkey").alias("paper_id"), F.explode(both).alias("e")).select("paper_id", F.col("e.t").alias("entity_type"), F.col("e.v").alias("entity_value")).distinct()
    links = orders.filter("o_orderkey <> o_custkey").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    papers = views.papers(spark, d).select(F.col("id").alias("paper_id"), scoring.venue_quality(F.col("venue"), views.VENUES).alias("venue"), F.col("citation_count").cast("long").alias("citations"))
    return gaps.Context(of, entities, views.paper_year(spark, d), links, AS_OF, papers)


TABLES["g_cluster"] = "SELECT o_orderkey AS paper_id, concat(c_mktsegment, '-', c_nationkey) AS cluster FROM orders JOIN customer ON o_custkey = c_custkey"
TABLES["g_entity"] = "SELECT DISTINCT l_orderkey AS paper_id, 'METHOD' AS entity_type, concat(p_brand, '/', p_size) AS entity_value FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT DISTINCT l_orderkey, 'TASK', p_type FROM lineitem JOIN part ON l_partkey = p_partkey"
TABLES["g_link"] = "SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey <> o_custkey"
TABLES["g_size"] = "SELECT cluster, count(DISTINCT paper_id) AS papers FROM g_cluster GROUP BY cluster"
TABLES["g_of"] = "SELECT DISTINCT cluster, entity_type, entity_value FROM g_entity JOIN g_cluster USING (paper_id)"
TABLES["g_method"] = "SELECT cluster, entity_value AS method, count(DISTINCT paper_id) AS papers FROM g_entity JOIN g_cluster USING (paper_id) WHERE entity_type = 'METHOD' GROUP BY 1, 2"
TABLES["g_cross"] = "SELECT least(x.cluster, y.cluster) AS x, greatest(x.cluster, y.cluster) AS y, count(*) AS links FROM g_link JOIN g_cluster x ON x.paper_id = a JOIN g_cluster y ON y.paper_id = b WHERE x.cluster <> y.cluster GROUP BY 1, 2"
TABLES["g_near"] = "SELECT DISTINCT a, cluster AS near FROM (SELECT a, b FROM g_link UNION ALL SELECT b, a FROM g_link) JOIN g_cluster ON paper_id = b"
TABLES["g_bridge"] = "SELECT p.near AS x, q.near AS y, count(DISTINCT p.a) AS bridges FROM g_near p JOIN g_near q ON p.a = q.a AND p.near < q.near LEFT JOIN g_cluster o ON o.paper_id = p.a WHERE o.cluster IS NULL OR (o.cluster <> p.near AND o.cluster <> q.near) GROUP BY 1, 2"
TABLES["g_shared"] = "SELECT p.cluster AS x, q.cluster AS y, count(*) AS shared FROM g_of p JOIN g_of q ON p.entity_type = q.entity_type AND p.entity_value = q.entity_value AND p.cluster < q.cluster GROUP BY 1, 2"
TABLES["g_total"] = "SELECT cluster, count(*) AS n FROM g_of GROUP BY cluster"
TABLES["g_overlap"] = """SELECT p.cluster AS x, q.cluster AS y, p.papers AS papers_x, q.papers AS papers_y, coalesce(shared, 0) AS shared, CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) = 0 THEN 0.0 ELSE coalesce(shared, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(shared, 0)) END AS overlap
  FROM g_size p JOIN g_size q ON p.cluster < q.cluster LEFT JOIN g_shared s ON s.x = p.cluster AND s.y = q.cluster LEFT JOIN g_total a ON a.cluster = p.cluster LEFT JOIN g_total b ON b.cluster = q.cluster"""
TABLES["g_topic"] = """SELECT concat('TOPIC:', x, ':', y) AS gap_id, x, y, least(1.0, 2 * overlap * (1 - density)) AS confidence, overlap AS evidence FROM (SELECT o.*, coalesce(links, 0) / (papers_x * papers_y) AS density FROM g_overlap o LEFT JOIN g_cross c ON c.x = o.x AND c.y = o.y)
  WHERE papers_x >= 3 AND papers_y >= 3 AND overlap >= 0.05 AND density <= 0.10 AND shared > 0"""
TABLES["g_years"] = "SELECT cluster, year, count(*) AS n FROM g_cluster JOIN paper_year USING (paper_id) WHERE year > 0 GROUP BY 1, 2"
TABLES["g_line"] = f"""SELECT cluster, peak, peak_year, last_year, recent, total, CASE WHEN {AS_OF} - last_year >= 3 THEN 'DORMANT' WHEN recent >= 0.8 * peak THEN 'GROWING' WHEN recent >= 0.4 * peak THEN 'STABLE' ELSE 'DECLINING' END AS trend FROM (
  SELECT cluster, max(n) AS peak, arg_min(year, (-n, year)) AS peak_year, max(year) AS last_year, sum(CASE WHEN year BETWEEN {AS_OF - 2} AND {AS_OF} THEN n ELSE 0 END) / 3.0 AS recent, sum(n) AS total FROM g_years GROUP BY cluster)"""
TABLES["g_temporal"] = f"""SELECT concat('TEMPORAL:', cluster) AS gap_id, cluster, trend, CASE WHEN {AS_OF} - last_year >= 3 THEN least(1.0, 0.5 + 0.1 * ({AS_OF} - last_year) + 0.02 * papers) WHEN recent / peak < 0.5 THEN least(1.0, 0.3 + 0.5 * (1 - recent / peak) + 0.01 * papers) END AS confidence, {AS_OF} - last_year >= 3 AS dormant
  FROM g_line JOIN g_size USING (cluster) WHERE papers >= 3 AND peak >= 2"""
TABLES["g_transfer"] = """SELECT concat('METHODOLOGY_TRANSFER:', method, ':', target) AS gap_id, method, source, target, least(1.0, 3 * overlap + papers / 10) AS confidence, overlap AS evidence, papers FROM (SELECT m.method, m.cluster AS source, target, overlap, papers FROM g_method m
  JOIN (SELECT x AS source, y AS target, overlap FROM g_overlap UNION ALL SELECT y, x, overlap FROM g_overlap) w ON w.source = m.cluster WHERE papers >= 2 AND overlap >= 0.03 AND NOT EXISTS (SELECT 1 FROM g_method t WHERE t.cluster = target AND t.method = m.method))"""
TABLES["g_inter"] = """SELECT concat('INTERDISCIPLINARY:', o.x, ':', o.y) AS gap_id, o.x, o.y, least(1.0, 3 * overlap + 0.3 / (coalesce(bridges, 0) + 1)) AS confidence, overlap AS evidence FROM g_overlap o JOIN (SELECT cluster, max(year) - min(year) AS span FROM g_years GROUP BY 1) p ON p.cluster = o.x JOIN (SELECT cluster, max(year) - min(year) AS span FROM g_years GROUP BY 1) q ON q.cluster = o.y
  LEFT JOIN g_bridge b ON b.x = o.x AND b.y = o.y WHERE least(papers_x, papers_y) >= 5 AND least(p.span, q.span) >= 2 AND overlap >= 0.08 AND coalesce(bridges, 0) <= 2"""
TABLES["g_all"] = """SELECT gap_id, gap_type, clusters, confidence, evidence, supporting FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY confidence DESC, clusters) AS n FROM (
  SELECT gap_id, 'TOPIC' AS gap_type, [x, y] AS clusters, confidence, evidence, NULL AS supporting FROM g_topic
  UNION ALL SELECT gap_id, CASE WHEN dormant THEN 'TEMPORAL_DORMANT' ELSE 'TEMPORAL_DECLINING' END, [cluster], confidence, CASE WHEN dormant THEN 0.8 ELSE 0.7 END, NULL FROM g_temporal WHERE confidence IS NOT NULL
  UNION ALL SELECT gap_id, 'METHODOLOGY_TRANSFER', [source, target], confidence, evidence, papers FROM g_transfer UNION ALL SELECT gap_id, 'INTERDISCIPLINARY', [x, y], confidence, evidence, NULL FROM g_inter)) WHERE n = 1"""
TABLES["g_quality"] = "SELECT cluster, count(*) AS papers, coalesce(sum(quality), 0) AS venues, count(quality) AS known, coalesce(sum(citation_count), 0) AS citations FROM (SELECT DISTINCT paper_id, cluster FROM g_cluster) LEFT JOIN (SELECT v.id AS paper_id, quality, citation_count FROM venue_scores v JOIN papers p ON p.id = v.id) USING (paper_id) GROUP BY cluster"
TABLES["g_affects"] = "SELECT gap_id, CAST(sum(papers) AS DOUBLE) AS papers, sum(venues) AS venues, sum(known) AS known, CAST(sum(citations) AS DOUBLE) AS citations FROM (SELECT gap_id, unnest(clusters) AS cluster FROM g_all WHERE gap_type <> 'METHODOLOGY_TRANSFER') JOIN g_quality USING (cluster) GROUP BY gap_id"
TABLES["g_gap_years"] = "SELECT gap_id, year, sum(n) AS n FROM (SELECT gap_id, unnest(CASE WHEN gap_type = 'METHODOLOGY_TRANSFER' THEN clusters[1:1] ELSE clusters END) AS cluster FROM g_all) JOIN g_years USING (cluster) GROUP BY gap_id, year"
TABLES["g_trend"] = f"""SELECT gap_id, CASE WHEN {AS_OF} - last_year >= 3 THEN 'DORMANT' WHEN recent >= 0.8 * peak THEN 'GROWING' WHEN recent >= 0.4 * peak THEN 'STABLE' ELSE 'DECLINING' END AS trend FROM (
  SELECT gap_id, max(n) AS peak, max(year) AS last_year, sum(CASE WHEN year BETWEEN {AS_OF - 2} AND {AS_OF} THEN n ELSE 0 END) / 3.0 AS recent FROM g_gap_years GROUP BY gap_id)"""
EVIDENCE = "CASE WHEN papers > 0 THEN 0.4 * venues / papers + 0.3 * least(1.0, log10(citations + 1.0) / 3) + 0.3 * least(1.0, papers / 20) ELSE 0.0 END"
BOOST = "CASE gap_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gaps.BOOST.items()) + " ELSE 0.5 END"
TREND = "CASE trend " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gaps.TREND.items()) + " ELSE 0.5 END"
SCORE = f"least(100.0, 100 * (0.35 * CASE WHEN coverage IS NULL THEN 0.5 ELSE least(1.0, {BOOST} * (1 - 0.5 * coverage)) END + 0.25 * CASE WHEN evidence IS NULL THEN 0.3 ELSE 0.4 * evidence + 0.3 * least(1.0, supporting / 20) + 0.3 * coalesce(venue, 0.5) END + 0.20 * {TREND} + 0.20 * confidence))"
TABLES["g_scored"] = f"""SELECT gap_id, gap_type, clusters, confidence, papers, round({SCORE} + 1e-9, 6) AS score, round({EVIDENCE} + 1e-9, 6) AS strength FROM (
  SELECT g.gap_id, gap_type, clusters, confidence, evidence, coalesce(papers, 0) AS papers, coalesce(venues, 0) AS venues, coalesce(citations, 0) AS citations, coalesce(supporting, papers, 0) AS supporting, CASE WHEN known > 0 THEN venues / known END AS venue, coalesce(trend, 'DORMANT') AS trend,
    coalesce(papers, 0) / (SELECT count(DISTINCT paper_id) FROM g_cluster) AS coverage FROM g_all g LEFT JOIN g_affects a ON a.gap_id = g.gap_id LEFT JOIN g_trend t ON t.gap_id = g.gap_id)"""


@query("cluster_year", "SELECT cluster, year, n FROM g_years")
def cluster_year(spark, d):
    return gaps.cluster_years(context(spark, d))


@query("cluster_entities", "SELECT cluster, entity_type, count(*) AS n FROM g_of GROUP BY 1, 2")
def cluster_entities(spark, d):
    return gaps.cluster_entities(context(spark, d)).groupBy("cluster", "entity_type").agg(F.count("*").alias("n"))


@query("entity_rows", "SELECT paper_id, entity_type, entity_value FROM paper_entities")
def entity_rows(spark, d):
    return views.paper_entities(spark, d)


@query("method_counts", "SELECT cluster, method, papers FROM g_method")
def method_counts(spark, d):
    return gaps.method_counts(context(spark, d))


@query("cluster_pairs", "SELECT a.cluster AS x, b.cluster AS y, a.papers + b.papers AS papers FROM g_size a JOIN g_size b ON a.cluster < b.cluster")
def cluster_pairs(spark, d):
    return gaps.cluster_pairs(context(spark, d)).select("x", "y", (F.col("papers_x") + F.col("papers_y")).alias("papers"))


@query("cross_cluster_edges", "SELECT x, y, links FROM g_cross")
def cross_cluster_edges(spark, d):
    return gaps.cross_edges(context(spark, d))


@query("bridge_papers", "SELECT x, y, bridges FROM g_bridge")
def bridge_papers(spark, d):
    return gaps.bridge_papers(context(spark, d))


@query("topic_gaps", "SELECT gap_id, round(confidence, 6) AS confidence FROM g_topic")
def topic_gaps(spark, d):
    return gaps.topic_gaps(context(spark, d)).select("gap_id", r6("confidence").alias("confidence"))


@query("timeline_trend", "SELECT cluster, peak, CAST(peak_year AS INT) AS peak_year, CAST(last_year AS INT) AS last_year, CAST(total AS BIGINT) AS total, trend FROM g_line")
def timeline_trend(spark, d):
    return gaps.timelines(context(spark, d)).select("cluster", "peak", "peak_year", "last_year", "total", "trend")


@query("peak_year", "SELECT cluster, CAST(peak_year AS INT) AS peak_year FROM g_line")
def peak_year(spark, d):
    return gaps.timelines(context(spark, d)).select("cluster", "peak_year")


@query("recent_avg", "SELECT cluster, CAST(round(recent, 6) AS DOUBLE) AS recent FROM g_line")
def recent_avg(spark, d):
    return gaps.timelines(context(spark, d)).select("cluster", r6("recent").alias("recent"))


@query("temporal_gaps", "SELECT gap_id, trend, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM g_temporal WHERE confidence IS NOT NULL")
def temporal_gaps(spark, d):
    return gaps.temporal_gaps(context(spark, d)).select("gap_id", "trend", r6("confidence").alias("confidence"))


@query("method_transfer", "SELECT gap_id, source, round(confidence, 6) AS confidence FROM g_transfer")
def method_transfer(spark, d):
    return gaps.method_transfer(context(spark, d)).select("gap_id", "source", r6("confidence").alias("confidence"))


@query("interdisciplinary_gaps", "SELECT gap_id, round(confidence, 6) AS confidence FROM g_inter")
def interdisciplinary_gaps(spark, d):
    return gaps.interdisciplinary_gaps(context(spark, d)).select("gap_id", r6("confidence").alias("confidence"))


@query("research_gaps", "SELECT gap_id, gap_type, array_to_string(clusters, ',') AS clusters, round(confidence, 6) AS confidence FROM g_all")
def research_gaps(spark, d):
    return gaps.all_gaps(context(spark, d)).select("gap_id", "gap_type", F.array_join("clusters", ",").alias("clusters"), r6("confidence").alias("confidence"))


BANDS = "CASE WHEN strength >= 0.7 THEN 'HIGH' WHEN strength >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
SEVERITY = "CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


def scored(spark, d):
    c = context(spark, d)
    return gaps.evaluated(c, gaps.all_gaps(c))


@query("evaluate_gaps", f"SELECT gap_id, gap_type, round(confidence, 6) AS confidence, CAST(papers AS BIGINT) AS papers, CAST(score AS DOUBLE) AS score, {SEVERITY} AS severity, {BANDS} AS evidence, score >= 20 AS is_opportunity, CAST(CASE WHEN papers > 0 THEN 1 ELSE 0 END AS DOUBLE) AS readiness FROM g_scored")
def evaluate_gaps(spark, d):
    return scored(spark, d)


@query("gap_filter", "SELECT gap_id, CAST(score AS DOUBLE) AS score FROM g_scored WHERE score >= 20 AND gap_type = 'TOPIC'")
def gap_filter(spark, d):
    return scored(spark, d).filter(F.col("is_opportunity") & (F.col("gap_type") == "TOPIC")).select("gap_id", "score")


@query("gap_type_counts", f"SELECT k AS gap_type, (SELECT count(*) FROM g_all WHERE gap_type = k) AS n FROM (SELECT unnest({list(gaps.BOOST)}) AS k)")
def gap_type_counts(spark, d):
    return gaps.type_counts(gaps.all_gaps(context(spark, d)))


@query("gap_summary", """SELECT gap_id, concat(replace(CASE gap_type WHEN 'TOPIC' THEN 'Few links join %s' WHEN 'TEMPORAL_DORMANT' THEN 'Work on %s has stopped' WHEN 'TEMPORAL_DECLINING' THEN 'Work on %s has slowed' WHEN 'METHODOLOGY_TRANSFER' THEN 'A method may move between %s' WHEN 'INTERDISCIPLINARY' THEN 'Little bridges %s' ELSE 'Unexplored: %s' END, '%s', array_to_string(clusters, ' and ')), ' (confidence ', CAST(round(round(confidence, 6) * 100) AS BIGINT), '%).') AS summary FROM g_all WHERE gap_type <> 'METHODOLOGY_TRANSFER'""")
def gap_summary(spark, d):
    g = gaps.all_gaps(context(spark, d)).filter(F.col("gap_type") != "METHODOLOGY_TRANSFER")
    return g.select("gap_id", gaps.summary(F.col("gap_type"), F.col("clusters"), r6("confidence")).alias("summary"))


@query("method_links", "SELECT a, b, methods FROM (SELECT p.paper_id AS a, q.paper_id AS b, count(*) AS methods FROM g_entity p JOIN g_entity q ON p.entity_type = 'METHOD' AND q.entity_type = 'METHOD' AND p.entity_value = q.entity_value AND p.paper_id < q.paper_id GROUP BY 1, 2) m WHERE NOT EXISTS (SELECT 1 FROM g_link WHERE least(g_link.a, g_link.b) = m.a AND greatest(g_link.a, g_link.b) = m.b) ORDER BY a, b LIMIT 20")
def method_links(spark, d):
    """The first twenty pairs, as the report has them."""
    return gaps.method_links(context(spark, d), 20).orderBy("a", "b").limit(20)


@query("opportunity_score", f"SELECT event_id, CAST(round({SCORE}, 6) AS DOUBLE) AS score FROM (SELECT event_id, ({list(gaps.BOOST)})[CAST(event_id % 5 + 1 AS INT)] AS gap_type, event_id % 100 / 100.0 AS confidence, CASE WHEN event_id % 10 <> 9 THEN event_id % 10 / 10.0 END AS coverage, CASE WHEN event_id % 6 <> 5 THEN event_id % 6 / 6.0 END AS evidence, event_id % 25 AS supporting, CASE WHEN event_id % 7 <> 6 THEN event_id % 7 / 7.0 END AS venue, (['GROWING', 'STABLE', 'DECLINING', 'DORMANT', NULL])[CAST(event_id % 5 + 1 AS INT)] AS trend FROM events)")
def opportunity_score(spark, d):
    """The formula over all its cases, made from events."""
    i = F.col("event_id")
    pick = lambda options, n: F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (i % n + 1).cast("int"))
    some = lambda n: F.when(i % n != n - 1, i % n / float(n))
    s = gaps.opportunity_score(pick(gaps.BOOST, 5), i % 100 / 100.0, some(10), some(6), i % 25, some(7), pick(("GROWING", "STABLE", "DECLINING", "DORMANT", None), 5))
    return table(spark, d, "events").select("event_id", r6(s).alias("score"))


@query("evidence_strength", f"SELECT cluster, CASE WHEN e >= 0.7 THEN 'HIGH' WHEN e >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS evidence, CAST(e AS DOUBLE) AS value FROM (SELECT cluster, round({EVIDENCE}, 6) AS e FROM g_quality)")
def evidence_strength(spark, d):
    """Of each cluster's papers, by venues and citations."""
    e = r6(gaps.evidence_value(F.col("papers"), F.col("venues"), F.col("citations")))
    rows = gaps.cluster_quality(context(spark, d)).select("cluster", e.alias("value"))
    return rows.select("cluster", scoring.evidence_band(F.col("value")).alias("evidence"), "value")


# --- evaluation


@query("ir_metrics", """SELECT query_id, CAST(coalesce(max(CASE WHEN id % 5 = 0 THEN 1.0 / rank END), 0) AS DOUBLE) AS reciprocal_rank, count(*) FILTER (WHERE id % 2 = 0 AND rank <= 5) / 5 AS p5,
  round(sum(CASE WHEN id % 2 = 0 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 2)) FROM range(6) t(i)), 6) AS ndcg10 FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm25_scores) WHERE rank <= 10 GROUP BY query_id""".replace("CAST(coalesce(max(CASE WHEN id % 5 = 0 THEN 1.0 / rank END), 0) AS DOUBLE)", "round(coalesce(max(CASE WHEN id % 5 = 0 THEN CAST(1 AS DOUBLE) / rank END), 0), 6)"))  # fmt: skip
def ir_metrics(spark, d):
    """Metrics of the BM25 ranking against judgements made from ids."""
    ranked = bm25_topk(spark, d).select("query_id", "rank", (F.col("id") % 5 == 0).alias("is_target"), (F.col("id") % 2 == 0).alias("relevant"))
    return evaluation.ir_metrics(ranked).select("query_id", r6("reciprocal_rank").alias("reciprocal_rank"), "p5", r6("ndcg10").alias("ndcg10"))


TABLES["e_cells"] = "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2"
TABLES["e_by"] = "SELECT k, (SELECT coalesce(sum(n), 0) FROM e_cells WHERE truth = k) AS t, (SELECT coalesce(sum(n), 0) FROM e_cells WHERE predicted = k) AS p, (SELECT coalesce(sum(n), 0) FROM e_cells WHERE truth = k AND predicted = k) AS h FROM (SELECT truth AS k FROM e_cells UNION SELECT predicted FROM e_cells)"
TABLES["e_rates"] = "SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0 END AS precision, CASE WHEN t > 0 THEN h / t ELSE 0 END AS recall FROM e_by"


@query("confusion_matrix", "SELECT truth, predicted, n FROM e_cells")
def confusion_matrix(spark, d):
    return evaluation.confusion(table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))


@query("classification_metrics", """SELECT CAST(n AS BIGINT) AS n, round(h / n, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, round((h / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa
  FROM (SELECT CAST(sum(t) AS DOUBLE) AS n, sum(h) AS h, sum(t * p) AS c, avg(precision) AS pr, avg(recall) AS rc, avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END) AS f FROM e_rates)""")  # fmt: skip
def classification_metrics(spark, d):
    m = evaluation.classification_metrics(table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "kappa")])


@query("gap_precision", "SELECT event_type, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS precision, round(avg(event_id % 100 / 100.0), 6) AS confidence FROM events GROUP BY event_type")
def gap_precision(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") > 10).alias("is_relevant"), (F.col("event_id") % 100 / 100.0).alias("confidence"))
    return evaluation.precision_and_confidence(rows, "event_type").select("event_type", r6("precision").alias("precision"), r6("confidence").alias("confidence"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return evaluation.bootstrap_ci(table(spark, d, "labels").select(F.col("quality").cast("double").alias("x")))


@query("permutation_test")
def permutation_test(spark, d):
    return evaluation.permutation_test(table(spark, d, "labels").select((F.col("quality") - F.col("toxic")).cast("double").alias("x")))
