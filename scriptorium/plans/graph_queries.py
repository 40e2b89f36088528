"""Queries over vectors, graphs, relationships and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.functions import scoring, text, vectors
from scriptorium.operators import cluster, frontiers, graph, lexical, relations, signals
from scriptorium.operators import vectors as joins
from scriptorium.plans import adapters as views
from scriptorium.plans.registry import TABLES, query
from scriptorium.storage import saved, spread, table

r6 = lambda c: F.round(c, 6)
DIRECTED = ", ".join(f"'{t}'" for t in graph.DIRECTED)


# --- vectors


@query("vector_cosine", "SELECT a, b, round(similarity, 6) AS cosine FROM cosines WHERE similarity >= 0.25")
def vector_cosine(spark, d):
    """Pairs of vectors with a cosine of at least 0.25, by tiles."""
    return joins.pairs_above(views.vectors(spark, d), 0.25).select("a", "b", r6("similarity").alias("cosine"))


@query("vector_topk", "SELECT query_id, id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT a AS query_id, b AS id, round(similarity, 6) AS similarity FROM cosines UNION ALL SELECT b, a, round(similarity, 6) FROM cosines)) WHERE rank <= 10")
def vector_topk(spark, d):
    """The ten nearest of every vector, ranked at six places."""
    v = views.vectors(spark, d)
    near = joins.cosine_topk(v, v, 20).withColumn("similarity", r6("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank).filter("rank <= 10").select("query_id", "id", "similarity", "rank")


@query("recommend", "SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT a AS query_id, b AS id, round(similarity, 6) AS similarity FROM cosines UNION ALL SELECT b, a, round(similarity, 6) FROM cosines) WHERE similarity >= 0.3) WHERE rank <= 3")
def recommend(spark, d):
    v = views.vectors(spark, d)
    near = joins.cosine_topk(v, v, 10).withColumn("similarity", r6("similarity")).filter("similarity >= 0.3")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank).filter("rank <= 3").select("query_id", "id", "rank")


@query("l2_normalise", "SELECT id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM vectors")
def l2_normalise(spark, d):
    n = views.vectors(spark, d).select("id", vectors.l2_normalise(F.col("v")).alias("v"))
    return n.select("id", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.col("v")[0]).alias("first"))


@query("label_cosine", "SELECT id, round(greatest(0.0, least(1.0, list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))))), 6) AS cosine FROM vectors JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i) GROUP BY label) USING (label)")
def label_cosine(spark, d):
    """The clamped cosine of each vector and its cluster's centroid."""
    v = views.vectors(spark, d)
    c = joins.centroids(v, "label")
    return v.join(c, "label").select("id", r6(vectors.cosine(F.col("v"), F.col("centroid"), clamp=True)).alias("cosine"))


@query("centroid", "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i")
def centroid(spark, d):
    c = joins.centroids(views.vectors(spark, d), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", r6("m").alias("m"))


@query("neural_rescale", "SELECT a, b, CASE WHEN similarity <= 0.4 THEN 0.0 ELSE round(pow((similarity - 0.4) / 0.6, 2), 6) END AS weight FROM cosines".replace("THEN 0.0", "THEN CAST(0 AS DOUBLE)"))
def neural_rescale(spark, d):
    """Every pair of vectors: the score has no threshold of its own, a cosine of up to 0.4 counts as nothing."""
    pairs = joins.pairs_above(views.vectors(spark, d), -2.0)
    return pairs.select("a", "b", r6(scoring.rescaled(F.col("similarity"))).alias("weight"))


# --- signals of pairs


def jaccard_sql(x, y):
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


TABLES["author_sets"] = "SELECT paper_id, list_distinct(list(lower(name))) AS names FROM paper_authors JOIN authors ON author_id = id GROUP BY paper_id"
TABLES["tag_sets"] = "SELECT paper_id, list_distinct(list(lower(name))) AS names FROM paper_tags JOIN tags ON tag_id = id GROUP BY paper_id"


SIGNAL_SETS = {"citation": ("lineitem", "l_orderkey", "l_partkey"), "method": ("paper_entities", "paper_id", "entity_value"), "task": ("paper_entities", "paper_id", "entity_value"), "keyword": ("paper_tags", "paper_id", "tag_id")}
for name, (source, key, value) in SIGNAL_SETS.items():
    TABLES[f"{name}_of"] = f"SELECT {key} AS id, list_distinct(list({value})) AS v FROM {source}" + (f" WHERE entity_type = '{name.upper()}'" if source == "paper_entities" else "") + f" GROUP BY {key}"
JOINED = " ".join(f"LEFT JOIN {k}_of x_{k} ON x_{k}.id = a LEFT JOIN {k}_of y_{k} ON y_{k}.id = b" for k in SIGNAL_SETS)
JACCARD = {k: f"CASE WHEN len(coalesce(x_{k}.v, [])) + len(coalesce(y_{k}.v, [])) > 0 THEN {jaccard_sql(f'coalesce(x_{k}.v, [])', f'coalesce(y_{k}.v, [])')} ELSE 0 END" for k in SIGNAL_SETS}
HYBRID_LEAST = 0.15
TABLES["hybrids"] = f"SELECT a, b, {' + '.join([f'{relations.HYBRID["embedding"]} * similarity', *(f'{relations.HYBRID[k]} * {JACCARD[k]}' for k in SIGNAL_SETS)])} AS hybrid FROM cosines {JOINED}"


@query("hybrid_similarity", f"SELECT a, b, round(hybrid, 6) AS hybrid FROM hybrids WHERE hybrid >= {HYBRID_LEAST}")
def hybrid_similarity(spark, d):
    """Pairs of papers alike by vectors, cited parts, methods, tasks and tags: all five signals in one join."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("value"))
    entities = views.paper_entities(spark, d).withColumnRenamed("paper_id", "id").withColumnRenamed("entity_value", "value")
    tags = views.paper_tags(spark, d).select(F.col("paper_id").alias("id"), F.col("tag_id").alias("value"))
    sets = [lines, entities.filter("entity_type = 'METHOD'"), entities.filter("entity_type = 'TASK'"), tags]
    units = views.vectors(spark, d).select("id", vectors.l2_normalise(F.col("v")).alias("v"))
    known = [signals.ordered_sets(x.join(units.select("id"), "id", "left_semi")) for x in sets]
    pairs = signals.signal_pairs(units, known, tuple(relations.HYBRID[k] for k in ("embedding", *SIGNAL_SETS)), HYBRID_LEAST, None, dense=True)
    return pairs.select("a", "b", r6("weight").alias("hybrid"))


SHARED_SQL = " + ".join(f"{w} * CASE WHEN len({x}) + len({y}) > 0 THEN {jaccard_sql(x, y)} ELSE 0 END" for w, (x, y) in zip(signals.WEIGHTS[1:], ((f"coalesce(x{s}.names, [])", f"coalesce(y{s}.names, [])") for s in "at"), strict=True))
SETS_SQL = " ".join(f"LEFT JOIN {t}_sets {side}{t[0]} ON {side}{t[0]}.paper_id = {c}" for t in ("author", "tag") for side, c in (("x", "a"), ("y", "b")))
TABLES["hybrid_edges"] = f"""SELECT a, b, round(weight, 6) AS weight FROM (SELECT a, b, {signals.WEIGHTS[0]} * CASE WHEN similarity <= 0.4 THEN 0 ELSE pow((similarity - 0.4) / 0.6, 2) END + {SHARED_SQL} AS weight
  FROM cosines {SETS_SQL}) WHERE weight >= {signals.EDGE_LEAST}"""
TABLES["units"] = "SELECT id, term, weight / norm AS u FROM weights JOIN (SELECT id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY id) USING (id) WHERE norm > 0"
TABLES["lexical_pairs"] = "SELECT x.id AS a, y.id AS b, sum(x.u * y.u) AS s FROM units x JOIN units y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id"
TABLES["worded"] = "SELECT DISTINCT id FROM units"
TABLES["lexical_edges"] = f"""SELECT a, b, round(weight, 6) AS weight FROM (SELECT a, b, {signals.WEIGHTS[0]} * coalesce(s, 0) + {SHARED_SQL} AS weight FROM (SELECT x.id AS a, y.id AS b FROM worded x JOIN worded y ON x.id < y.id)
  LEFT JOIN lexical_pairs USING (a, b) {SETS_SQL}) WHERE weight >= {signals.EDGE_LEAST}"""


def shared_sets(spark, d):
    """The papers' authors and tags, by lower-cased name."""
    authors = views.paper_authors(spark, d).join(views.authors(spark, d), F.col("author_id") == F.col("id")).select(F.col("paper_id").alias("id"), F.lower("name").alias("value"))
    tags = views.paper_tags(spark, d).join(views.tags(spark, d), F.col("tag_id") == F.col("id")).select(F.col("paper_id").alias("id"), F.lower("name").alias("value"))
    return [signals.ordered_sets(authors), signals.ordered_sets(tags)]


@query("edge_hybrid", "SELECT a, b, weight FROM hybrid_edges")
def edge_hybrid(spark, d):
    """Pairs of papers with vectors that meet the edge rule: rescaled cosine, shared authors, shared tags."""
    units = views.vectors(spark, d).select("id", vectors.l2_normalise(F.col("v")).alias("v"))
    return signals.signal_pairs(units, shared_sets(spark, d), dense=True, scale=signals.rescaled).withColumn("weight", r6("weight"))


TABLES["centroids"] = "SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i) GROUP BY label"


CLUSTER_SETS = {"method": "METHOD", "task": "TASK"}
for name, kind in CLUSTER_SETS.items():
    TABLES[f"cluster_{name}"] = f"SELECT label, list_distinct(list(entity_value)) AS v FROM embeddings JOIN paper_entities ON paper_id = vec_id WHERE entity_type = '{kind}' GROUP BY label"
CLUSTER_JACCARD = [f"coalesce({jaccard_sql(f'x{name[0]}.v', f'y{name[0]}.v')}, 0)" for name in CLUSTER_SETS]
CLUSTER_JOIN = " ".join(f"LEFT JOIN cluster_{name} {side}{name[0]} ON {side}{name[0]}.label = {side}.label" for name in CLUSTER_SETS for side in "xy")


@query("cluster_similarity", f"""SELECT a, b, round(0.5 * cosine + 0.3 * m + 0.2 * t, 6) AS dense, round(0.6 * m + 0.4 * t, 6) AS sparse FROM (SELECT x.label AS a, y.label AS b, list_dot_product(x.c, y.c) / (sqrt(list_dot_product(x.c, x.c)) * sqrt(list_dot_product(y.c, y.c))) AS cosine, {CLUSTER_JACCARD[0]} AS m, {CLUSTER_JACCARD[1]} AS t
  FROM centroids x JOIN centroids y ON x.label < y.label {CLUSTER_JOIN})""")  # fmt: skip
def cluster_similarity(spark, d):
    """Pairs of clusters, which are few, by centroids and by the methods and tasks that their papers share."""
    v = views.vectors(spark, d)
    entities = views.paper_entities(spark, d).join(v.select(F.col("id").alias("paper_id"), "label"), "paper_id")
    of = lambda kind: F.coalesce(F.collect_set(F.when(F.col("entity_type") == kind, F.col("entity_value"))), F.array().cast("array<string>"))
    sets = entities.groupBy("label").agg(of("METHOD").alias("m"), of("TASK").alias("t"))
    c = joins.centroids(v, "label").join(sets, "label", "left")
    pairs = c.toDF("a", "ca", "ma", "ta").join(c.toDF("b", "cb", "mb", "tb"), F.col("a") < F.col("b"))
    same = lambda x, y: F.coalesce(F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))), F.lit(0.0))
    m, t = same(F.col("ma"), F.col("mb")), same(F.col("ta"), F.col("tb"))
    return pairs.select("a", "b", r6(relations.cluster_similarity(vectors.cosine(F.col("ca"), F.col("cb")), m, t)).alias("dense"), r6(relations.cluster_similarity(None, m, t)).alias("sparse"))


# --- graph


@query("similarity_edges", "SELECT a AS src, b AS dst, 'RELATED' AS type, weight FROM hybrid_edges")
def similarity_edges(spark, d):
    """The edges that the rule of edge_hybrid gives, all RELATED."""
    return edge_hybrid(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("RELATED").alias("type"), "weight")


@query("similarity_edges_tfidf", "SELECT a AS src, b AS dst, 'RELATED' AS type, weight FROM lexical_edges")
def similarity_edges_tfidf(spark, d):
    """The edges of papers without vectors: the same rule over the cosine of their TF-IDF vectors."""
    terms = signals.ordered_vectors(lexical.weighted_terms(saved(words_of(spark, d), "words")))
    edges = signals.signal_pairs(saved(terms, "term-vectors"), shared_sets(spark, d))
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("RELATED").alias("type"), r6("weight").alias("weight"))


@query("edge_filter", "SELECT src, dst, type FROM edges WHERE weight >= 0.35 AND type IN ('RELATED', 'EXTENDS')")
def edge_filter(spark, d):
    return views.edges(spark, d).filter((F.col("weight") >= 0.35) & F.col("type").isin("RELATED", "EXTENDS")).select("src", "dst", "type")


@query("relationships_for", "SELECT src, dst, type FROM edges WHERE (src = 5 OR dst = 5 OR src = 100) AND type <> 'RELATED'")
def relationships_for(spark, d):
    return views.edges(spark, d).filter(((F.col("src") == 5) | (F.col("dst") == 5) | (F.col("src") == 100)) & (F.col("type") != "RELATED")).select("src", "dst", "type")


@query("insert_ignore", "SELECT src, dst, type, weight FROM edges WHERE weight < 0.5 UNION ALL SELECT src, dst, type, 0.0 FROM edges e WHERE weight >= 0.4 AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.weight < 0.5 AND o.src = e.src AND o.dst = e.dst AND o.type = e.type)")
def insert_ignore(spark, d):
    from scriptorium.operators.merge import insert_ignore as put

    e = views.edges(spark, d).select("src", "dst", "type", "weight")
    return put(e.filter("weight < 0.5"), e.filter("weight >= 0.4").withColumn("weight", F.lit(0.0)), ["src", "dst", "type"])


TABLES["links"] = f"SELECT a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, weight AS w FROM edges WHERE src <> dst UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst AND type NOT IN ({DIRECTED})) GROUP BY a, b"
TABLES["shares"] = "SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM links"
TABLES["pr0"] = "SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes"
for i in range(30):
    TABLES[f"pr{i + 1}"] = f"""SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(c.came, 0) + (SELECT coalesce(sum(r.rank), 0) FROM pr{i} r WHERE r.id NOT IN (SELECT a FROM shares)) / (SELECT count(*) FROM nodes)) AS rank
  FROM nodes n LEFT JOIN (SELECT b, sum(rank * p) AS came FROM pr{i} r JOIN shares s ON s.a = r.id GROUP BY b) c ON c.b = n.id"""
TABLES["ranks"] = "SELECT id, rank / (SELECT max(rank) FROM pr30 ) AS rank FROM pr30"
TABLES["both_ways"] = "SELECT src AS a, dst AS b, type, weight, confidence FROM edges UNION ALL SELECT dst, src, type, weight, confidence FROM edges"
TABLES["scores"] = """SELECT n.id, n.cluster, n.year, least(1.0, greatest(0.0, 0.35 * citations / (SELECT max(citations) FROM nodes) + 0.25 * r.rank + 0.20 * coalesce(degree / (SELECT max(degree) FROM (SELECT sum(weight) AS degree FROM both_ways WHERE type = 'RELATED' GROUP BY a)), 0) + 0.10 * coalesce(conf, 0))) AS importance
  FROM nodes n JOIN ranks r USING (id) LEFT JOIN (SELECT a AS id, sum(weight) AS degree FROM both_ways WHERE type = 'RELATED' GROUP BY a) USING (id) LEFT JOIN (SELECT a AS id, avg(confidence) AS conf FROM both_ways GROUP BY a) USING (id)"""


@query("pagerank", "SELECT id, round(rank, 6) AS rank FROM ranks")
def pagerank(spark, d):
    return graph.pagerank(views.nodes(spark, d), views.edges(spark, d)).select("id", r6("rank").alias("rank"))


def scores(spark, d):
    n, e = views.nodes(spark, d), views.edges(spark, d)
    return graph.importance(n, e, graph.pagerank(n, e))


@query("importance", "SELECT id, round(importance, 6) AS importance FROM scores")
def importance(spark, d):
    return scores(spark, d).select("id", r6("importance").alias("importance"))


@query("importance_percentile", "SELECT id, rank, CAST(round(100.0 * (n - rank + 1) / n) AS BIGINT) AS percentile FROM (SELECT id, CAST(rank() OVER (ORDER BY round(importance, 6) DESC) AS BIGINT) AS rank, count(*) OVER () AS n FROM scores)")
def importance_percentile(spark, d):
    s = scores(spark, d).select("id", r6("importance").alias("importance"))
    return graph.percentile(s, "importance").select("id", F.col("rank").cast("long").alias("rank"), "percentile")


@query("cluster_anchor", "SELECT cluster, id FROM (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY round(importance, 6) DESC, id) AS n FROM scores) WHERE n = 1")
def cluster_anchor(spark, d):
    s = scores(spark, d).select("id", r6("importance").alias("importance")).join(views.nodes(spark, d).select("id", "cluster"), "id")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("importance"), "id"))).filter("n = 1").select("cluster", "id")


@query("merged_edges", """SELECT e.src, e.dst, 'RELATED' AS type, e.weight FROM edges e WHERE (e.src + e.dst) % 7 <> 0 UNION ALL SELECT dst, src, 'EXTENDS', greatest(0.1, confidence) FROM edges WHERE (src + dst) % 7 = 0""")
def merged_edges(spark, d):
    e = views.edges(spark, d)
    explicit = e.filter((F.col("src") + F.col("dst")) % 7 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("EXTENDS").alias("type"), "weight", "confidence")
    return graph.merged_edges(e.withColumn("type", F.lit("RELATED")), explicit)


@query("edge_type_counts", "SELECT a AS id, count(*) AS connections, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t.lower()}" for t in views.EDGE_TYPES) + " FROM both_ways GROUP BY a")
def edge_type_counts(spark, d):
    return graph.edge_type_counts(views.edges(spark, d))


@query("incident_confidence", "SELECT a AS id, round(least(1.0, greatest(0.0, avg(confidence))), 12) AS confidence FROM both_ways GROUP BY a")
def incident_confidence(spark, d):
    return graph.incident_confidence(views.edges(spark, d)).select("id", F.round("confidence", 12).alias("confidence"))


@query("orphans", "SELECT id FROM nodes WHERE id NOT IN (SELECT a FROM both_ways)")
def orphans(spark, d):
    return graph.orphans(views.nodes(spark, d), views.edges(spark, d))


@query("ego_2hop", "SELECT DISTINCT centre, id FROM (SELECT id AS centre, id FROM nodes UNION ALL SELECT a, b FROM both_ways UNION ALL SELECT x.a, y.b FROM both_ways x JOIN both_ways y ON x.b = y.a)")
def ego_2hop(spark, d):
    return graph.ego(views.edges(spark, d), views.nodes(spark, d))


@query("common_neighbours", "SELECT e.src, e.dst, count(DISTINCT x.b) AS common FROM edges e JOIN both_ways x ON x.a = e.src AND x.type <> 'RELATED' JOIN both_ways y ON y.a = e.dst AND y.b = x.b AND y.type <> 'RELATED' GROUP BY e.src, e.dst")
def common_neighbours(spark, d):
    return graph.common_neighbours(views.edges(spark, d))


def path_sql(kind, rows, order, n):
    return f"SELECT id, '{kind}' AS kind, CAST(place AS INT) AS place, other FROM (SELECT p.id, p.other, row_number() OVER (PARTITION BY p.id ORDER BY {order}, p.other) AS place FROM ({rows}) p JOIN scores s ON s.id = p.other JOIN nodes o ON o.id = p.id) WHERE place <= {n}"


INCOMING = f"SELECT dst AS id, src AS other, confidence FROM edges WHERE type IN ({DIRECTED})"
READING = " UNION ALL ".join((
    path_sql("MUST_READ", INCOMING, "round(s.importance, 6) DESC, p.confidence DESC", 1),
    path_sql("PREDECESSOR", INCOMING, "s.year DESC", 3),
    path_sql("SUCCESSOR", f"SELECT src AS id, dst AS other, confidence FROM edges WHERE type IN ({DIRECTED})", "round(s.importance, 6) DESC", 3),
    path_sql("NEWER", "SELECT b.a AS id, b.b AS other, b.confidence FROM both_ways b JOIN nodes x ON x.id = b.a JOIN nodes y ON y.id = b.b WHERE y.year > x.year", "s.year DESC", 2),
    path_sql("CONTRADICTION", "SELECT a AS id, b AS other, confidence FROM both_ways WHERE type = 'CONTRADICTS'", "round(s.importance, 6) DESC", 2),
))


@query("reading_path", READING)
def reading_path(spark, d):
    return graph.reading_path(views.nodes(spark, d), views.edges(spark, d), scores(spark, d))


@query("graph_similar", "SELECT id, other, CAST(place AS INT) AS place FROM (SELECT a AS id, b AS other, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, b) AS place FROM both_ways WHERE type IN ('RELATED', 'METHODOLOGY')) WHERE place <= 5")
def graph_similar(spark, d):
    return graph.similar_by_graph(views.edges(spark, d))


@query("paper_role", """SELECT id, CASE WHEN importance > 0.7 AND extending = 0 AND extended_by > 0 THEN 'FOUNDATIONAL' WHEN year > 0 AND extended_by = 0 AND extending > 0 THEN 'LATEST' WHEN methods > 1 THEN 'METHODOLOGICAL' WHEN importance > 0.5 THEN 'SIGNIFICANT' ELSE 'PLAIN' END AS role FROM (SELECT id, year, round(importance, 6) AS importance,
  (SELECT count(*) FROM edges WHERE type = 'EXTENDS' AND src = s.id) AS extended_by, (SELECT count(*) FROM edges WHERE type = 'EXTENDS' AND dst = s.id) AS extending, (SELECT count(*) FROM edges WHERE type = 'METHODOLOGY' AND (src = s.id OR dst = s.id)) AS methods FROM scores s)""")  # fmt: skip
def paper_role(spark, d):
    return graph.roles(views.nodes(spark, d), views.edges(spark, d), scores(spark, d).withColumn("importance", r6("importance")))


@query("bundle_groups", "SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, count(*) AS n, round(avg(weight), 6) AS weight FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst GROUP BY 1, 2")
def bundle_groups(spark, d):
    """Edges bundled by the pair of clusters that they join."""
    n = views.nodes(spark, d).select("id", "cluster")
    e = views.edges(spark, d).join(n.toDF("src", "x"), "src").join(n.toDF("dst", "y"), "dst")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"), r6(F.avg("weight")).alias("weight"))


@query("edge_explain", f"""SELECT src, dst, array_to_string(list_filter([concat(type, ' ', CAST(CAST(round(weight * 100) AS BIGINT) AS VARCHAR), '%'), CASE WHEN x.cluster = y.cluster THEN 'same cluster' END, CASE WHEN abs(x.year - y.year) <= 1 THEN 'same time' END], lambda t: t IS NOT NULL), '; ') AS reason FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst""")
def edge_explain(spark, d):
    n = views.nodes(spark, d).select("id", "cluster", "year")
    e = views.edges(spark, d).join(n.toDF("src", "cx", "yx"), "src").join(n.toDF("dst", "cy", "yy"), "dst")
    facts = F.array(F.concat(F.col("type"), F.lit(" "), F.round(F.col("weight") * 100).cast("long").cast("string"), F.lit("%")), F.when(F.col("cx") == F.col("cy"), "same cluster"), F.when(F.abs(F.col("yx") - F.col("yy")) <= 1, "same time"))
    return e.select("src", "dst", F.array_join(F.filter(facts, lambda x: x.isNotNull()), "; ").alias("reason"))


@query("timeline_xy", "SELECT id, round(CAST((year - (SELECT min(year) FROM nodes)) AS DOUBLE) / greatest(1, (SELECT max(year) - min(year) FROM nodes)), 6) AS x, round(ln(1 + citations) / ln(1 + (SELECT max(citations) FROM nodes)), 6) AS y FROM nodes")
def timeline_xy(spark, d):
    n = views.nodes(spark, d)
    span = F.broadcast(n.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.max("citations").alias("most")))  # one row
    x = (F.col("year") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    return n.crossJoin(span).select("id", r6(x).alias("x"), r6(F.log(1.0 + F.col("citations")) / F.log(1.0 + F.col("most"))).alias("y"))


@query("edge_betweenness")
def edge_betweenness(spark, d):
    return frontiers.edge_betweenness(views.edges(spark, d)).withColumn("betweenness", r6("betweenness"))


@query("bridge_edges")
def bridge_edges(spark, d):
    return graph.bridge_edges_by_rank(edge_betweenness(spark, d))


@query("bridges", "WITH RECURSIVE r AS (SELECT src, dst, src AS node FROM edges UNION SELECT r.src, r.dst, e.b FROM r JOIN both_ways e ON e.a = r.node WHERE NOT (least(e.a, e.b) = r.src AND greatest(e.a, e.b) = r.dst)) SELECT src, dst FROM edges WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM r WHERE node = dst)")
def bridges(spark, d):
    return frontiers.true_bridges(views.edges(spark, d))


@query("graph_components", "WITH RECURSIVE e AS (SELECT a, b FROM both_ways), r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id")
def graph_components(spark, d):
    return graph.components(views.edges(spark, d))


# --- authors

TABLES["author_pairs"] = "SELECT x.author_id AS a, y.author_id AS b, count(*) AS papers FROM paper_authors x JOIN paper_authors y ON x.paper_id = y.paper_id AND x.author_id < y.author_id GROUP BY 1, 2"


@query("coauthor_edges", "SELECT a, b, papers FROM author_pairs")
def coauthor_edges(spark, d):
    return graph.coauthor_edges(views.paper_authors(spark, d))


@query("author_papers", "SELECT author_id, count(DISTINCT paper_id) AS papers FROM paper_authors GROUP BY author_id")
def author_papers(spark, d):
    return views.paper_authors(spark, d).groupBy("author_id").agg(F.countDistinct("paper_id").alias("papers"))


@query("top_authors", "SELECT author_id, count(DISTINCT paper_id) AS papers FROM paper_authors GROUP BY author_id ORDER BY papers DESC, author_id LIMIT 10")
def top_authors(spark, d):
    return author_papers(spark, d).orderBy(F.desc("papers"), "author_id").limit(10)


@query("bridge_authors", "SELECT author, count(DISTINCT s_nationkey) AS communities FROM (SELECT a AS author, b FROM author_pairs UNION ALL SELECT b, a FROM author_pairs) JOIN supplier ON s_suppkey = b GROUP BY author HAVING count(DISTINCT s_nationkey) >= 2")
def bridge_authors(spark, d):
    """Authors with co-authors in two communities; here the communities are given: the suppliers' nations."""
    given = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return graph.bridge_authors(coauthor_edges(spark, d), given)


@query("lpa_communities")
def lpa_communities(spark, d):
    return graph.communities(coauthor_edges(spark, d))


# --- relationships and duplicates

TABLES["title_words"] = f"SELECT DISTINCT id, unnest({text.token_sql('title')}) AS word FROM papers"
TABLES["title_sizes"] = "SELECT id, count(*) AS n FROM title_words GROUP BY id"
TABLES["title_pairs"] = """SELECT a, b, shared, shared / (x.n + y.n - shared) AS jaccard FROM (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM title_words p JOIN title_words q ON p.word = q.word AND p.id < q.id GROUP BY 1, 2)
  JOIN title_sizes x ON x.id = a JOIN title_sizes y ON y.id = b WHERE shared / (x.n + y.n - shared) >= 0.05 - 1e-12 OR shared >= 3"""


def title_words(spark, d):
    return views.papers(spark, d).select("id", F.explode(F.array_distinct(text.token_array(F.col("title")))).alias("word"))


@query("jaccard", "SELECT a, b, round(jaccard, 6) AS jaccard FROM title_pairs WHERE jaccard >= 0.5 - 1e-12")
def jaccard(spark, d):
    """Papers whose titles have half of their words in common."""
    return relations.set_pairs(title_words(spark, d), "id", "word", 0.5).select("a", "b", r6("jaccard").alias("jaccard"))


def classifier_sql(x):
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9-]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in config.STOP_WORDS)})))"


TABLES["rel_papers"] = f"SELECT id, year, list_distinct(list_concat({classifier_sql('title')}, body)) AS words, len(list_intersect(body, {list(views.CONTRADICT_WORDS)})) > 0 AS con, len(list_intersect(body, {list(views.EXTEND_WORDS)})) > 0 AS ext FROM (SELECT id, title, year, {classifier_sql('abstract_text')} AS body FROM papers)"
TABLES["rel_words"] = f"SELECT id, word, word IN ({', '.join(repr(w) for w in views.METHOD_WORDS)}) AS is_method FROM (SELECT id, unnest(words) AS word FROM rel_papers)"
TABLES["rel_shared"] = "SELECT x.id AS a, y.id AS b, count(*) AS shared, count(*) FILTER (WHERE x.is_method) AS m FROM rel_words x JOIN rel_words y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2"
TABLES["rel_facts"] = """SELECT s.a, s.b, shared, m, shared / (len(x.words) + len(y.words) - shared) AS j, x.con OR y.con AS con, x.ext OR y.ext AS ext, x.year AS ya, y.year AS yb, similarity AS s
  FROM rel_shared s JOIN rel_papers x ON x.id = s.a JOIN rel_papers y ON y.id = s.b LEFT JOIN cosines c ON c.a = s.a AND c.b = s.b WHERE shared / (len(x.words) + len(y.words) - shared) >= 0.05 OR shared >= 3"""
TABLES["rel_typed"] = """SELECT *, CASE WHEN m > 0 THEN 'METHODOLOGY' WHEN con AND j > 0.08 THEN 'CONTRADICTS' WHEN ext AND ya <> yb THEN 'EXTENDS' WHEN j >= 0.10 OR shared >= 4 OR s >= 0.60 THEN 'SUPPORTS' END AS type,
  CAST(CASE WHEN m > 0 THEN least(0.85, 0.55 + 0.1 * m) WHEN con AND j > 0.08 THEN least(0.75, 0.45 + 2 * j) WHEN ext AND ya <> yb THEN least(0.8, 0.5 + 2.5 * j) WHEN j >= 0.10 OR shared >= 4 THEN least(0.75, 0.4 + 3 * j) ELSE least(0.70, 0.35 + 0.5 * s) END AS DOUBLE) AS raw FROM rel_facts"""


@query("relationship_rules", """SELECT CASE WHEN ya >= yb THEN a ELSE b END AS source, CASE WHEN ya >= yb THEN b ELSE a END AS target, type, round(CASE WHEN s >= 0.75 THEN least(0.95, raw * 1.15) WHEN s >= 0 AND s < 0.30 THEN raw * 0.70 ELSE raw END + 1e-9, 6) AS confidence FROM rel_typed WHERE type IS NOT NULL""")
def relationship_rules(spark, d):
    """Every pair of papers that a rule relates by words of titles and abstracts, and by vectors where there are any."""
    facts = relations.relationship_facts(views.papers(spark, d), views.vectors(spark, d), views.METHOD_WORDS, views.CONTRADICT_WORDS, views.EXTEND_WORDS)
    return relations.relationships(saved(spread(facts), "relation-facts")).withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


TABLES["dup_pairs"] = """SELECT a, b, min(n) AS n FROM (SELECT x.id AS a, y.id AS b, 1 AS n FROM papers x JOIN papers y ON lower(x.doi) = lower(y.doi) AND x.id < y.id WHERE coalesce(x.doi, '') <> ''
  UNION ALL SELECT a, b, 2 FROM title_pairs JOIN papers x ON x.id = a JOIN papers y ON y.id = b WHERE jaccard >= 0.85 - 1e-12 AND x.year = y.year UNION ALL SELECT a, b, 3 FROM cosines WHERE similarity >= 0.9) GROUP BY a, b"""


def duplicates(spark, d):
    near = joins.pairs_above(views.vectors(spark, d), 0.9)
    return relations.duplicate_pairs(views.papers(spark, d), title_words(spark, d), near)


@query("duplicate_pairs", "SELECT a, b, (['DOI', 'TITLE', 'VECTOR'])[n] AS rule FROM dup_pairs")
def duplicate_pairs(spark, d):
    return duplicates(spark, d)


@query("duplicate_groups")
def duplicate_groups(spark, d):
    """Greedy groups around anchors; the tests compare them with the sequential definition."""
    papers = views.papers(spark, d)
    near = joins.pairs_above(views.vectors(spark, d), 0.9)
    return relations.duplicate_groups(near, papers, *relations.duplicate_classes(papers, title_words(spark, d)))


REPLY = """concat('Here: [{"a": ', event_id % 4, ', "b": ', event_id % 3, ', "type": "', (['supports', 'EXTENDS', 'other'])[CAST(event_id % 3 + 1 AS INT)], '", "confidence": ', event_id % 5 * 0.4, '}] done')"""


@query("parse_relationship_json", """SELECT event_id, CAST(event_id % 4 AS INT) AS a, CAST(event_id % 3 AS INT) AS b, (['SUPPORTS', 'EXTENDS'])[CAST(event_id % 3 + 1 AS INT)] AS type, CAST(least(1.0, round((event_id % 5) * 0.4, 6)) AS DOUBLE) AS confidence FROM events WHERE event_id % 3 <> 2 AND event_id % 4 <> event_id % 3 AND event_id % 4 < 3""")
def parse_relationship_json(spark, d):
    """Replies of a model, made from events, with indexes, types and confidences to check."""
    i = F.col("event_id")
    kind = F.element_at(F.array(F.lit("supports"), F.lit("EXTENDS"), F.lit("other")), (i % 3 + 1).cast("int"))
    reply = F.concat(F.lit('Here: [{"a": '), (i % 4).cast("string"), F.lit(', "b": '), (i % 3).cast("string"), F.lit(', "type": "'), kind, F.lit('", "confidence": '), F.round((i % 5) * 0.4, 6).cast("string"), F.lit("}] done"))
    rows = table(spark, d, "events").select("event_id", F.explode(relations.parse_reply(reply, F.lit(3))).alias("r"))
    return rows.select("event_id", "r.a", "r.b", "r.type", r6("r.confidence").alias("confidence"))


# --- clusters


@query("ward_clusters")
def ward_clusters(spark, d):
    return cluster.ward_clusters(views.vectors(spark, d))


def by_language(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster"))


def words_of(spark, d):
    return lexical.tokenised(spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))


@query("cluster_labels", """SELECT cluster, concat(array_to_string(list(term ORDER BY place), ', '), ' #', cluster) AS label FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, term) AS place FROM (SELECT lang AS cluster, term, round(sum(weight), 6) AS w FROM weights JOIN documents ON doc_id = id GROUP BY lang, term)) WHERE place <= 3 GROUP BY cluster""")
def cluster_labels(spark, d):
    return cluster.cluster_labels(by_language(spark, d), words_of(spark, d))


@query("cluster_keywords", """SELECT cluster, term, CAST(place AS INT) AS place FROM (SELECT lang AS cluster, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS place FROM tokens JOIN documents ON doc_id = id WHERE length(term) > 3 GROUP BY lang, term) WHERE place <= 3""")
def cluster_keywords(spark, d):
    return cluster.cluster_keywords(by_language(spark, d), words_of(spark, d))


@query("shared_terms", """SELECT a, b, term, CAST(place AS INT) AS place FROM (SELECT a, b, x.term, row_number() OVER (PARTITION BY a, b ORDER BY round(least(x.weight, y.weight), 6) DESC, x.term) AS place FROM dup_pairs JOIN weights x ON x.id = a JOIN weights y ON y.id = b AND y.term = x.term) WHERE place <= 3""")
def shared_terms(spark, d):
    """What the duplicate pairs have in common."""
    return cluster.shared_terms(words_of(spark, d), duplicates(spark, d))


@query("textrank")
def textrank(spark, d):
    return graph.textrank(spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))


