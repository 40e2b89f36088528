"""Views that read the given tables as a research library, in Spark and in SQL.

A document is a paper; labels say what is favourite or trashed; line items link papers and authors (suppliers), and
papers and entities (parts); customers' market segments are clusters of orders; embeddings are paper vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.operators.vectors import pairs_above
from scriptorium.plans.registry import TABLES
from scriptorium.storage import table

AS_OF_YEAR = 2025
AS_OF_ORDERS = 2001
AS_OF_TS = "2024-01-26 12:00:00"
#: The graph that the graph queries read: these tables have no edges of their own.
EDGE_SIMILARITY = 0.3
EDGE_TYPES = ("RELATED", "EXTENDS", "SUPPORTS", "CONTRADICTS", "METHODOLOGY")
#: The given tables' own venues, beside those that are generally known.
VENUES = config.VENUES | {"src1": 0.9, "src2": 0.8, "src3": 0.7, "source": 0.65, "src10": 0.95}
#: Words of the given tables' invented prose that stand for methods, objections and advances, beside the real ones.
METHOD_WORDS = (*config.METHOD_WORDS, "nttion", "lement", "enheit")
CONTRADICT_WORDS = (*config.CONTRADICT_WORDS, "queque", "sten")
EXTEND_WORDS = (*config.EXTEND_WORDS, "inging", "ount", "aire")
#: Phrases that the given tables' documents hold.
PHRASES = (("LICENCE", "licensed under the apache license"), ("LICENCE", "licensed under"), ("LICENCE", "apache license"), ("LICENCE", "all rights reserved"), ("LICENCE", "mit"), ("NOTICE", "rights"), ("NOTICE", "version"), ("NOTICE", "the license"), ("NOTICE", "this"), ("NOTICE", "this work is licensed"))
STATUSES = ("UNREAD", "READING", "READ")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def papers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("abstract_text"),
        (2000 + i % 25).cast("int").alias("year"),
        (F.col("n_chars") % 1500).cast("int").alias("citation_count"),
        F.when(i % 7 != 0, F.concat(F.lit("10.1/"), (i % 900).cast("string"))).alias("doi"),
        F.col("source").alias("venue"),
    )


TABLES["papers"] = """SELECT doc_id AS id, substring(text, 1, 60) AS title, text AS abstract_text, CAST(2000 + doc_id % 25 AS INT) AS year,
  CAST(n_chars % 1500 AS INT) AS citation_count, CASE WHEN doc_id % 7 <> 0 THEN concat('10.1/', doc_id % 900) END AS doi, source AS venue FROM documents"""


def user_library(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    marks = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    added = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("added_at"))
    return (
        table(spark, d, "documents").select("doc_id").join(marks, "doc_id", "left").join(added, "doc_id", "left")
        .select(
            i.alias("paper_id"), (i % 5).alias("collection_id"), (F.coalesce("quality", F.lit(0)) == 1).alias("is_favorite"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_deleted"),
            F.element_at(F.array(*map(F.lit, STATUSES)), (i % 3 + 1).cast("int")).alias("read_status"), F.when(i % 4 == 0, "noted").otherwise("").alias("notes"), (i % 11 == 0).alias("is_mine"), "added_at",
        )
    )


TABLES["user_library"] = """SELECT d.doc_id AS paper_id, d.doc_id % 5 AS collection_id, coalesce(quality, 0) = 1 AS is_favorite, coalesce(toxic, 0) = 1 AS is_deleted,
  (['UNREAD', 'READING', 'READ'])[CAST(d.doc_id % 3 + 1 AS INT)] AS read_status, CASE WHEN d.doc_id % 4 = 0 THEN 'noted' ELSE '' END AS notes, d.doc_id % 11 = 0 AS is_mine, ts AS added_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id"""


def collections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))


TABLES["collections"] = "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region"


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


def paper_tags(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("paper_id"), F.explode(F.array_distinct(F.array(i % 25, F.floor(i / 25) % 25))).alias("tag_id"))


TABLES["tags"] = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"
TABLES["paper_tags"] = "SELECT DISTINCT doc_id AS paper_id, unnest([doc_id % 25, (doc_id // 25) % 25]) AS tag_id FROM documents"


def authors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    letter = lambda n: F.substr(F.lit(LETTERS), (n % 26 + 1).cast("int"), F.lit(1))
    return table(spark, d, "supplier").select(k.alias("id"), F.concat(letter(k), F.lit("na "), letter(F.floor(k / 26)), F.lit(". Supplier"), k.cast("string")).alias("name"))


def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"), F.col("l_linenumber").alias("author_order"))


TABLES["authors"] = f"SELECT s_suppkey AS id, concat(substr('{LETTERS}', CAST(s_suppkey % 26 + 1 AS INT), 1), 'na ', substr('{LETTERS}', CAST((s_suppkey // 26) % 26 + 1 AS INT), 1), '. Supplier', s_suppkey) AS name FROM supplier"
TABLES["paper_authors"] = "SELECT l_orderkey AS paper_id, l_suppkey AS author_id, l_linenumber AS author_order FROM lineitem"


def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, names) in the order of authorship; one join instead of a lookup a paper."""
    rows = paper_authors(spark, d).join(authors(spark, d), F.col("author_id") == F.col("id"))
    listed = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("author_order", "name"))).alias("a"))
    return listed.select("paper_id", F.col("a.name").alias("names"))


TABLES["author_lists"] = "SELECT paper_id, list(name ORDER BY author_order, name) AS names FROM paper_authors JOIN authors ON author_id = id GROUP BY paper_id"


def paper_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = lambda kind, c: F.struct(F.lit(kind).alias("t"), F.col(c).alias("v"))
    both = rows.select(F.col("l_orderkey").alias("paper_id"), F.explode(F.array(one("METHOD", "p_brand"), one("TASK", "p_type"))).alias("e"))
    return both.select("paper_id", F.col("e.t").alias("entity_type"), F.col("e.v").alias("entity_value")).distinct()


TABLES["paper_entities"] = """SELECT DISTINCT l_orderkey AS paper_id, 'METHOD' AS entity_type, p_brand AS entity_value FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT l_orderkey, 'TASK', p_type FROM lineitem JOIN part ON l_partkey = p_partkey"""


def paper_cluster(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("paper_id"), F.col("c_mktsegment").alias("cluster"))


def paper_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"))


TABLES["paper_cluster"] = "SELECT o_orderkey AS paper_id, c_mktsegment AS cluster FROM orders JOIN customer ON o_custkey = c_custkey"
TABLES["paper_year"] = "SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INT) AS year FROM orders"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


TABLES["vectors"] = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(i.alias("id"), F.col("label").alias("cluster"), (2000 + i % 25).cast("int").alias("year"), (i * 37 % 1500).cast("int").alias("citations"))


TABLES["nodes"] = "SELECT vec_id AS id, label AS cluster, CAST(2000 + vec_id % 25 AS INT) AS year, CAST(vec_id * 37 % 1500 AS INT) AS citations FROM embeddings"


def edges(spark: SparkSession, d: str, similarity: float = EDGE_SIMILARITY) -> DataFrame:
    """(src, dst, type, weight, confidence) with src < dst."""
    pairs = pairs_above(vectors(spark, d), similarity)
    kind = F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("a") + F.col("b")) % len(EDGE_TYPES) + 1).cast("int"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("type"), F.round("similarity", 6).alias("weight"), F.round(0.5 + F.col("similarity") / 2, 6).alias("confidence"))


TABLES["cosines"] = """SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS similarity
  FROM vectors a JOIN vectors b ON a.id < b.id"""
TABLES["edges"] = f"""SELECT a AS src, b AS dst, ({list(EDGE_TYPES)})[CAST((a + b) % {len(EDGE_TYPES)} + 1 AS INT)] AS type, round(similarity, 6) AS weight, round(0.5 + similarity / 2, 6) AS confidence
  FROM cosines WHERE similarity >= {EDGE_SIMILARITY}"""
