"""Queries over texts: tokens, retrieval, cleaning, citations, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.functions import citations, scoring, text, vectors
from scriptorium.operators import entities, lexical
from scriptorium.plans import adapters as views
from scriptorium.plans.registry import TABLES, query
from scriptorium.storage import saved, spread, table

r6 = lambda c: F.round(c, 6)
YEAR = views.AS_OF_YEAR


def docs(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def passages(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


TABLES["words"] = f"SELECT doc_id AS id, {text.token_sql('text')} AS words FROM documents"
TABLES["asked"] = f"SELECT item_id AS query_id, {text.token_sql('text')} AS words FROM benchmark"
TABLES["tokens"] = "SELECT id, unnest(words) AS term FROM words"
TABLES["corpus"] = "SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(words)) AS avg_length FROM words"
TABLES["counts"] = "SELECT t.id, term, len(words) AS length, CAST(count(*) AS DOUBLE) AS n FROM tokens t JOIN words w ON w.id = t.id GROUP BY ALL"
TABLES["dfs"] = "SELECT term, CAST(count(DISTINCT id) AS DOUBLE) AS df FROM tokens GROUP BY term"
TABLES["weights"] = f"SELECT id, term, c.n / length * greatest({config.IDF_FLOOR}, ln(corpus.n / (1 + df))) AS weight FROM counts c JOIN dfs USING (term), corpus"
TABLES["query_terms"] = "SELECT query_id, len(words) AS length, unnest(words) AS term FROM asked"
TABLES["query_weights"] = f"""SELECT query_id, q.term, count(*) / length * CASE WHEN df IS NULL THEN ln(corpus.n) ELSE greatest({config.IDF_FLOOR}, ln(corpus.n / (1 + df))) END AS weight
  FROM query_terms q LEFT JOIN dfs ON dfs.term = q.term, corpus GROUP BY query_id, q.term, length, df, corpus.n"""
TABLES["dots"] = "SELECT query_id, id, sum(q.weight * w.weight) AS dot FROM query_weights q JOIN weights w USING (term) GROUP BY query_id, id"
TABLES["tfidf_cosines"] = """SELECT query_id, id, dot / (norm * q_norm) AS cosine FROM dots
  JOIN (SELECT id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY id) USING (id) JOIN (SELECT query_id, sqrt(sum(weight * weight)) AS q_norm FROM query_weights GROUP BY query_id) USING (query_id) WHERE norm > 0 AND q_norm > 0"""
TABLES["bm25_scores"] = f"""SELECT query_id, c.id, sum(ln((corpus.n - df + 0.5) / (df + 0.5) + 1) * c.n * {config.BM25_K1 + 1} / (c.n + {config.BM25_K1} * ({1 - config.BM25_B} + {config.BM25_B} * length / avg_length))) AS score
  FROM (SELECT DISTINCT query_id, term FROM query_terms) q JOIN counts c USING (term) JOIN dfs USING (term), corpus GROUP BY query_id, c.id"""


@query("tokenize", "SELECT id, array_to_string(words, ' ') AS words, len(words) AS n FROM words")
def tokenize(spark, d):
    return lexical.tokenised(docs(spark, d)).select("id", F.array_join("words", " ").alias("words"), F.size("words").cast("long").alias("n"))


@query("term_frequency", "SELECT id, term, round(n / length, 6) AS tf FROM counts")
def term_frequency(spark, d):
    return lexical.term_frequency(lexical.tokenised(docs(spark, d))).select("id", "term", r6("tf").alias("tf"))


@query("document_frequency", "SELECT term, CAST(df AS BIGINT) AS df FROM dfs")
def document_frequency(spark, d):
    return lexical.document_frequency(lexical.tokenised(docs(spark, d)))


@query("avg_doc_length", "SELECT CAST(n AS BIGINT) AS n, round(avg_length, 6) AS avg_length FROM corpus")
def avg_doc_length(spark, d):
    return lexical.corpus_size(lexical.tokenised(docs(spark, d))).select("n", r6("avg_length").alias("avg_length"))


@query("tfidf_vectors", "SELECT id, term, round(weight, 6) AS weight FROM weights")
def tfidf_vectors(spark, d):
    return lexical.tfidf_vectors(words_once(spark, d)).select("id", "term", r6("weight").alias("weight"))


def words_once(spark, d):
    """The documents' words, written: vectors read them several times, and reading costs far less than splitting texts."""
    return saved(lexical.tokenised(docs(spark, d)), "words")


def cosines(spark, d, k=None):
    return lexical.tfidf_cosine(lexical.tokenised(docs(spark, d)), lexical.tokenised(passages(spark, d)), k)


def bm25_scores(spark, d, k=None):
    return lexical.bm25(lexical.tokenised(docs(spark, d)), lexical.tokenised(passages(spark, d)), k=k)


@query("tfidf_cosine", "SELECT query_id, id, round(cosine, 6) AS cosine FROM tfidf_cosines")
def tfidf_cosine(spark, d):
    return cosines(spark, d).select("query_id", "id", r6("cosine").alias("cosine"))


@query("bm25", "SELECT query_id, id, round(score, 6) AS score FROM bm25_scores")
def bm25(spark, d):
    return bm25_scores(spark, d).select("query_id", "id", r6("score").alias("score"))


@query("bm25_topk", "SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm25_scores) WHERE rank <= 10")
def bm25_topk(spark, d):
    """The flagship: the ten best documents for each benchmark passage."""
    return lexical.topk(bm25_scores(spark, d, 10).withColumn("score", r6("score")), 10).select("query_id", "id", "score", "rank")


TABLES["bm25_percent"] = "SELECT query_id, id, least(100.0, score / max(score) OVER (PARTITION BY query_id) * 100) AS percent FROM bm25_scores WHERE score > 0"


def scored(spark, d):
    """(query_id, id, percent, cosine): both scores from one scan, BM25 as a share of the query's best."""
    both = saved(lexical.lexical_scores(lexical.tokenised(docs(spark, d)), lexical.tokenised(passages(spark, d))).filter("bm25 > 0"), "scores")
    top = both.groupBy("query_id").agg(F.max("bm25").alias("top"))  # a row a query, so no window has to hold a query's scores
    return both.join(F.broadcast(top), "query_id").select("query_id", "id", F.least(F.lit(100.0), F.col("bm25") / F.col("top") * 100).alias("percent"), "cosine")


@query("bm25_normalised", "SELECT query_id, id, round(percent, 6) AS percent FROM bm25_percent")
def bm25_normalised(spark, d):
    return scored(spark, d).select("query_id", "id", r6("percent").alias("percent"))


@query("semantic_search", "SELECT query_id, id, round(cosine, 6) AS cosine FROM tfidf_cosines WHERE cosine >= 0.02")
def semantic_search(spark, d):
    """Library search without embeddings: cosine of at least 0.02."""
    return cosines(spark, d).filter("cosine >= 0.02").select("query_id", "id", r6("cosine").alias("cosine"))


@query("query_keywords", f"""SELECT item_id AS id, array_to_string(list_slice(list_filter(list_distinct_ordered, lambda w: true), 1, 12), ' ') AS keywords FROM (
  SELECT item_id, list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda z: list_position(k, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM (
  SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ({', '.join(repr(w) for w in config.STOP_WORDS)}) AND (length(w) > 2 OR w IN ({', '.join(repr(w) for w in config.SHORT_KEYWORDS)}) OR regexp_matches(w, '[0-9]'))) AS k FROM benchmark))""")  # fmt: skip
def query_keywords(spark, d):
    return passages(spark, d).select("id", F.array_join(text.query_keywords(F.col("text")), " ").alias("keywords"))


@query("keyword_topn", """SELECT id, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT id, upper(term[1]) || term[2:] AS term, score, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, term) AS rank FROM (SELECT id, term, n / length * (1 + ln(length(term))) AS score FROM counts WHERE length(term) >= 3)) WHERE rank <= 10""")  # fmt: skip
def keyword_topn(spark, d):
    return entities.top_keywords(lexical.tokenised(docs(spark, d)), 10).select("id", "term", "score", "rank")


@query("auto_tag", """SELECT id AS paper_id, k.term AS name, t.id AS tag_id, t.id IS NULL AS is_new FROM (
  SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(n / length * (1 + ln(length(term))), 6) DESC, term) AS rank FROM counts WHERE length(term) >= 3) k LEFT JOIN (SELECT id, name FROM tags) t ON lower(t.name) = k.term WHERE rank <= 3""".replace("SELECT id AS paper_id", "SELECT k.id AS paper_id"))  # fmt: skip
def auto_tag(spark, d):
    """The three best keywords of a paper as tags: known ones by name without case, others as new."""
    return entities.auto_tags(lexical.tokenised(docs(spark, d)), views.tags(spark, d))


@query("sentence_split", r"""SELECT doc_id AS id, CAST(len(p) AS BIGINT) AS n, CAST(list_sum(list_transform(p, lambda s: length(s))) AS BIGINT) AS chars FROM (
  SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS p FROM (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 20) AS k FROM documents))""")  # fmt: skip
def sentence_split(spark, d):
    s = docs(spark, d).select("id", text.sentences(F.col("text")).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("chunk_text", r"""SELECT id, i AS chunk, CAST(least(400, len(w) - i * 300) AS BIGINT) AS n, md5(array_to_string(w[i * 300 + 1 : i * 300 + 400], ' ')) AS digest FROM (
  SELECT id, w, unnest(range(0, CAST(CASE WHEN len(w) <= 400 THEN 1 ELSE ceil((len(w) - 400) / 300.0) + 1 END AS BIGINT))) AS i FROM (SELECT doc_id AS id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""")  # fmt: skip
def chunk_text(spark, d):
    c = docs(spark, d).select("id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "c"))
    return c.select("id", F.col("chunk").cast("long").alias("chunk"), F.size(F.split("c", " ")).cast("long").alias("n"), F.md5("c").alias("digest"))


TABLES["chunked"] = r"""SELECT id, i AS chunk, array_to_string(w[i * 300 + 1 : i * 300 + 400], ' ') AS c FROM (
  SELECT id, w, unnest(range(0, CAST(CASE WHEN len(w) <= 400 THEN 1 ELSE ceil((len(w) - 400) / 300.0) + 1 END AS BIGINT))) AS i FROM (SELECT doc_id AS id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)"""


@query("chunk_rank", """SELECT query_id, id, chunk, CAST(round(boost, 6) AS DOUBLE) AS boost, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(boost, 6) DESC, id, chunk) AS rank FROM (
  SELECT query_id, id, chunk, 0.12 * count(*) AS boost FROM (SELECT DISTINCT query_id, term FROM query_terms WHERE length(term) > 2) q JOIN (SELECT DISTINCT id, chunk, unnest(ws) AS term FROM (SELECT id, chunk, """ + text.token_sql("c") + """ AS ws FROM chunked)) USING (term) GROUP BY ALL)) WHERE rank <= 8""")  # fmt: skip
def chunk_rank(spark, d):
    """The eight chunks that hold most keywords of a question, by an equi-join on words."""
    c = docs(spark, d).select("id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "c"))
    have = c.select("id", F.col("chunk").cast("long").alias("chunk"), F.explode(F.array_distinct(text.token_array(F.col("c")))).alias("term"))
    asked = lexical.tokenised(passages(spark, d)).select(F.col("id").alias("query_id"), F.explode(F.array_distinct("words")).alias("term")).filter(F.length("term") > 2)
    boost = have.join(asked, "term").groupBy("query_id", "id", "chunk").agg(r6(F.count("*") * 0.12).alias("boost"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boost"), "id", "chunk"))
    return boost.withColumn("rank", rank).filter("rank <= 8")


@query("clean_text", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')), '') AS text FROM pages""")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query("clean_abstract", r"""SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '\n[ \t\r]*\n'), lambda p: trim(regexp_replace(p, '[ \t\n\r]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)), '') AS text FROM pages""")
def clean_abstract(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_abstract(F.col("html")).alias("text"))


@query("table_gap_normalise", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', '   ', 'g'), '[ \t]{3,}', ' | ', 'g')) AS digest FROM pages")
def table_gap_normalise(spark, d):
    """Gaps of three or more blanks, as between table cells, become a bar."""
    return table(spark, d, "pages").select("page_id", F.md5(text.table_gaps(F.regexp_replace("html", "<[^>]*>", "   "))).alias("digest"))


@query("page_search", "SELECT page_id FROM pages WHERE contains(lower(html), 'the')")
def page_search(spark, d):
    return table(spark, d, "pages").filter(F.contains(F.lower("html"), F.lit("the"))).select("page_id")


@query("identifier_type", r"""SELECT id, CASE WHEN regexp_matches(doi, '^(https?://(dx\.)?doi\.org/)?10\.[0-9]+/') THEN 'DOI' WHEN regexp_matches(doi, '^(?i:arxiv:)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$') THEN 'ARXIV' WHEN regexp_matches(doi, '^[0-9]{1,8}$') THEN 'PMID' ELSE 'UNKNOWN' END AS kind
  FROM (SELECT id, CASE WHEN id % 3 = 1 THEN concat(2000 + id % 25, '.', 10000 + id) WHEN id % 3 = 2 THEN CAST(id AS VARCHAR) ELSE doi END AS doi FROM papers)""")  # fmt: skip
def identifier_type(spark, d):
    i = F.col("id")
    value = F.when(i % 3 == 1, F.concat((2000 + i % 25).cast("string"), F.lit("."), (10000 + i).cast("string"))).when(i % 3 == 2, i.cast("string")).otherwise(F.col("doi"))
    return views.papers(spark, d).select("id", text.identifier_type(value).alias("kind"))


def entity_sql(kind, flags, words):
    """DuckDB has no look-around: separators are doubled, so that each match can take one on either side."""
    doubled = "regexp_replace(text, '([^\\p{L}\\p{N}])', '\\1\\1', 'g')"
    words = words.replace("'", "''")
    return f"SELECT doc_id AS id, '{kind}' AS entity_type, lower(trim(regexp_replace(unnest(regexp_extract_all({doubled}, '{flags}(?:^|[^\\p{{L}}\\p{{N}}])({words})(?:$|[^\\p{{L}}\\p{{N}}])', 1)), '\\s+', ' ', 'g'))) AS entity_value FROM documents"


@query("extract_entities", "SELECT DISTINCT id, entity_type, entity_value FROM (" + " UNION ALL ".join(entity_sql(*r) for r in config.ENTITY_RULES) + ")")
def extract_entities(spark, d):
    return entities.extract(docs(spark, d))


PHRASES = [*entities.plain_phrases(), *views.PHRASES]


def phrase_sql(kind):
    """Longest alternatives first; separators are doubled, so that each match can take one on either side."""
    own = sorted({p.replace("-", " ") for k, p in PHRASES if k == kind}, key=lambda p: (-len(p), p))
    return f"SELECT id, '{kind}' AS entity_type, unnest(regexp_extract_all(regexp_replace(t, '([ .])', '\\1\\1', 'g'), '(?:^|[ .])({'|'.join(p.replace(' ', '  ') for p in own)})(?:$|[ .])', 1)) AS v FROM phrase_texts"


TABLES["phrase_texts"] = r"SELECT doc_id AS id, trim(regexp_replace(regexp_replace(lower(text), '[\s-]+', ' ', 'g'), ' *[^\p{L}\p{N} ]+ *', '.', 'g')) AS t FROM documents"


@query("phrase_entities", "SELECT DISTINCT id, entity_type, replace(v, '  ', ' ') AS entity_value FROM (" + " UNION ALL ".join(phrase_sql(k) for k in sorted({k for k, _ in PHRASES})) + ")")
def phrase_entities(spark, d):
    """Entities by a dictionary of phrases instead of patterns."""
    known = spark.createDataFrame(PHRASES, "entity_type string, phrase string")
    return entities.phrase_entities(docs(spark, d), known, max(len(p.replace("-", " ").split()) for _, p in PHRASES))


@query("doc_text", "SELECT id, md5(concat_ws(' ', title, title, title, abstract_text, venue)) AS search_text, md5(concat_ws(' ', title, title, abstract_text)) AS cluster_text FROM papers")
def doc_text(spark, d):
    p = views.papers(spark, d)
    return p.select("id", F.md5(entities.document_text("search")).alias("search_text"), F.md5(entities.document_text("cluster")).alias("cluster_text"))


@query("year_extract", "SELECT id, coalesce(CAST(nullif(regexp_extract(title, '([0-9]{4})', 1), '') AS INT), 0) AS year FROM papers")
def year_extract(spark, d):
    return views.papers(spark, d).select("id", text.first_year(F.col("title")).alias("year"))


@query("escapes", r"""SELECT id, md5(CASE WHEN regexp_matches(abstract_text, '[,"\n\r]') THEN '"' || replace(abstract_text, '"', '""') || '"' ELSE abstract_text END) AS csv,
  md5(replace(replace(replace(replace(abstract_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml, md5(regexp_replace(abstract_text, '([&%$#_])', '\\\1', 'g')) AS latex FROM papers""")  # fmt: skip
def escapes(spark, d):
    t = F.col("abstract_text")
    return views.papers(spark, d).select("id", F.md5(text.escape_csv(t)).alias("csv"), F.md5(text.escape_xml(t)).alias("xml"), F.md5(text.escape_latex(t)).alias("latex"))


@query("latex_clean", r"""SELECT id, regexp_replace(regexp_replace(t, '\\[`''^"~=.]\{?([A-Za-z])\}?', '\1', 'g'), '[{}]', '', 'g') AS text FROM (SELECT id, concat('{', title, '} \''', '{e}t\"a ', venue) AS t FROM papers)""")
def latex_clean(spark, d):
    return views.papers(spark, d).select("id", text.unescape_latex(F.concat(F.lit("{"), "title", F.lit("} \\'{e}t\\\"a "), "venue")).alias("text"))


@query("synthetic_id", """SELECT id, concat('local-', CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS BIGINT)) AS paper_id FROM (
  SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_filter(string_split(concat(lower(trim(title)), year), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda x, y: (x * 31 + y) % 4294967296) AS h FROM papers)""")
def synthetic_id(spark, d):
    return views.papers(spark, d).select("id", text.synthetic_id(F.col("title"), F.col("year")).alias("paper_id"))


@query("evidence_sentence")
def evidence_sentence(spark, d):
    """The sentence of each paper nearest to its own benchmark passage by shared words; rows only."""
    return entities.evidence_sentences(docs(spark, d), passages(spark, d))


# --- authors and citations


@query("authors_array", "SELECT paper_id, array_to_string(names, '; ') AS names, CAST(len(names) AS BIGINT) AS n FROM author_lists")
def authors_array(spark, d):
    return views.author_lists(spark, d).select("paper_id", F.array_join("names", "; ").alias("names"), F.size("names").cast("long").alias("n"))


LAST, CITED = r"list_extract(string_split_regex(trim(x), '\s+'), -1)", r"concat(list_extract(string_split_regex(trim(x), '\s+'), -1), ', ', array_to_string(list_transform(list_slice(string_split_regex(trim(x), '\s+'), 1, -2), lambda p: p[1] || '.'), ' '))"


@query("author_names", f"SELECT id, {LAST} AS last_name, {CITED} AS citation_name FROM (SELECT id, name AS x FROM authors)")
def author_names(spark, d):
    return views.authors(spark, d).select("id", text.last_name(F.col("name")).alias("last_name"), text.citation_name(F.col("name")).alias("citation_name"))


@query("author_format", "SELECT paper_id, CASE len(names) WHEN 1 THEN names[1] WHEN 2 THEN array_to_string(names, ' & ') ELSE names[1] || ' et al.' END AS short, array_to_string(names, ', ') AS long FROM author_lists")
def author_format(spark, d):
    return views.author_lists(spark, d).select("paper_id", text.short_authors(F.col("names")).alias("short"), text.full_authors(F.col("names")).alias("long"))


def cited_papers(spark, d):
    """Papers with their list of names (null when unknown)."""
    return views.papers(spark, d).join(views.author_lists(spark, d), F.col("id") == F.col("paper_id"), "left").drop("paper_id", "abstract_text")


TABLES["cited_papers"] = f"""SELECT id, year, title, venue, doi, coalesce(names, []) AS names, list_transform(coalesce(names, []), lambda x: {CITED}) AS cited,
  list_transform(coalesce(names, []), lambda x: concat(array_to_string(list_transform(list_slice(string_split_regex(trim(x), '\\s+'), 1, -2), lambda p: p[1] || '. '), ''), {LAST})) AS initials FROM papers LEFT JOIN author_lists ON paper_id = id"""
DOI = "CASE WHEN coalesce(doi, '') <> '' THEN concat('{}', doi, '{}') ELSE '' END"
VENUE = "CASE WHEN coalesce(venue, '') <> '' THEN concat(venue, '{}') ELSE '' END"
NOBODY = "WHEN len(names) = 0 THEN 'Unknown Author'"
STYLES = {
    "apa": f"""CASE {NOBODY} WHEN len(names) = 1 THEN cited[1] WHEN len(names) <= 20 THEN array_to_string(cited[1:-2], ', ') || ', & ' || cited[-1] ELSE array_to_string(cited[1:19], ', ') || ', ... ' || cited[-1] END
      || ' (' || CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE 'n.d.' END || '). ' || coalesce(title || '. ', '') || {VENUE.format('. ')} || {DOI.format('https://doi.org/', '')}""",
    "mla": f"""CASE {NOBODY} WHEN len(names) = 1 THEN cited[1] WHEN len(names) = 2 THEN cited[1] || ', and ' || names[2] ELSE cited[1] || ', et al' END
      || '. ' || coalesce('"' || title || '." ', '') || {VENUE.format(', ')} || CASE WHEN year > 0 THEN year || '. ' ELSE '' END || {DOI.format('https://doi.org/', '')}""",
    "ieee": f"""CASE {NOBODY} WHEN len(names) = 1 THEN initials[1] ELSE array_to_string(initials[1:-2], ', ') || ', and ' || initials[-1] END
      || ', ' || coalesce('"' || title || '," ', '') || {VENUE.format(', ')} || CASE WHEN year > 0 THEN year || '.' ELSE '' END || {DOI.format(' doi: ', '.')}""",
    "harvard": f"""CASE {NOBODY} WHEN len(names) = 1 THEN cited[1] WHEN len(names) <= 3 THEN array_to_string(cited[1:-2], ', ') || ', and ' || cited[-1] ELSE cited[1] || ' et al.' END
      || ' (' || CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE 'n.d.' END || ') ' || coalesce('''' || title || ''', ', '') || {VENUE.format('. ')} || {DOI.format('Available at: https://doi.org/', '')}""",
}
for style, sql in STYLES.items():

    @query(f"cite_{style}", f"SELECT id, trim({sql}) AS citation FROM cited_papers")
    def cite(spark, d, style=style):
        c = [F.col(x) for x in ("names", "year", "title", "venue", "doi")]
        return cited_papers(spark, d).select("id", getattr(citations, style)(*c).alias("citation"))


KEY = "concat(coalesce(nullif(regexp_replace(lower(coalesce(list_extract(string_split_regex(trim(names[1]), '\\s+'), -1), '')), '[^a-z]', '', 'g'), ''), 'unknown'), CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '' END)"
PRESENT = lambda c, before, after="": f"CASE WHEN coalesce({c}, '') <> '' THEN concat('{before}', {c}, '{after}') END"


@query("cite_key", f"SELECT id, {KEY} AS cite_key FROM cited_papers")
def cite_key(spark, d):
    return cited_papers(spark, d).select("id", text.cite_key(F.col("names"), F.col("year")).alias("cite_key"))


BIBTEX = f"""concat('@article{{', {KEY}, ',', chr(10), array_to_string(list_filter([CASE WHEN len(names) > 0 THEN concat('  author = {{', array_to_string(names, ' and '), '}}') END, '  title = {{' || title || '}}', {PRESENT('venue', '  journal = {', '}')},
  CASE WHEN year > 0 THEN concat('  year = {{', year, '}}') END, {PRESENT('doi', '  doi = {', '}')}], lambda x: x IS NOT NULL), ',' || chr(10)), chr(10), '}}')"""
RIS = f"""array_to_string(list_filter(['TY  - JOUR', nullif(array_to_string(list_transform(names, lambda x: 'AU  - ' || x), chr(10)), ''), 'TI  - ' || title, {PRESENT('venue', 'JO  - ')}, CASE WHEN year > 0 THEN concat('PY  - ', year) END, {PRESENT('doi', 'DO  - ')}, 'ER  - '], lambda x: x IS NOT NULL), chr(10))"""


@query("fmt_bibtex", f"SELECT id, {BIBTEX} AS entry FROM cited_papers")
def fmt_bibtex(spark, d):
    return cited_papers(spark, d).select("id", citations.bibtex(*[F.col(x) for x in ("names", "year", "title", "venue", "doi")]).alias("entry"))


@query("fmt_ris", f"SELECT id, {RIS} AS entry FROM cited_papers")
def fmt_ris(spark, d):
    p = cited_papers(spark, d).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return p.select("id", citations.ris(*[F.col(x) for x in ("names", "year", "title", "venue", "doi")]).alias("entry"))


@query("fmt_latex", f"SELECT id, concat('\\cite{{', {KEY}, '}}', chr(10), chr(10), {BIBTEX}) AS entry FROM cited_papers")
def fmt_latex(spark, d):
    return cited_papers(spark, d).select("id", citations.latex(*[F.col(x) for x in ("names", "year", "title", "venue", "doi")]).alias("entry"))


XML = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
ELEMENT = lambda name, c: f"CASE WHEN coalesce({c}, '') <> '' THEN concat('<b:{name}>', {XML(c)}, '</b:{name}>') END"
TAG = f"concat(coalesce(regexp_replace(list_extract(string_split_regex(trim(names[1]), '\\s+'), -1), '[^a-zA-Z]', '', 'g'), 'Unknown'), CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '' END)"
PERSON = f"concat('<b:Person><b:Last>', {XML(LAST)}, '</b:Last><b:First>', {XML(f'trim(replace(x, {LAST}, {chr(39) * 2}))')}, '</b:First></b:Person>')"
WORD_XML = f"""array_to_string(list_filter(['<b:Source xmlns:b="http://schemas.openxmlformats.org/officeDocument/2006/bibliography">', {ELEMENT('Tag', TAG)}, '<b:SourceType>JournalArticle</b:SourceType>',
  CASE WHEN len(names) > 0 THEN concat('<b:Author><b:Author><b:NameList>', array_to_string(list_transform(names, lambda x: {PERSON}), ''), '</b:NameList></b:Author></b:Author>') END, {ELEMENT('Title', 'title')}, {ELEMENT('JournalName', 'venue')},
  CASE WHEN year > 0 THEN {ELEMENT('Year', 'CAST(year AS VARCHAR)')} END, {ELEMENT('DOI', 'doi')}, '</b:Source>'], lambda x: x IS NOT NULL), chr(10))"""


@query("fmt_word_xml", f"SELECT id, {WORD_XML} AS source FROM cited_papers")
def fmt_word_xml(spark, d):
    p = cited_papers(spark, d).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return p.select("id", citations.word_xml(*[F.col(x) for x in ("names", "year", "title", "venue", "doi")]).alias("source"))


# --- scores


RECENCY = f"CASE WHEN coalesce(year, 0) <= 0 THEN 30.0 WHEN greatest({YEAR} - year, 0) = 0 THEN 100.0 WHEN {YEAR} - year <= 2 THEN 95.0 WHEN {YEAR} - year <= 5 THEN 85.0 ELSE greatest(10.0, 80 * exp(-({YEAR} - year) / 15.0)) END"
CITED_SCORE = "CASE WHEN coalesce(citation_count, 0) <= 0 THEN 5.0 ELSE least(100.0, greatest(5.0, log10(citation_count) / 3 * 90)) END"


@query("recency", f"SELECT id, CAST(round({RECENCY}, 6) AS DOUBLE) AS score FROM papers")
def recency(spark, d):
    return views.papers(spark, d).select("id", r6(scoring.recency(F.col("year"), YEAR)).alias("score"))


@query("citation_score", f"SELECT id, CAST(round({CITED_SCORE}, 6) AS DOUBLE) AS score FROM papers")
def citation_score(spark, d):
    return views.papers(spark, d).select("id", r6(scoring.citation_score(F.col("citation_count"))).alias("score"))


AGE = f"({YEAR} - year)"


@query("quality_label", f"""SELECT id, CASE WHEN {AGE} >= 10 AND citation_count < 100 THEN 'Outdated' WHEN {AGE} >= 5 AND citation_count < 20 THEN 'Outdated' WHEN citation_count >= 100 THEN 'Strong'
  WHEN citation_count / greatest(1, {AGE}) >= 20 OR ({AGE} <= 2 AND citation_count >= 5) THEN 'Strong' WHEN citation_count / greatest(1, {AGE}) >= 5 OR {AGE} <= 3 THEN 'Good' ELSE 'Consider' END AS label FROM papers""")  # fmt: skip
def quality_label(spark, d):
    return views.papers(spark, d).select("id", scoring.quality_label(F.col("year"), F.col("citation_count"), YEAR).alias("label"))


@query("quality_flags", f"""SELECT id, array_to_string(list_filter([CASE WHEN year > 0 AND {AGE} >= 10 THEN 'VERY_OLD' WHEN year > 0 AND {AGE} >= 5 THEN 'OLD' WHEN year > 0 AND {AGE} <= 1 THEN 'RECENT' END,
  CASE WHEN year > 0 AND citation_count > 0 AND citation_count / greatest(1, {AGE}) >= 50 THEN 'HIGH_IMPACT' WHEN year > 0 AND citation_count > 0 AND citation_count / greatest(1, {AGE}) >= 20 THEN 'GOOD_IMPACT' END,
  CASE WHEN coalesce(abstract_text, '') = '' THEN 'NO_ABSTRACT' END, CASE WHEN coalesce(doi, '') = '' THEN 'NO_DOI' END], lambda x: x IS NOT NULL), ',') AS flags FROM papers""")  # fmt: skip
def quality_flags(spark, d):
    return views.papers(spark, d).select("id", F.array_join(scoring.quality_flags(F.col("year"), F.col("citation_count"), F.col("abstract_text"), F.col("doi"), YEAR), ",").alias("flags"))


VENUE_SQL = "CASE " + " ".join(f"WHEN lower(trim(venue)) = '{k}' THEN {v}" for k, v in views.VENUES.items()) + " " + " ".join(f"WHEN contains(lower(trim(venue)), '{k}') OR contains('{k}', lower(trim(venue))) THEN {views.VENUES[k]}" for k in sorted(views.VENUES, key=lambda k: (-len(k), k))) + f" ELSE {config.VENUE_DEFAULT} END"
TABLES["venue_scores"] = f"SELECT id, venue, CAST({VENUE_SQL} AS DOUBLE) AS quality FROM papers"


@query("venue_quality", "SELECT id, quality FROM venue_scores")
def venue_quality(spark, d):
    return views.papers(spark, d).select("id", scoring.venue_quality(F.col("venue"), views.VENUES).alias("quality"))


TABLES["relevance_scores"] = f"""SELECT k.id AS query_id, p.id, least(100.0, (len(list_filter(words, lambda w: contains(lower(concat_ws(' ', title, abstract_text)), w))) * 100.0 + len(list_filter(words, lambda w: contains(lower(title), w))) * 25.0) / least(8, len(words))) AS score
  FROM (SELECT item_id AS id, {text.token_sql('text')} AS words FROM benchmark) k, papers p WHERE len(words) > 0"""


@query("relevance", "SELECT query_id, id, CAST(round(score, 6) AS DOUBLE) AS score FROM relevance_scores")
def relevance(spark, d):
    """Each benchmark passage as a query against all papers; the queries are a block of known small size."""
    return entities.relevance_scores(spread(views.papers(spark, d)), lexical.tokenised(passages(spark, d))).select("query_id", "id", r6("score").alias("score"))


TABLES["composite"] = f"""SELECT b.query_id, b.id, least(100.0, {config.LEXICAL_WEIGHTS['bm25']} * percent + {config.LEXICAL_WEIGHTS['cosine']} * 100 * coalesce(cosine, 0) + {config.LEXICAL_WEIGHTS['citation']} * {CITED_SCORE} + {config.LEXICAL_WEIGHTS['recency']} * {RECENCY}) AS score
  FROM bm25_percent b LEFT JOIN tfidf_cosines c ON c.query_id = b.query_id AND c.id = b.id JOIN papers p ON p.id = b.id"""


def composite(spark, d):
    return entities.composite_rank(views.papers(spark, d), scored(spark, d), YEAR)


@query("composite_rank", "SELECT query_id, id, CAST(round(score, 6) AS DOUBLE) AS score, CASE WHEN round(score, 6) >= 80 THEN 'Excellent' WHEN round(score, 6) >= 60 THEN 'Strong' WHEN round(score, 6) >= 40 THEN 'Moderate' ELSE 'Weak' END AS strength FROM composite")
def composite_rank(spark, d):
    """The lexical tier: BM25, TF-IDF cosine, citations and recency."""
    c = composite(spark, d).withColumn("score", r6("score"))
    return c.select("query_id", "id", "score", scoring.strength(F.col("score")).alias("strength"))


TABLES["neural_pairs"] = "SELECT q.id AS query_id, v.id, list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))) AS similarity FROM vectors q JOIN benchmark ON item_id = q.id, vectors v"
TABLES["neural_scores"] = f"""SELECT b.query_id, b.id, least(100.0, {config.NEURAL_WEIGHTS['neural']} * CASE WHEN similarity IS NULL THEN (percent + 100 * coalesce(cosine, 0)) / 2 ELSE greatest(similarity, 0) * 100 END + {config.NEURAL_WEIGHTS['bm25']} * percent + {config.NEURAL_WEIGHTS['cosine']} * 100 * coalesce(cosine, 0) + {config.NEURAL_WEIGHTS['citation']} * {CITED_SCORE} + {config.NEURAL_WEIGHTS['recency']} * {RECENCY}) AS score
  FROM bm25_percent b LEFT JOIN tfidf_cosines c ON c.query_id = b.query_id AND c.id = b.id LEFT JOIN neural_pairs n ON n.query_id = b.query_id AND n.id = b.id JOIN papers p ON p.id = b.id"""


@query("neural_rank", "SELECT query_id, id, CAST(round(score, 6) AS DOUBLE) AS score FROM neural_scores")
def neural_rank(spark, d):
    """The neural tier: a passage has the vector of its id, a paper that of its own; papers without one take the mean of the lexical scores."""
    v = views.vectors(spark, d).select("id", "v")
    asked = v.join(passages(spark, d).select("id"), "id", "left_semi").toDF("query_id", "q")  # as few as the queries
    similarity = F.greatest(vectors.cosine(F.col("q"), F.col("v")), F.lit(0.0))
    near = v.crossJoin(asked).select("query_id", "id", similarity.alias("similarity"))
    return entities.composite_rank(views.papers(spark, d), scored(spark, d), YEAR, near).select("query_id", "id", r6("score").alias("score"))


@query("fallback_rank", f"""SELECT query_id, id, CAST(round(least(100.0, r.score * {config.FALLBACK_WEIGHTS['relevance']} + {CITED_SCORE} * {config.FALLBACK_WEIGHTS['citation']} + {RECENCY} * {config.FALLBACK_WEIGHTS['recency']}), 6) AS DOUBLE) AS score FROM relevance_scores r JOIN papers USING (id)""")
def fallback_rank(spark, d):
    """The keyword tier, for when neither vectors nor statistics are there."""
    papers = spread(views.papers(spark, d))
    rows = entities.fallback_rank(entities.relevance_scores(papers, lexical.tokenised(passages(spark, d)), ("year", "citation_count")), papers, YEAR)
    return rows.select("query_id", "id", r6("score").alias("score"))


@query("sort_results", "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INT) AS by_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY year DESC, id) AS INT) AS by_year, CAST(row_number() OVER (PARTITION BY query_id ORDER BY citation_count DESC, id) AS INT) AS by_citations FROM composite JOIN papers USING (id)")
def sort_results(spark, d):
    rows = composite(spark, d).withColumn("score", r6("score")).join(views.papers(spark, d).select("id", "year", "citation_count"), "id")
    place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "id"))
    return rows.select("query_id", "id", place("score").alias("by_score"), place("year").alias("by_year"), place("citation_count").alias("by_citations"))


TABLES["near_papers"] = "SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, id) AS rank FROM tfidf_cosines WHERE cosine >= 0.02) WHERE rank <= 15"
TABLES["first_papers"] = "SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM papers) WHERE rank <= 15"


@query("rag_context", """SELECT query_id, id, CAST(rank AS INT) AS rank, CASE WHEN coalesce(abstract_text, '') = '' THEN '' WHEN length(abstract_text) > 800 THEN concat(substring(abstract_text, 1, 800), '...') ELSE abstract_text END AS excerpt
  FROM (SELECT query_id, id, rank FROM near_papers UNION ALL SELECT item_id AS query_id, f.id, f.rank FROM benchmark, first_papers f WHERE item_id NOT IN (SELECT query_id FROM near_papers)) JOIN papers USING (id)""")  # fmt: skip
def rag_context(spark, d):
    """The fifteen nearest papers of a question by a cosine of at least 0.02, or the first fifteen where none is near; with
    excerpts of 800 characters, marked where they are cut."""
    near = cosines(spark, d, 15).filter("cosine >= 0.02").withColumn("cosine", r6("cosine"))
    near = saved(lexical.topk(near, 15, "cosine").select("query_id", "id", "rank"), "near")
    papers = views.papers(spark, d)
    by_id = F.col("id").asc_nulls_last()
    first = papers.select("id").orderBy(by_id).limit(15).select("id", F.row_number().over(Window.orderBy(by_id)).alias("rank"))
    alone = passages(spark, d).select(F.col("id").alias("query_id")).join(near, "query_id", "left_anti")
    chosen = near.unionByName(alone.crossJoin(F.broadcast(first)))
    text = F.coalesce("abstract_text", F.lit(""))
    excerpt = F.when(F.length(text) > 800, F.concat(F.substring(text, 1, 800), F.lit("..."))).otherwise(text)
    return papers.join(chosen, "id").select("query_id", "id", "rank", excerpt.alias("excerpt"))


@query("author_boost", f"""SELECT k.id AS query_id, a.id AS author_id, CAST(least(40.0, len(list_filter(k.words, lambda w: list_contains(a.words, w))) * 15.0) AS DOUBLE) AS boost
  FROM (SELECT DISTINCT id, {text.token_sql("name || ' and Ana'")} AS words FROM authors) k, (SELECT id, {text.token_sql('name')} AS words FROM authors) a WHERE len(list_filter(k.words, lambda w: list_contains(a.words, w))) > 0""")  # fmt: skip
def author_boost(spark, d):
    """Pairs of author queries and authors that share a word, found by an equi-join on words."""
    a = views.authors(spark, d)
    q = a.select(F.col("id").alias("query_id"), text.token_array(F.concat("name", F.lit(" and Ana"))).alias("q"))
    return entities.author_boosts(q, a.select(F.col("id").alias("author_id"), text.token_array(F.col("name")).alias("w")))
