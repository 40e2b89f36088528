from oracle import connect, rows_of_spark, rows_of_sql

from scriptorium.llm import url_filter

URLS = {
    "http://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://badexample.com/en/1": ("badexample.com", "/en/1", "com/", "allow"),
    "http://x.com": ("x.com", "", None, "allow"),
    "http://x.net/fr/a#b": ("x.net", "/fr/a", "net/fr/", "block"),
    "http://casino.org/": ("casino.org", "/", None, "block"),
    "http://a.org/cheap-pillsx/deal": ("a.org", "/cheap-pillsx/deal", None, "block"),
    "http://a.org/cheap/cheap": ("a.org", "/cheap/cheap", None, "allow"),
    "http://casinos.org/": ("casinos.org", "/", None, "allow"),
    "no scheme casino": ("", "", None, "block"),
    "a://b://c.net/es/?x": ("b:", "//c.net/es/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert rows == dict(enumerate(URLS.values()))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_words_of_other_languages_long_and_repeated_urls(spark):
    urls = ["http://a.org/erotik/bilder", "http://a.org/apuestas-gratis", "http://a.org/gratis", "http://a.org/" + "x" * 200_000 + "/porn", "http://a.org/Essex/sexual", None]
    pages = spark.createDataFrame([(i // 2 if i < 12 else None, u) for i, u in enumerate(u for u in urls for _ in range(2))], "page_id long, url string")
    rows = url_filter.judge_urls(pages).collect()
    verdicts = {i: {r.verdict for r in rows if r.page_id == i} for i in range(6)}
    assert len(rows) == 12 and [verdicts[i] for i in range(6)] == [{"block"}, {"block"}, {"allow"}, {"block"}, {"allow"}, {"allow"}]


def test_vocabulary():
    from scriptorium.llm.url_terms import SOFT_TERMS, STRICT_TERMS

    terms = STRICT_TERMS + SOFT_TERMS
    assert len(set(terms)) == len(terms) and all(t.isalnum() and t == t.lower() for t in terms)


def test_oracles(spark, data):
    from scriptorium.llm.queries import ORACLE_SQL, QUERIES

    con = connect(data)
    for name, sql in ORACLE_SQL.items():
        assert rows_of_spark(QUERIES[name](spark, data)) == rows_of_sql(con, sql), name
