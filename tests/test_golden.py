"""Hand-computed values and boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import citations, scoring, text, vectors
from scriptorium.operators import evaluation, gaps, lexical, library, merge, relations
from scriptorium.sources import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("year", "score"), [(0, 30), (None, 30), (2025, 100), (2030, 100), (2023, 95), (2020, 85), (2019, 80 * math.exp(-6 / 15)), (1900, 10)])
def test_recency(spark, year, score):
    assert one(spark, scoring.recency(F.lit(year).cast("int"), 2025)) == pytest.approx(score)


@pytest.mark.parametrize(("count", "score"), [(0, 5), (-1, 5), (1, 5), (10, 30), (1000, 90), (10**6, 100)])
def test_citation_score(spark, count, score):
    assert one(spark, scoring.citation_score(F.lit(count))) == pytest.approx(score)


@pytest.mark.parametrize(("year", "count", "label"), [(2015, 99, "Outdated"), (2015, 100, "Strong"), (2020, 19, "Outdated"), (2024, 5, "Strong"), (2021, 20, "Good"), (2022, 0, "Good"), (2021, 3, "Consider")])
def test_quality_label(spark, year, count, label):
    assert one(spark, scoring.quality_label(F.lit(year), F.lit(count), 2025)) == label


def test_bands(spark):
    assert [one(spark, scoring.severity(F.lit(x))) for x in (75, 74.9, 40, 39.9)] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert one(spark, scoring.duration(F.lit(3661))) == "1:01:01"
    assert one(spark, scoring.rescaled(F.lit(0.4))) == 0 and one(spark, scoring.rescaled(F.lit(1.0))) == pytest.approx(1)


def test_opportunity_score_of_the_published_example(spark):
    none = F.lit(None).cast("double")
    score = gaps.opportunity_score(F.lit("INTERDISCIPLINARY"), F.lit(0.85), none, none, F.lit(0), none, F.lit(None).cast("string"))
    assert one(spark, score) == pytest.approx(52.0)


def test_gaps_are_evaluated_by_venues_and_citations(spark):
    """Worked by hand: two clusters of 3 and 2 papers in a library of 8; paper 5 is unknown."""
    cluster = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c"), (7, "c"), (8, "c")], "paper_id long, cluster string")
    years = spark.createDataFrame([(1, 2020), (2, 2021), (3, 2021), (4, 2021), (5, 2010), (6, 2001)], "paper_id long, year int")
    quality = spark.createDataFrame([(1, 0.9, 100), (2, 0.6, 0), (3, 0.3, 20), (4, 0.8, 878), (6, 0.1, 5)], "paper_id long, venue double, citations long")
    c = gaps.Context(cluster, None, years, None, 2022, quality)
    found = [("g1", "TOPIC", ["a", "b"], 0.5, 0.2, None), ("g2", "TEMPORAL_DORMANT", ["c"], 0.9, 0.8, None), ("g3", "METHODOLOGY_TRANSFER", ["a", "c"], 0.4, 0.1, 2)]
    rows = {r.gap_id: r for r in gaps.evaluated(c, spark.createDataFrame(found, "gap_id string, gap_type string, clusters array<string>, confidence double, evidence double, supporting long")).collect()}
    # g1: 5 papers, venues 2.6 of 4 known, 998 citations; 2021 has 3 of the 5 years known, recent (2020 to 2022) 4 / 3: stable
    assert rows["g1"].papers == 5 and rows["g1"].score == pytest.approx(100 * (0.35 * 0.6 * (1 - 5 / 16) + 0.25 * (0.4 * 0.2 + 0.3 * 0.25 + 0.3 * 0.65) + 0.2 * 0.6 + 0.2 * 0.5), abs=1e-6)
    assert rows["g1"].evidence == "MEDIUM"  # .4 * 2.6 / 5 + .3 * log10(999) / 3 + .3 * 5 / 20 = .583
    # g2: 3 papers, one venue known, dormant since 2001
    assert rows["g2"].score == pytest.approx(100 * (0.35 * 0.7 * (1 - 3 / 16) + 0.25 * (0.4 * 0.8 + 0.3 * 0.15 + 0.3 * 0.1) + 0.2 * 0.7 + 0.2 * 0.9), abs=1e-6)
    assert rows["g2"].evidence == "LOW" and rows["g2"].severity == "MEDIUM"
    # g3 affects no papers; its evidence has two; the source's trend counts: 2 of 3 in 2021, recent 1: stable
    assert (rows["g3"].papers, rows["g3"].evidence, rows["g3"].readiness) == (0, "LOW", 0.0)
    assert rows["g3"].score == pytest.approx(100 * (0.35 * 0.8 + 0.25 * (0.4 * 0.1 + 0.3 * 0.1 + 0.3 * 0.5) + 0.2 * 0.6 + 0.2 * 0.4), abs=1e-6)


def test_citations(spark):
    names = F.array(F.lit("Ana B. Cole"), F.lit("Dan Eng"))
    args = (names, F.lit(2020), F.lit("On X"), F.lit("Venue"), F.lit("10.1/2"))
    assert one(spark, citations.apa(*args)) == "Cole, A. B., & Eng, D. (2020). On X. Venue. https://doi.org/10.1/2"
    assert one(spark, citations.mla(*args)) == 'Cole, A. B., and Dan Eng. "On X." Venue, 2020. https://doi.org/10.1/2'
    assert one(spark, citations.ieee(*args)) == 'A. B. Cole, and D. Eng, "On X," Venue, 2020. doi: 10.1/2.'
    assert one(spark, citations.harvard(*args)) == "Cole, A. B., and Eng, D. (2020) 'On X', Venue. Available at: https://doi.org/10.1/2"
    nobody = (F.array().cast("array<string>"), F.lit(0), F.lit("T"), F.lit(""), F.lit(None).cast("string"))
    assert one(spark, citations.apa(*nobody)) == "Unknown Author (n.d.). T."
    assert one(spark, citations.bibtex(*args)).startswith("@article{cole2020,\n  author = {Ana B. Cole and Dan Eng},")
    assert "<b:Last>Cole</b:Last>" in one(spark, citations.word_xml(*args))


def test_tokens(spark):
    t = lambda s: one(spark, text.token_array(F.lit(s)))
    assert t("The α–β Test, of 42 C x été") == ["alpha-beta", "test", "c"]
    assert t("") == [] and t(None) == []
    assert one(spark, text.sentences(F.lit("1 A first sentence is here. A second sentence is here. No."))) == ["1 A first sentence is here.", "A second sentence is here."]


def test_synthetic_id(spark):
    def java(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c)) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h)

    for title in ("A title", "Another, much longer title of a paper"):
        assert one(spark, text.synthetic_id(F.lit(title), F.lit(2020))) == f"local-{java(title.lower() + '2020')}"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "")], "id long, text string")
    asked = spark.createDataFrame([(9, "alpha alpha")], "id long, text string")
    (row,) = lexical.bm25(lexical.tokenised(docs), lexical.tokenised(asked)).collect()
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert (row.id, row.score) == (1, pytest.approx(idf * 1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3)))))


def test_unknown_query_terms_weigh_ln_n(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string")
    words = lexical.tokenised(docs)
    q = lexical.tokenised(spark.createDataFrame([(9, "delta")], "id long, text string"))
    (row,) = lexical.query_weights(q, lexical.document_frequency(words), lexical.corpus_size(words).select("n")).collect()
    assert row.weight == pytest.approx(math.log(2))


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, vectors.cosine(v(1, 0), v(0, 0))) == 0
    assert one(spark, vectors.cosine(v(1, 0), v(-1, 0))) == -1 and one(spark, vectors.cosine(v(1, 0), v(-1, 0), clamp=True)) == 0
    assert one(spark, scoring.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0


@pytest.mark.parametrize(
    ("matrix", "expected"),
    [([[13, 2, 0, 0], [2, 12, 0, 1], [1, 1, 8, 0], [0, 1, 0, 9]], (0.8656, 0.8417, 0.8504, 0.7826)), ([[11, 4, 0, 0], [3, 10, 0, 2], [3, 0, 7, 0], [0, 3, 0, 7]], (0.7533, 0.7000, 0.7182, 0.5902))],
)
def test_classification_metrics_of_the_published_matrices(spark, matrix, expected):
    rows = [(t, p) for t, row in enumerate(matrix) for p, n in enumerate(row) for _ in range(n)]
    m = evaluation.classification_metrics(spark.createDataFrame(rows, "truth int, predicted int")).first()
    assert [m.precision, m.recall, m.f1, m.kappa] == pytest.approx(expected, abs=6e-5)


def test_resampling(spark):
    v = spark.createDataFrame([(float(i % 2),) for i in range(200)], "x double")
    b = evaluation.bootstrap_ci(v).first()
    assert b.mean == 0.5 and 0.42 < b.low < 0.46 and 0.54 < b.high < 0.58
    assert evaluation.permutation_test(v.select((F.col("x") - 0.5).alias("x")), 1000).first().p > 0.9
    assert evaluation.permutation_test(v, 1000).first().p < 0.01


def test_smart_query_is_order_insensitive(spark):
    view = spark.createDataFrame([(1, "Deep nets", 2015), (2, "Shallow nets", 2021), (3, "Trees", 2020)], "paper_id long, title string, year int")
    tags = spark.createDataFrame([(1, "ML"), (2, "Other")], "paper_id long, name string")
    authors = spark.createDataFrame([(1, "Ana Cole")], "paper_id long, name string")
    ids = lambda q: sorted(r.paper_id for r in library.smart_query(view, q, tags, authors).collect())
    assert ids("nets year>=2010") == ids("year>=2010 nets") == [1, 2]
    assert ids("tag:ml author:cole") == [1] and ids("year=x") == [1, 2, 3] and ids("") == [1, 2, 3] and ids("year<=2015") == [1]


def test_merges(spark):
    old = spark.createDataFrame([("a", "b", "T", 1.0)], "src string, dst string, type string, w double")
    new = spark.createDataFrame([("a", "b", "T", 2.0), ("a", "c", "T", 3.0), ("a", "c", "T", 4.0)], old.schema)
    merged = merge.insert_ignore(old, new, ["src", "dst", "type"])
    assert sorted(r.w for r in merged.collect()) == [1.0, 3.0]
    again = merge.insert_ignore(merged, new, ["src", "dst", "type"])
    assert again.count() == merged.count()
    found = spark.createDataFrame([(0, 1, "10.1/X", "T", None, "", 0), (1, 2, "10.1/x", "U", "text", "V", 5), (2, 3, None, "Other!", "t", "V", 1)], "priority int, id long, doi string, title string, abstract_text string, venue string, citation_count int")
    rows = {r.key: r for r in merge.federated_merge(found).collect()}
    assert rows["doi:10.1/x"].title == "T" and rows["doi:10.1/x"].venue == "V" and rows["doi:10.1/x"].citation_count == 5 and "title:other" in rows
    assert merge.federated_merge(found, strict_doi=True).count() == 1


def test_ris_and_bibtex(spark):
    ris = "TY  - JOUR\r\nAU  - Cole, Ana\r\nAU  - Dan Eng\r\nT1  - A title\r\nN2  - Text\r\nDO  - https://doi.org/10.1/2\r\nY1  - 2020/05/01\r\nKW  - k1\r\nER  - \r\n\r\nTY  - BOOK\r\nTI  - Second\r\nER  - \r\n"
    rows = records.ris_records(spark.createDataFrame([(ris,), (None,), ("",)], "value string")).orderBy("title").collect()
    assert [(r.title, r.doi, r.year, r.authors, r.keywords) for r in rows] == [("A title", "10.1/2", 2020, ["Cole, Ana", "Dan Eng"], ["k1"]), ("Second", None, 0, [], [])]
    bib = '@comment{x}\n@inproceedings{k1,\n title = {A {Nested} title},\n author = "Cole, Ana and Dan Eng",\n year = 2019, booktitle = {Conf},\n}\n@article{k2, title={B}, journal={J}, date={2018-01}}'
    rows = records.bibtex_records(spark.createDataFrame([(bib,), (None,)], "value string")).orderBy("title").collect()
    assert [(r.type, r.title, r.year, r.venue, r.authors) for r in rows] == [("CONF", "A Nested title", 2019, "Conf", ["Ana Cole", "Dan Eng"]), ("JOUR", "B", 2018, "J", [])]
    with pytest.raises(ValueError, match="unsupported"):
        records.import_auto(spark, "x.docx")


def test_relationship_reply(spark):
    reply = F.lit('Sure: [{"a":0,"b":1,"type":"supports"},{"a":0,"b":9,"type":"extends"},{"a":1,"b":0,"type":"nope"}] ok')
    (r,) = one(spark, relations.parse_reply(reply, F.lit(2)))
    assert (r.a, r.b, r.type, r.confidence) == (0, 1, "SUPPORTS", 0.7)
