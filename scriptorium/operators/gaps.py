"""Research gaps over clusters of papers.

Inputs: cluster (paper_id, cluster), entities (paper_id, entity_type, entity_value), years (paper_id, year) and edges
(a, b) between papers. The tables of clusters and pairs of clusters are small; those of papers are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.scoring import evidence_band, jaccard, severity
from scriptorium.storage import saved

#: How new a gap of each type is at best, and what the trend of its papers promises. Fixed values.
BOOST = {"TOPIC": 0.6, "METHODOLOGY_TRANSFER": 0.8, "TEMPORAL_DORMANT": 0.7, "TEMPORAL_DECLINING": 0.5, "INTERDISCIPLINARY": 0.9}
TREND = {"GROWING": 0.9, "STABLE": 0.6, "DECLINING": 0.4, "DORMANT": 0.7}


#: Papers of a method that are paired with the others in one task.
METHOD_PIECE = 1024


@dataclass
class Context:
    """What the analysers read; each is computed once by the caller and may be cached there."""

    cluster: DataFrame
    entities: DataFrame
    years: DataFrame
    edges: DataFrame
    as_of: int
    #: (paper_id, venue, citations): a score of the paper's venue and its citations, where known.
    quality: DataFrame | None = None


def sizes(c: Context) -> DataFrame:
    return c.cluster.groupBy("cluster").agg(F.countDistinct("paper_id").alias("papers"))


def cluster_entities(c: Context) -> DataFrame:
    """(cluster, entity_type, entity_value), distinct."""
    return c.entities.join(c.cluster, "paper_id").select("cluster", "entity_type", "entity_value").distinct()


def method_counts(c: Context) -> DataFrame:
    return c.entities.filter(F.col("entity_type") == "METHOD").join(c.cluster, "paper_id").groupBy("cluster", F.col("entity_value").alias("method")).agg(F.countDistinct("paper_id").alias("papers"))


def cluster_pairs(c: Context) -> DataFrame:
    """(x, y, papers_x, papers_y) for x < y: the clusters are few."""
    s = sizes(c)
    return s.toDF("x", "papers_x").join(s.toDF("y", "papers_y"), F.col("x") < F.col("y"))


def cross_edges(c: Context) -> DataFrame:
    """(x, y, links): edges between two clusters, unordered."""
    of = c.cluster.select(F.col("paper_id"), F.col("cluster"))
    rows = c.edges.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").filter("ca <> cb")
    return rows.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.count("*").alias("links"))


def bridge_papers(c: Context) -> DataFrame:
    """(x, y, bridges): papers outside both clusters with a neighbour in each."""
    of = c.cluster.select(F.col("paper_id"), F.col("cluster"))
    step = c.edges.select("a", "b").union(c.edges.select("b", "a"))
    seen = step.join(of.toDF("b", "near"), "b").select("a", "near").distinct()
    pairs = seen.toDF("a", "x").join(seen.toDF("a", "y"), "a").filter("x < y").join(of.toDF("a", "own"), "a", "left")
    outside = pairs.filter(F.col("own").isNull() | ((F.col("own") != F.col("x")) & (F.col("own") != F.col("y"))))
    return outside.groupBy("x", "y").agg(F.countDistinct("a").alias("bridges"))


def entity_overlap(c: Context) -> DataFrame:
    """(x, y, shared, overlap) over pairs of clusters: the Jaccard of their entities, counted by an equi-join on entities."""
    e = cluster_entities(c)
    sizes = e.groupBy("cluster").agg(F.count("*").alias("n"))
    value = ["entity_type", "entity_value"]
    both = e.withColumnRenamed("cluster", "x").join(e.withColumnRenamed("cluster", "y"), value).filter("x < y").groupBy("x", "y").agg(F.count("*").alias("shared"))
    p = cluster_pairs(c).join(both, ["x", "y"], "left").join(sizes.toDF("x", "nx"), "x", "left").join(sizes.toDF("y", "ny"), "y", "left")
    none = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    shared, union = none("shared"), none("nx") + none("ny") - none("shared")
    return p.select("x", "y", "papers_x", "papers_y", shared.alias("shared"), F.when(union > 0, shared / union).otherwise(0.0).alias("overlap"))


def topic_gaps(c: Context, least_papers: int = 3, least_overlap: float = 0.05, most_density: float = 0.10) -> DataFrame:
    """(gap_id, x, y, confidence, evidence): clusters with common entities and few links."""
    rows = entity_overlap(c).join(cross_edges(c), ["x", "y"], "left").withColumn("density", F.coalesce("links", F.lit(0)) / (F.col("papers_x") * F.col("papers_y")))
    rows = rows.filter((F.col("papers_x") >= least_papers) & (F.col("papers_y") >= least_papers) & (F.col("overlap") >= least_overlap) & (F.col("density") <= most_density) & (F.col("shared") > 0))
    return rows.select(F.concat_ws(":", F.lit("TOPIC"), "x", "y").alias("gap_id"), "x", "y", F.least(F.lit(1.0), 2 * F.col("overlap") * (1 - F.col("density"))).alias("confidence"), F.col("overlap").alias("evidence"))


def cluster_years(c: Context) -> DataFrame:
    return c.cluster.join(c.years, "paper_id").filter("year > 0").groupBy("cluster", "year").agg(F.count("*").alias("n"))


def trend_lines(counts: DataFrame, key: str, as_of: int) -> DataFrame:
    """(key, peak, peak_year, last_year, recent, total, trend) from (key, year, n): the earliest of equal peaks counts."""
    peak = F.max(F.struct("n", (-F.col("year")).alias("minus")))
    t = counts.groupBy(key).agg(
        peak["n"].alias("peak"), (-peak["minus"]).alias("peak_year"), F.max("year").alias("last_year"), (F.sum(F.when(F.col("year").between(as_of - 2, as_of), F.col("n")).otherwise(0)) / 3).alias("recent"), F.sum("n").alias("total")
    )
    trend = F.when(F.lit(as_of) - F.col("last_year") >= 3, "DORMANT").when(F.col("recent") >= 0.8 * F.col("peak"), "GROWING").when(F.col("recent") >= 0.4 * F.col("peak"), "STABLE").otherwise("DECLINING")
    return t.withColumn("trend", trend)


def timelines(c: Context) -> DataFrame:
    return trend_lines(cluster_years(c), "cluster", c.as_of)


def temporal_gaps(c: Context, least_papers: int = 3, least_peak: int = 2) -> DataFrame:
    t = timelines(c).join(sizes(c), "cluster").filter((F.col("papers") >= least_papers) & (F.col("peak") >= least_peak))
    silent = F.lit(c.as_of) - F.col("last_year")
    ratio = F.col("recent") / F.col("peak")
    confidence = F.when(silent >= 3, F.least(F.lit(1.0), 0.5 + 0.1 * silent + 0.02 * F.col("papers"))).when(ratio < 0.5, F.least(F.lit(1.0), 0.3 + 0.5 * (1 - ratio) + 0.01 * F.col("papers")))
    return t.select(F.concat_ws(":", F.lit("TEMPORAL"), "cluster").alias("gap_id"), "cluster", "trend", confidence.alias("confidence"), (silent >= 3).alias("dormant"), F.when(silent >= 3, 0.8).otherwise(0.7).alias("evidence")).filter("confidence IS NOT NULL")


def method_transfer(c: Context, least_papers: int = 2, least_overlap: float = 0.03) -> DataFrame:
    """(gap_id, method, source, target, confidence, evidence, papers): methods of one cluster that another, alike, lacks."""
    have = method_counts(c)
    o = entity_overlap(c).filter(F.col("overlap") >= least_overlap)
    ways = o.select(F.col("x").alias("source"), F.col("y").alias("target"), "overlap").union(o.select("y", "x", "overlap"))
    rows = have.filter(F.col("papers") >= least_papers).withColumnRenamed("cluster", "source").join(ways, "source")
    missing = rows.join(have.select(F.col("cluster").alias("target"), "method"), ["target", "method"], "left_anti")
    return missing.select(F.concat_ws(":", F.lit("METHODOLOGY_TRANSFER"), "method", "target").alias("gap_id"), "method", "source", "target", F.least(F.lit(1.0), 3 * F.col("overlap") + F.col("papers") / 10).alias("confidence"), F.col("overlap").alias("evidence"), "papers")


def interdisciplinary_gaps(c: Context, least_papers: int = 5, least_span: int = 2, least_similarity: float = 0.08, most_bridges: int = 2) -> DataFrame:
    span = cluster_years(c).groupBy("cluster").agg((F.max("year") - F.min("year")).alias("span"))
    rows = entity_overlap(c).join(span.toDF("x", "sx"), "x").join(span.toDF("y", "sy"), "y").join(bridge_papers(c), ["x", "y"], "left").withColumn("bridges", F.coalesce("bridges", F.lit(0)))
    rows = rows.filter((F.least("papers_x", "papers_y") >= least_papers) & (F.least("sx", "sy") >= least_span) & (F.col("overlap") >= least_similarity) & (F.col("bridges") <= most_bridges))
    return rows.select(F.concat_ws(":", F.lit("INTERDISCIPLINARY"), "x", "y").alias("gap_id"), "x", "y", F.least(F.lit(1.0), 3 * F.col("overlap") + 0.3 / (F.col("bridges") + 1)).alias("confidence"), F.col("overlap").alias("evidence"))


def all_gaps(c: Context, least_papers: int = 5) -> DataFrame:
    """(gap_id, gap_type, clusters, confidence, evidence, supporting) of the four analysers, the most confident of each id; none for a tiny library.

    evidence: how sure the gap's one piece of evidence is; supporting: its papers, null where these are all of the clusters.
    """
    many = c.cluster.agg(F.count("*").alias("__n")).filter(F.col("__n") >= least_papers)
    every = F.lit(None).cast("long")
    part = lambda df, kind, supporting, *columns: df.select("gap_id", kind.alias("gap_type"), F.array(*columns).alias("clusters"), "confidence", "evidence", supporting.alias("supporting"))
    found = part(topic_gaps(c), F.lit("TOPIC"), every, "x", "y")
    found = found.union(part(temporal_gaps(c), F.when(F.col("dormant"), "TEMPORAL_DORMANT").otherwise("TEMPORAL_DECLINING"), every, "cluster"))
    found = found.union(part(method_transfer(c), F.lit("METHODOLOGY_TRANSFER"), F.col("papers"), "source", "target"))
    found = found.union(part(interdisciplinary_gaps(c), F.lit("INTERDISCIPLINARY"), every, "x", "y"))
    best = F.row_number().over(Window.partitionBy("gap_id").orderBy(F.desc("confidence"), "clusters"))
    return found.withColumn("n", best).filter("n = 1").drop("n").crossJoin(F.broadcast(many)).drop("__n")  # one row or none


def opportunity_score(kind: Column, confidence: Column, coverage: Column, evidence: Column, supporting: Column, venue: Column, trend: Column) -> Column:
    """0..100 from novelty, evidence, trend and confidence.

    coverage: the share of the library that the gap affects, null for an empty library; evidence: the mean confidence of
    its pieces of evidence, null without any; venue: the mean score of the affected papers' venues, null if unknown.
    """
    from itertools import chain

    boost = F.create_map(*[F.lit(x) for x in chain(*BOOST.items())])
    trends = F.create_map(*[F.lit(x) for x in chain(*TREND.items())])
    novelty = F.when(coverage.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.coalesce(boost[kind], F.lit(0.5)) * (1 - 0.5 * coverage)))
    support = F.when(evidence.isNull(), 0.3).otherwise(0.4 * evidence + 0.3 * F.least(F.lit(1.0), supporting / 20) + 0.3 * F.coalesce(venue, F.lit(0.5)))
    return F.least(F.lit(100.0), 100 * (0.35 * novelty + 0.25 * support + 0.20 * F.coalesce(trends[trend], F.lit(0.5)) + 0.20 * confidence))


def evidence_value(papers: Column, venues: Column, citations: Column) -> Column:
    """0..1 from the sums of venue scores and citations of so many papers, of which some may be unknown; 0 without papers."""
    return F.when(papers > 0, 0.4 * venues / papers + 0.3 * F.least(F.lit(1.0), F.log10(citations + 1.0) / 3) + 0.3 * F.least(F.lit(1.0), papers / 20)).otherwise(0.0)


def cluster_quality(c: Context) -> DataFrame:
    """(cluster, papers, venues, known, citations): sums over the cluster's papers; known: those whose venue has a score."""
    rows = c.cluster.select("paper_id", "cluster").distinct()
    rows = rows.join(c.quality, "paper_id", "left") if c.quality is not None else rows.withColumns({"venue": F.lit(None).cast("double"), "citations": F.lit(0)})
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return rows.groupBy("cluster").agg(F.count("*").alias("papers"), zero("venue").alias("venues"), F.count("venue").alias("known"), zero("citations").alias("citations"))


def evaluated(c: Context, gaps: DataFrame, promote: float = 20) -> DataFrame:
    """gaps with affected papers, score, severity, evidence band and whether each is an opportunity.

    Methodology-transfer gaps affect no papers, as the published behaviour has it. The trend is that of all papers of the
    gap's clusters, of a transfer's source alone.
    """
    gaps = saved(gaps, "gaps")  # read several times below
    of = gaps.select("gap_id", "gap_type", F.posexplode("clusters").alias("place", "cluster"))
    sums = of.filter("gap_type <> 'METHODOLOGY_TRANSFER'").join(cluster_quality(c), "cluster").groupBy("gap_id").agg(*[F.sum(x).alias(x) for x in ("papers", "venues", "known", "citations")])
    years = of.filter("gap_type <> 'METHODOLOGY_TRANSFER' OR place = 0").join(cluster_years(c), "cluster").groupBy("gap_id", "year").agg(F.sum("n").alias("n"))
    trend = trend_lines(years, "gap_id", c.as_of).select("gap_id", "trend")
    total = F.broadcast(c.cluster.agg(F.countDistinct("paper_id").alias("total")))  # one row
    g = gaps.join(sums, "gap_id", "left").join(trend, "gap_id", "left").crossJoin(total).fillna(0, ["papers", "venues", "known", "citations"])
    venue = F.when(F.col("known") > 0, F.col("venues") / F.col("known"))
    coverage = F.when(F.col("total") > 0, F.col("papers") / F.col("total"))
    score = opportunity_score(F.col("gap_type"), F.col("confidence"), coverage, F.col("evidence"), F.coalesce("supporting", "papers"), venue, F.coalesce("trend", F.lit("DORMANT")))
    strength = evidence_value(F.col("papers"), F.col("venues"), F.col("citations"))
    nearest = lambda x: F.round(x + 1e-9, 6)  # noqa: E731  halves go up, whatever the last bit of the sum
    g = g.withColumn("score", nearest(score)).withColumn("strength", nearest(strength))
    return g.select("gap_id", "gap_type", F.round("confidence", 6).alias("confidence"), F.col("papers").cast("long").alias("papers"), "score", severity(F.col("score")).alias("severity"), evidence_band(F.col("strength")).alias("evidence"), (F.col("score") >= promote).alias("is_opportunity"), F.when(F.col("papers") > 0, 1.0).otherwise(0.0).alias("readiness"))


def type_counts(gaps: DataFrame) -> DataFrame:
    """(gap_type, n) over all types, zeros included."""
    kinds = gaps.sparkSession.createDataFrame([(k,) for k in BOOST], "gap_type string")
    return kinds.join(gaps.groupBy("gap_type").agg(F.count("*").alias("n")), "gap_type", "left").select("gap_type", F.coalesce("n", F.lit(0)).alias("n"))


def method_links(c: Context, first: int | None = None) -> DataFrame:
    """(a, b, methods): papers that share a method and no edge. Pairs come from the methods that both have.

    The papers of a frequent method are dealt over keys of METHOD_PIECE papers each, so that no task holds them all. With
    `first`, the result is the first so many pairs in the order of a, b: then only the papers of smallest ids are paired
    with all others, ever more of them until there are so many pairs.
    """
    m = c.entities.filter(F.col("entity_type") == "METHOD").select("paper_id", F.col("entity_value").alias("m")).distinct()
    known = c.edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if first is not None:
        m = saved(m, "methods")
        ids, taken = m.select(F.col("paper_id").alias("a")).distinct(), 4
        while True:
            lowest = ids.orderBy("a").limit(taken)
            left = F.broadcast(m.select(F.col("paper_id").alias("a"), "m").join(F.broadcast(lowest), "a", "left_semi"))  # `taken` papers
            pairs = m.select(F.col("paper_id").alias("b"), "m").join(left, "m").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("methods"))
            near = known.join(F.broadcast(lowest), "a", "left_semi")
            best = saved(pairs.join(near, ["a", "b"], "left_anti").select("a", "b", "methods").orderBy("a", "b").limit(first), "method-links")
            if best.count() == first or lowest.count() < taken:
                return best
            taken *= 8
    pieces = m.groupBy("m").agg(F.ceil(F.count("*") / METHOD_PIECE).cast("int").alias("pieces"))
    m = m.join(pieces, "m")
    left = m.select(F.col("paper_id").alias("a"), "m", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    right = m.select(F.col("paper_id").alias("b"), "m", F.pmod(F.xxhash64("paper_id"), F.col("pieces")).cast("int").alias("piece"))
    pairs = left.join(right, ["m", "piece"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("methods"))
    return pairs.join(known, ["a", "b"], "left_anti")


def summary(kind: Column, clusters: Column, confidence: Column) -> Column:
    """One sentence on a gap."""
    where = F.array_join(clusters, " and ")
    say = {"TOPIC": "Few links join %s", "TEMPORAL_DORMANT": "Work on %s has stopped", "TEMPORAL_DECLINING": "Work on %s has slowed", "METHODOLOGY_TRANSFER": "A method may move between %s", "INTERDISCIPLINARY": "Little bridges %s"}
    text = F.lit("Unexplored: %s")
    for k, v in say.items():
        text = F.when(kind == k, v).otherwise(text)
    return F.concat(F.replace(text, F.lit("%s"), where), F.lit(" (confidence "), F.round(confidence * 100).cast("long").cast("string"), F.lit("%)."))
