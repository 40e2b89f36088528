"""Scores and labels of papers as Spark columns. Ages count from as_of, never from the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium import config


def recency(year: Column, as_of: int) -> Column:
    age = F.greatest(F.lit(as_of) - year, F.lit(0))
    return F.when(F.coalesce(year, F.lit(0)) <= 0, 30.0).when(age == 0, 100.0).when(age <= 2, 95.0).when(age <= 5, 85.0).otherwise(F.greatest(F.lit(10.0), 80 * F.exp(-age / 15.0)))


def citation_score(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 5.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(5.0), F.log10(count.cast("double")) / 3 * 90)))


def relevance(keywords: Column, title: Column, body: Column) -> Column:
    """Share of keywords in the text, with a bonus for the title; keywords: array of lower-cased words."""
    # the text is lower-cased once, not for each keyword: it is bound as the element of an array
    found = lambda text: F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: F.size(F.filter(keywords, lambda k: F.contains(low, k))))[0]
    n = F.size(keywords)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(100.0), (found(F.concat_ws(" ", title, body)) * 100.0 + found(title) * 25.0) / F.least(F.lit(8), n)))


def author_boost(query_words: Column, author_words: Column) -> Column:
    return F.least(F.lit(40.0), F.size(F.filter(query_words, lambda w: F.array_contains(author_words, w))) * 15.0)


def quality_label(year: Column, count: Column, as_of: int) -> Column:
    age = F.lit(as_of) - year
    rate = count / F.greatest(F.lit(1), age)
    return (
        F.when((age >= 10) & (count < 100), "Outdated")
        .when((age >= 5) & (count < 20), "Outdated")
        .when((count >= 100) | (rate >= 20) | ((age <= 2) & (count >= 5)), "Strong")
        .when((rate >= 5) | (age <= 3), "Good")
        .otherwise("Consider")
    )


def quality_flags(year: Column, count: Column, abstract: Column, doi: Column, as_of: int) -> Column:
    """Array of flags; a paper without citations gets no impact flag, as the published rule has it."""
    age = F.lit(as_of) - year
    rate = count / F.greatest(F.lit(1), age)
    known = year > 0
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    flags = F.array(
        F.when(known & (age >= 10), "VERY_OLD").when(known & (age >= 5), "OLD").when(known & (age <= 1), "RECENT"),
        F.when(known & (count > 0) & (rate >= 50), "HIGH_IMPACT").when(known & (count > 0) & (rate >= 20), "GOOD_IMPACT"),
        F.when(blank(abstract), "NO_ABSTRACT"),
        F.when(blank(doi), "NO_DOI"),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def venue_quality(venue: Column, venues: dict[str, float] = config.VENUES, default: float = config.VENUE_DEFAULT) -> Column:
    """Exact name, else the longest (then alphabetically first) key that contains the name or lies in it."""
    v = F.lower(F.trim(F.coalesce(venue, F.lit(""))))
    keys = sorted(venues, key=lambda k: (-len(k), k))
    case = F.when(v == "", default)
    for k in keys:
        case = case.when(v == k, venues[k])
    for k in keys:
        case = case.when(v.contains(k) | F.contains(F.lit(k), v), venues[k])
    return case.otherwise(default)


def strength(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Strong").when(score >= 40, "Moderate").otherwise("Weak")


def user_activity(favorite: Column, status: Column, notes: Column, added: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, added)
    recent = F.when((days >= 0) & (days <= 90), 0.1 * (1 - days / 90.0)).otherwise(0.0)
    read = F.when(status == "READ", 0.4).when(status == "READING", 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(favorite, 0.3).otherwise(0.0) + read + F.when(F.trim(F.coalesce(notes, F.lit(""))) != "", 0.2).otherwise(0.0) + F.coalesce(recent, F.lit(0.0)))


def severity(score: Column) -> Column:
    return F.when(score >= 75, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def evidence_band(value: Column) -> Column:
    return F.when(value >= 0.7, "HIGH").when(value >= 0.4, "MEDIUM").otherwise("LOW")


def rescaled(similarity: Column) -> Column:
    return F.when(similarity <= 0.4, 0.0).otherwise(F.pow((similarity - 0.4) / 0.6, 2))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
