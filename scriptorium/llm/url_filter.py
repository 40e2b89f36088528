"""URL verdicts: host and path rules first, then a weighted vocabulary.

An Aho-Corasick pass over the lower-cased url counts strict and soft terms that stand between non-alphanumeric
characters. One strict term, or SOFT_LIMIT distinct soft terms, rejects the url.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and the verdict of its terms
(allow for null); urls are read whole, and a term counts once however often it occurs; repeated rows and null ids give
a row each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.url_terms import SOFT_TERMS, STRICT_TERMS

#: (host, path, verdict); the longest that fits decides. Fixed values of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SOFT_LIMIT = 2


def automaton(strict=STRICT_TERMS, soft=SOFT_TERMS):
    import ahocorasick

    a = ahocorasick.Automaton()
    for weight, words in ((1, soft), (SOFT_LIMIT, strict)):
        for w in words:
            a.add_word(w, (w, weight))
    a.make_automaton()
    return a


def term_weight(url: str, terms) -> tuple[int, int]:
    """(distinct strict terms, distinct soft terms) with boundaries on both sides."""
    seen = {}
    for last, (word, weight) in terms.iter(url):
        start = last - len(word) + 1
        if (start == 0 or not url[start - 1].isalnum()) and (last + 1 == len(url) or not url[last + 1].isalnum()):
            seen[word] = weight
    strict = sum(w >= SOFT_LIMIT for w in seen.values())
    return strict, len(seen) - strict


def split_url(url):
    """(host, path) columns of a url column."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host, path, rules=RULES):
    """(rule, verdict) columns: the longest rule that fits, else nulls. Equal lengths: the alphabetically first."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft) for each row of pages."""
    kind = pages.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for b in it:
            hits = [term_weight(u.lower(), terms) if u else (0, 0) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["id", "url", "n_strict", "n_soft"])

    scored = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(batches, f"id {kind}, url string, n_strict long, n_soft long")
    host, path = split_url(F.coalesce("url", F.lit("")))
    parts = scored.withColumns({"host": host, "path": path})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= SOFT_LIMIT), "block").otherwise("allow")
    return parts.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft")


def oracle() -> str:
    """The same in DuckDB, over the distinct runs of letters and digits of a url."""
    host = "translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # a term between boundaries is a whole run of letters and digits
    hits = lambda terms: f"CAST(len(list_intersect(runs, [{', '.join(repr(t) for t in terms)}])) AS BIGINT)"
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p if what == 'rule' else v}'" for h, p, v in order) + " END"
    return f"""
    WITH a AS (SELECT page_id, regexp_extract_all(lower(coalesce(url, '')), '[\\p{{L}}\\p{{N}}]+') AS runs, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path,
      {hits(STRICT_TERMS)} AS n_strict, {hits(SOFT_TERMS)} AS n_soft FROM a)
    SELECT page_id, host, path, {case("rule")} AS rule,
      coalesce({case("verdict")}, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM b"""
