"""Text functions as Spark columns. All are built-in expressions; none runs Python on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium import config

SEPARATORS = r"""\s,;:!?()\[\]{}"'"""


#: Common characters that are no part of a word and separate nothing; deleting them in one pass leaves the regular expression little to do.
DELETED = "".join(chr(c) for c in (*range(33, 127), *range(0xA1, 0x100)) if not (chr(c).isalnum() and c < 128) and chr(c) not in ",;:!?()[]{}\"'-" and chr(c) not in config.ASCII_FROM)


def ascii_text(text: Column, deleted: str = "") -> Column:
    """Lower case, with dashes, quotes and Greek letters in ASCII, and without the characters to delete."""
    return reduce(lambda t, g: F.replace(t, F.lit(g[0]), F.lit(g[1])), config.GREEK, F.translate(F.lower(text), config.ASCII_FROM + deleted, config.ASCII_TO))


def token_array(text: Column) -> Column:
    """Words of a text: split at separators, reduced to a-z, 0-9 and hyphens; without numbers, stop words and most single characters.

    Unwanted words go in one pass of a regular expression over the text, which is far cheaper than a test of each word.
    """
    kept = F.regexp_replace(ascii_text(F.coalesce(text, F.lit("")), DELETED), f"[^a-z0-9\\-{SEPARATORS}]+", "")
    single = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in config.PROTECTED)
    unwanted = "|".join(["[0-9]+", rf"[{single}\-]", *sorted((w for w in config.STOP_WORDS if len(w) > 1), reverse=True)])
    words = F.split(F.regexp_replace(kept, rf"(?<![a-z0-9\-])(?:{unwanted})(?![a-z0-9\-])", ""), f"[{SEPARATORS}]+")
    return F.array_remove(words, "")


def token_sql(text: str) -> str:
    """The same in DuckDB, as an independent expression."""
    sep = SEPARATORS.replace("'", "''")
    mapped = f"translate(lower(coalesce({text}, '')), '{config.ASCII_FROM}', '{config.ASCII_TO.replace(chr(39), chr(39) * 2)}')"
    for a, b in config.GREEK:
        mapped = f"replace({mapped}, '{a}', '{b}')"
    stop, protected = (", ".join(f"'{w}'" for w in x) for x in (config.STOP_WORDS, config.PROTECTED))
    words = f"list_transform(string_split_regex({mapped}, '[{sep}]+'), lambda w: regexp_replace(w, '[^a-z0-9\\-]', '', 'g'))"
    return f"list_filter({words}, lambda w: NOT regexp_full_match(w, '[0-9]*') AND w NOT IN ({stop}) AND (length(w) > 1 OR w IN ({protected})))"


def query_keywords(text: Column, limit: int = 12) -> Column:
    """Distinct words in order of first use: short ones only if listed or with a digit."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    keep = F.filter(words, lambda w: ~w.isin(*config.STOP_WORDS) & ((F.length(w) > 2) | w.isin(*config.SHORT_KEYWORDS) | w.rlike("[0-9]")))
    return F.slice(F.array_distinct(keep), 1, limit)


def sentences(text: Column) -> Column:
    """Sentences of over 20 characters; the whole text if there are none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def chunks(text: Column, size: int = 400, step: int = 300) -> Column:
    """Overlapping chunks of words; the last one reaches the end."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def clean_text(html: Column) -> Column:
    """Line breaks and tags out, blanks collapsed; empty becomes null."""
    flat = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), "<[^>]*>", "")
    return F.nullif(F.trim(F.regexp_replace(flat, "[ \\t\\n\\r]+", " ")), F.lit(""))


def clean_abstract(html: Column) -> Column:
    """Like clean_text, but blank lines keep paragraphs apart."""
    flat = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), "<[^>]*>", "")
    paragraphs = F.transform(F.split(flat, "\n[ \\t\\r]*\n"), lambda p: F.trim(F.regexp_replace(p, "[ \\t\\n\\r]+", " ")))
    return F.nullif(F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n"), F.lit(""))


def table_gaps(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{3,}", " | ")


def last_name(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def citation_name(name: Column) -> Column:
    """"Smith, J. A." from "John Adam Smith"."""
    parts = F.split(F.trim(name), r"\s+")
    initials = F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.substring(p, 1, 1), F.lit("."))), " ")
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat_ws(", ", F.element_at(parts, -1), initials))


def short_authors(names: Column) -> Column:
    n = F.size(F.coalesce(names, F.array().cast("array<string>")))
    return F.when(n == 0, "Unknown").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.array_join(names, " & ")).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def full_authors(names: Column) -> Column:
    joined = F.array_join(F.coalesce(names, F.array().cast("array<string>")), ", ")
    return F.when(joined == "", "Unknown Authors").otherwise(joined)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9 \t\n\r]", ""))


def synthetic_id(title: Column, year: Column) -> Column:
    """"local-" and the absolute 31-polynomial hash of the title and year, in 32 bits."""
    codes = F.filter(F.split(F.concat(F.lower(F.trim(title)), year.cast("string")), ""), lambda c: c != "")
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % (1 << 32))
    return F.concat(F.lit("local-"), F.abs(F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)).cast("string"))


def cite_key(names: Column, year: Column) -> Column:
    own = F.regexp_replace(F.lower(F.coalesce(last_name(F.get(names, F.lit(0))), F.lit(""))), "[^a-z]", "")
    return F.concat(F.when(own == "", "unknown").otherwise(own), F.when(year > 0, year.cast("string")).otherwise(""))


def escape_csv(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def escape_xml(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.coalesce(text, F.lit("")))


def escape_latex(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([&%$#_])", r"\\$1")


def unescape_latex(text: Column) -> Column:
    """Accent commands and braces out."""
    return F.regexp_replace(F.regexp_replace(text, r"\\[`'^\"~=.]\{?([A-Za-z])\}?", "$1"), r"[{}]", "")


def first_year(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "([0-9]{4})", 1), F.lit("")).cast("int"), F.lit(0))


def identifier_type(value: Column) -> Column:
    v = F.trim(value)
    return F.when(v.rlike(r"^(https?://(dx\.)?doi\.org/)?10\.[0-9]+/"), "DOI").when(v.rlike(r"^(?i:arxiv:)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"), "ARXIV").when(v.rlike(r"^[0-9]{1,8}$"), "PMID").otherwise("UNKNOWN")


def classifier_tokens(value: Column) -> Column:
    """The distinct words of three letters or more, split at all but a-z, 0-9 and hyphens, without stop words."""
    words = F.split(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*config.STOP_WORDS)))


def clean_author(name: Column) -> Column:
    """Tags out, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "<[^>]*>", ""), "[ \\t\\n\\r]+", " "))


def truncated(value: Column, n: int) -> Column:
    """At most n characters, with three dots where some were cut."""
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit("..."))).otherwise(value)
