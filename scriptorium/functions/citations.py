"""Citation styles as Spark columns over names (array of full names), year, title, venue and doi."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import citation_name, cite_key, escape_xml, last_name

UNKNOWN = "Unknown Author"


def _present(c: Column, text: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", text).otherwise("")


def _year(year: Column) -> Column:
    return F.when(year > 0, year.cast("string")).otherwise("n.d.")


def _names(names: Column) -> tuple[Column, Column, Column]:
    names = F.coalesce(names, F.array().cast("array<string>"))
    cited = F.transform(names, citation_name)
    return names, cited, F.size(names)


def apa(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    _, cited, n = _names(names)
    last = F.element_at(cited, -1)
    many = F.concat(F.array_join(F.slice(cited, 1, 19), ", "), F.lit(", ... "), last)
    some = F.concat(F.array_join(F.slice(cited, 1, n - 1), ", "), F.lit(", & "), last)
    who = F.when(n == 0, UNKNOWN).when(n == 1, F.get(cited, F.lit(0))).when(n <= 20, some).otherwise(many)
    return F.trim(F.concat(who, F.lit(" ("), _year(year), F.lit("). "), F.coalesce(F.concat(title, F.lit(". ")), F.lit("")), _present(venue, F.concat(venue, F.lit(". "))), _present(doi, F.concat(F.lit("https://doi.org/"), doi))))


def mla(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    names, cited, n = _names(names)
    first = F.get(cited, F.lit(0))
    who = F.when(n == 0, UNKNOWN).when(n == 1, first).when(n == 2, F.concat(first, F.lit(", and "), F.get(names, F.lit(1)))).otherwise(F.concat(first, F.lit(", et al")))
    return F.trim(F.concat(who, F.lit(". "), F.coalesce(F.concat(F.lit('"'), title, F.lit('." ')), F.lit("")), _present(venue, F.concat(venue, F.lit(", "))), F.when(year > 0, F.concat(year.cast("string"), F.lit(". "))).otherwise(""), _present(doi, F.concat(F.lit("https://doi.org/"), doi))))


def ieee(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    names, _, n = _names(names)

    def initials_first(name: Column) -> Column:
        parts = F.split(F.trim(name), r"\s+")
        return F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.substring(p, 1, 1), F.lit(". "))), ""), F.element_at(parts, -1))

    short = F.transform(names, initials_first)
    who = F.when(n == 0, UNKNOWN).when(n == 1, F.get(short, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(short, 1, n - 1), ", "), F.lit(", and "), F.element_at(short, -1)))
    return F.trim(F.concat(who, F.lit(", "), F.coalesce(F.concat(F.lit('"'), title, F.lit('," ')), F.lit("")), _present(venue, F.concat(venue, F.lit(", "))), F.when(year > 0, F.concat(year.cast("string"), F.lit("."))).otherwise(""), _present(doi, F.concat(F.lit(" doi: "), doi, F.lit(".")))))


def harvard(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    _, cited, n = _names(names)
    few = F.concat(F.array_join(F.slice(cited, 1, n - 1), ", "), F.lit(", and "), F.element_at(cited, -1))
    who = F.when(n == 0, UNKNOWN).when(n == 1, F.get(cited, F.lit(0))).when(n <= 3, few).otherwise(F.concat(F.get(cited, F.lit(0)), F.lit(" et al.")))
    return F.trim(F.concat(who, F.lit(" ("), _year(year), F.lit(") "), F.coalesce(F.concat(F.lit("'"), title, F.lit("', ")), F.lit("")), _present(venue, F.concat(venue, F.lit(". "))), _present(doi, F.concat(F.lit("Available at: https://doi.org/"), doi))))


def _lines(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def _field(c: Column, before: str, after: str = "") -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))


def bibtex(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """An article entry: key from the first author's last name and the year."""
    fields = F.filter(
        F.array(
            F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.concat(F.lit("  author = {"), F.array_join(names, " and "), F.lit("}"))),
            F.when(title.isNotNull(), F.concat(F.lit("  title = {"), title, F.lit("}"))),
            _field(venue, "  journal = {", "}"),
            F.when(year > 0, F.concat(F.lit("  year = {"), year.cast("string"), F.lit("}"))),
            _field(doi, "  doi = {", "}"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.lit("@article{"), cite_key(names, year), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def latex(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    return F.concat(F.lit("\\cite{"), cite_key(names, year), F.lit("}\n\n"), bibtex(names, year, title, venue, doi))


def ris(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    authors = F.array_join(F.transform(names, lambda x: F.concat(F.lit("AU  - "), x)), "\n")
    return _lines(F.lit("TY  - JOUR"), F.nullif(authors, F.lit("")), F.concat(F.lit("TI  - "), title), _field(venue, "JO  - "), F.when(year > 0, F.concat(F.lit("PY  - "), year.cast("string"))), _field(doi, "DO  - "), F.lit("ER  - "))


def word_xml(names: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """A bibliography source of the office document schema."""
    tag = F.concat(F.coalesce(F.regexp_replace(last_name(F.get(names, F.lit(0))), "[^a-zA-Z]", ""), F.lit("Unknown")), F.when(year > 0, year.cast("string")).otherwise(""))
    person = lambda x: F.concat(F.lit("<b:Person><b:Last>"), escape_xml(last_name(x)), F.lit("</b:Last><b:First>"), escape_xml(F.trim(F.replace(x, last_name(x), F.lit("")))), F.lit("</b:First></b:Person>"))
    people = F.when(F.size(names) > 0, F.concat(F.lit("<b:Author><b:Author><b:NameList>"), F.array_join(F.transform(names, person), ""), F.lit("</b:NameList></b:Author></b:Author>")))
    element = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<b:{name}>"), escape_xml(c), F.lit(f"</b:{name}>")))
    return _lines(F.lit('<b:Source xmlns:b="http://schemas.openxmlformats.org/officeDocument/2006/bibliography">'), element("Tag", tag), F.lit("<b:SourceType>JournalArticle</b:SourceType>"), people, element("Title", title), element("JournalName", venue), F.when(year > 0, element("Year", year.cast("string"))), element("DOI", doi), F.lit("</b:Source>"))
