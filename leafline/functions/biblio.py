"""Reference strings from bibliography fields, as Column expressions over map<string,string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sentence, strip

# Fields that name a venue, the most specific first.
VENUES = "journal booktitle eventtitle conference event publisher institution school organization howpublished".split()


def _get(fields: Column, *names: str) -> Column:
    return F.coalesce(*(strip(fields[n]) for n in names), F.lit(""))


def _full(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def venue(fields: Column) -> Column:
    return F.coalesce(*(F.nullif(strip(fields[n]), F.lit("")) for n in VENUES), F.lit(""))


def author_list(names: Column) -> Column:
    """``A, B, and C`` of an array."""
    some = F.filter(F.transform(names, strip), lambda x: x != "")
    return F.when(F.size(some) > 1, F.concat(F.array_join(F.slice(some, 1, F.size(some) - 1), ", "), F.lit(", and "), F.element_at(some, -1))).otherwise(F.array_join(some, ""))


def author_text(fields: Column) -> Column:
    return strip(F.replace(_get(fields, "authors", "author"), F.lit(" and others"), F.lit(" et al.")))


def author_short(raw: Column) -> Column:
    """``A``, ``A & B`` or ``A et al.`` from a BibTeX author field."""
    names = F.filter(F.transform(F.split(F.replace(raw, F.lit(" and others"), F.lit(" et al.")), " and "), strip), lambda x: x != "")
    last = lambda x: strip(F.split(x, ",")[0])
    n = F.size(names)
    first = last(F.try_element_at(names, F.lit(1)))
    second = F.try_element_at(names, F.lit(2))
    return F.when(n == 0, raw).when(n == 1, first).when((n == 2) & ~second.startswith("et al"), F.concat(first, F.lit(" & "), last(second))).otherwise(F.concat(first, F.lit(" et al.")))


def year_number(value: Column) -> Column:
    """Digit strings as numbers; other years are null here and stay text in the fields."""
    return F.when(strip(value).rlike(r"^\d+$"), strip(value).cast("int"))


def _doi(fields: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_get(fields, "doi"), r"^https://doi\.org/", ""), r"^doi:", "")


def plain(fields: Column) -> Column:
    """The plain profile."""
    authors, title, where = author_text(fields), _get(fields, "title"), venue(fields)
    volume, pages, year = _get(fields, "volume"), F.coalesce(strip(fields["pages"]), strip(fields["locator"]), F.lit("")), _get(fields, "year")
    put = lambda c, *shown: F.when(_full(c), F.concat(*shown)).otherwise("")
    tail = F.concat(where, put(volume, F.lit(" "), volume), put(pages, F.lit(", "), pages), put(year, F.lit(" ("), year, F.lit(")")), F.lit("."))
    parts = F.array(sentence(F.when(_full(authors), authors).otherwise("unknown")), F.when(_full(title), sentence(title)), F.when(_full(where), tail).when(_full(year), F.concat(F.lit("("), year, F.lit(")."))), F.when(_full(_get(fields, "doi")), F.concat(F.lit("https://doi.org/"), _doi(fields))))
    return F.when(_full(fields["raw"]), fields["raw"]).otherwise(F.array_join(F.array_compact(parts), " "))


def markdown_error(fields: Column) -> Column:
    """Why the Markdown profile cannot show a record, or null."""
    return F.when(_full(fields["raw"]), None).when(~_full(author_text(fields)), "author").when(year_number(fields["year"]).isNull(), "year").when(~_full(venue(fields)), "venue")


def markdown(fields: Column) -> Column:
    """The Markdown profile; null where markdown_error says why."""
    where, title = venue(fields), _get(fields, "title")
    volume, issue, locator = _get(fields, "volume"), _get(fields, "issue"), F.coalesce(F.nullif(strip(fields["locator"]), F.lit("")), strip(fields["pages"]), F.lit(""))
    put = lambda c, *shown: F.when(_full(c), F.concat(*shown)).otherwise("")
    tail = F.concat(F.lit("*"), where, F.lit("*, **"), year_number(fields["year"]).cast("string"), F.lit("**"), put(volume, F.lit(", *"), volume, F.lit("*")), put(issue, F.lit(" ("), issue, F.lit(")")), put(locator, F.lit(", "), locator), F.lit("."))
    bare = _full(_get(fields, "doi")) & ~_full(volume) & ~_full(issue) & ~_full(locator)
    parts = F.array(sentence(author_text(fields)), F.when(_full(title), sentence(title)), tail, F.when(bare, F.concat(F.lit("DOI: "), _doi(fields))))
    shown = F.when(_full(fields["raw"]), fields["raw"]).otherwise(F.array_join(F.array_compact(parts), " "))
    return F.when(markdown_error(fields).isNull(), shown)


#: Profiles by name; callers may add their own.
PROFILES = {"plain": plain, "markdown": markdown}


def format_entry(fields: Column, profile: str = "plain") -> Column:
    if profile not in PROFILES:
        raise ValueError(f"no bibliography profile is named {profile}")
    return PROFILES[profile](fields)
