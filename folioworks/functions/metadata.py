"""Metadata of a document: column functions over its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_TYPE, DOCUMENT_TYPES, HEADER_LINES, UNTITLED_DOCUMENT
from .arrays import bind
from .text import strip

# What titles, parties, places, dates and references look like.
TITLE = r"(?mdU)^#\s+([^\n]+)"
SUBTITLE = r"(?mdU)^##\s+([^\n]+)"
COMPANY = r"(?U)[Ss]ociété\s+dénommée\s+([A-Z][A-Za-z0-9\s\-']+?)\s+au\s+capital"
NAME = r"(?U)[A-Z][A-Za-z0-9\s\-']{5,}"
SIREN = r"SIREN\s+(?:sous\s+le\s+numéro\s+)?"
PLACES = [r"se\s+situe", r"située?", r"localisée?", r"sis"]
PLACE = r"\s+à\s+([A-Z][a-zA-Z\s\-]+)"
PLACE_END = r"\s+(dans|sur|par|pour)[^\n]*$"
DATES = [r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}-\d{2}-\d{2}"]
REFERENCES = [
    rf"(?iuU){SIREN}(\d{{9}})",
    r"(?U)[Pp]ermis\s+(?:de\s+construire\s+)?n°?\s*([A-Z0-9\-]+)",
    r"(?U)[Rr]éférence\s*:?\s*([A-Z0-9\-]+)",
    r"(?U)n°\s*([A-Z0-9\-]{5,})",
]
# The last character there is, written out, makes Java count characters, not halves of them, when it looks behind.
_ANY = rf"[\x{{0}}-{chr(0x10FFFF)}]"
BEFORE_SIREN = rf"(?iuU)(?={SIREN}\d{{9}})(?<=({_ANY}{{100}}|\A{_ANY}{{0,99}})){SIREN}\d{{9}}"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without a match (groups used here are never empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def header_of(text: Column) -> Column:
    """The first lines, where parties, location, date and reference are looked for."""
    return F.substring_index(text, "\n", HEADER_LINES)


def document_type(text: Column) -> Column:
    """First type one of whose words is part of the text."""
    has = lambda low, words: reduce(Column.__or__, [low.contains(w) for w in words])
    return bind(F.lower(text), lambda low: reduce(lambda rest, kind: F.when(has(low, DOCUMENT_TYPES[kind]), kind).otherwise(rest), reversed(DOCUMENT_TYPES), F.lit(DEFAULT_TYPE)))


def title(text: Column) -> Column:
    """First level-1 heading, else the first line, at most 150 characters."""
    line = strip(F.substring_index(text, "\n", 1))
    first = F.coalesce(F.nullif(F.substring(line, 1, 150), F.lit("")), F.lit(UNTITLED_DOCUMENT))
    return bind(F.regexp_extract(text, TITLE, 1), lambda heading: F.when(heading != "", F.substring(strip(heading), 1, 150)).otherwise(first))


def subtitle(text: Column) -> Column:
    """First level-2 heading or null."""
    return F.when(text.rlike(SUBTITLE), strip(F.regexp_extract(text, SUBTITLE, 1)))


def parties(header: Column) -> Column:
    """``array<struct<role, name>>``: companies with a capital, names near SIREN numbers; the first of each name.

    The 100 characters before a SIREN number are taken by looking behind, so that
    stretches before near numbers may overlap.
    """
    sold = F.regexp_extract_all(header, F.lit(COMPANY), F.lit(1))
    before = F.regexp_extract_all(header, F.lit(BEFORE_SIREN), F.lit(1))
    named = F.filter(F.transform(before, lambda x: F.regexp_extract(x, NAME, 0)), lambda x: x != "")
    other = F.when(F.lower(header).contains("siren"), named).otherwise(F.array().cast("array<string>"))
    party = lambda role: lambda name: F.struct(F.lit(role).alias("role"), strip(name).alias("name"))
    vendors, others = F.array_distinct(F.transform(sold, party("vendor"))), F.array_distinct(F.transform(other, party("other")))
    return bind(vendors, lambda v: F.concat(v, F.filter(others, lambda p: ~F.exists(v, lambda x: x["name"] == p["name"]))))


def location(header: Column) -> Column:
    """Place after one of four phrases, by priority; cut at a preposition and at the line end, at most 50 characters."""
    found = bind(header, lambda h: F.coalesce(*(_first(h, rf"(?iuU){p}{PLACE}") for p in PLACES)))
    cut = F.regexp_replace(strip(found), rf"(?dU){PLACE_END}", "")
    return F.substring(strip(F.get(F.split(cut, "\n"), F.lit(0))), 1, 50)


def date(header: Column) -> Column:
    """First date by priority of format, as written."""
    return bind(header, lambda h: F.coalesce(*(_first(h, rf"(?U)\b({p})\b") for p in DATES)))


def reference(header: Column) -> Column:
    """SIREN, permit number, "Référence" or a number sign, by priority."""
    # signs that a text with the pattern has; upper case leaves one letter that matches an I apart
    signs = [lambda h: h.contains("SIREN") | F.upper(h).contains("SIREN") | h.contains("\u0130"), lambda h: h.contains("ermis"), lambda h: h.contains("éférence"), lambda h: h.contains("n°")]
    return bind(header, lambda h: F.coalesce(*(F.when(sign(h), _first(h, p)) for sign, p in zip(signs, REFERENCES, strict=True))))


def metadata_columns(text: Column) -> dict[str, Column]:
    """All metadata of a text, by column name."""
    header = header_of(text)
    return {"document_type": document_type(text), "document_title": title(text), "document_subtitle": subtitle(text), "parties": parties(header), "location": location(header), "document_date": date(header), "document_reference": reference(header)}
