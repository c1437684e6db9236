"""Cleaning and measuring text: column functions that stay within a row.

Java regexes get ``(?U)`` where classes are meant for all of Unicode and ``(?d)``
where only ``\\n`` ends a line.  Rewrites are guarded by a cheap ``contains``.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..fixed_values import REPEATED_CHARS, REPEATED_OVER, TOKEN_RATIO
from .arrays import bind


def strip(text: Column) -> Column:
    """Without white space at both ends; texts that begin and end with a printed ASCII character are not looked through, others in one match from the start."""
    printed = lambda t, at: F.substring(t.cast("binary"), at, 1).between(F.lit(bytearray(b"!")), F.lit(bytearray(b"~")))
    return bind(text, lambda t: F.when(printed(t, 1) & printed(t, -1), t).otherwise(F.regexp_extract(t, r"(?Us)\A\s*+(.*\S)?", 1)))


def count_words(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    """Characters by the token ratio, truncated."""
    return (F.length(text) / F.lit(TOKEN_RATIO)).cast("int")


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _rewrite_if(text: Column, sign: str, rules: list[tuple[str, str]]) -> Column:
    """Apply ``rules`` to texts that contain ``sign``."""
    return bind(text, lambda t: F.when(t.contains(sign), _rewrite(t, rules)).otherwise(t))


# A mark that is opened and not closed would be looked for from each opener to the end.  Where a
# pattern fails for good, its second alternative takes what it has read and puts it back ($1), and
# runs begin only where no equal character is before them, so each character is read a few times.
_PLACEHOLDER = (
    r"(?U)(?:\*{1,2}+=*+>?+\s*+|(?<!=)=++>?+\s*+|>\s*+|(?<!\s)\s++)?+picture\s*+\[[^\]]*+\]\s*+intentionally\s++omitted\s*+<?+=*+\*?+\*?+"
    r"|(picture\s*+\[[^\]]*+(?:\]|\z))"
)
_CLOSED_TAG = r"<(?!br)/?[a-zA-Z][^>]*+>"
_TAG = rf"{_CLOSED_TAG}|(<(?!br)/?[a-zA-Z][^>]*+\z)"
_IMAGE = r"!\[[^\]]*+\]\([^)]++\)|(!\[[^\]]*+(?:\](?:\([^)]*+\z)?|\z))"


def _collapse(text: Column, pattern: str = r"[ \t]{2,}+") -> Column:
    """``text`` with runs of spaces and tabs (``pattern``) as one space."""
    return bind(text, lambda t: F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, pattern, " ")).otherwise(t))


def _collapse_lines(text: Column) -> Column:
    """Runs of spaces and tabs as one space (single tabs stay), of blank lines as one."""
    return _rewrite_if(_collapse(text), "\n\n\n", [(r"\n{3,}+", "\n\n")])


def clean_html_markers(text: Column) -> Column:
    """Drop picture placeholders, tags (``<br>`` becomes a line end), images and empty table cells; linear in the text."""
    text = _rewrite_if(_rewrite_if(text, "intentionally", [(_PLACEHOLDER, "$1")]), "<", [(r"(?U)<br\s*+/?>", "\n")])
    # only behind the last > may a tag be unclosed
    text = bind(text, lambda t: F.when(F.substring_index(t, ">", -1).contains("<"), F.regexp_replace(t, _TAG, "$1")).when(t.contains("<"), F.regexp_replace(t, _CLOSED_TAG, "")).otherwise(t))
    text = _rewrite_if(_rewrite_if(text, "![", [(_IMAGE, "$1")]), "|", [(r"(?U)\|\s++\|\s++\|", "")])
    return strip(_collapse_lines(text))


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    def decoded(match: re.Match) -> str:
        return html.unescape(match[0]) if match[1][0] == "#" or f"{match[1]};" in html.entities.html5 else match[0]

    return texts.map(lambda t: _CLOSED.sub(decoded, t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_html_entities(text: Column, closed: bool = False) -> Column:
    """Decode HTML5 character references; only texts that have an ``&`` go to Python (``text`` should be a column, as it is read twice).

    With ``closed`` those that end in a semicolon alone: a reference that is cut off stays as it is written.
    """
    return F.coalesce((_unescape_closed if closed else _unescape)(F.when(text.contains("&"), text)), text)


# Spaces before a number sign that are not a line end alone.
_INLINE = r"(?U)#(?<=[^\S\n]#|\s\n#)"


def split_inline_headers(text: Column) -> Column:
    """Put markdown headers that follow text on a line of their own."""
    rules = [(r"(?U)(\S)\s+(###\s+)", "$1\n$2"), (r"(?U)(\S)\s+(##\s+(?!#))", "$1\n$2"), (r"(?U)(\S)\s+(#\s+(?!#))", "$1\n$2")]
    # a single line end before a header stays as it is
    return bind(text, lambda t: F.when(t.contains("#") & t.rlike(_INLINE), _rewrite(t, rules)).otherwise(t))


# LaTeX marks in the order they are rewritten, and what they stand for: plain ones, and patterns with a sign that their texts have.
_LATEX = [
    (None, r"n^\circ", "n°"),
    (None, r"^{\circ}", "°"),
    (None, r"$\mathrm{n}^{\circ}$", "n°"),
    (None, r"n^{\circ}", "n°"),
    (r"\%", r"(?U)(?=[$\d])(?:\$|(?<!\d))(\d++)\s*+\\%\$?", "$1%"),
    (None, r"$\quad$", " "),
    (None, r"\square", "☐"),
    (r"\mathrm{", r"\\mathrm\{([^}]++)\}|(\\mathrm\{[^}]*+\z)", "$1$2"),
    ("\\", r"(?U)\\\s", " "),
    ("$", r"\$([^$]++)\$", "$1"),
    ("{", r"\{([^}]*+)\}|(\{[^}]*+\z)", "$1$2"),
    (None, "{}", ""),
    (None, "\\\\", ""),
]


def _rewrite_latex(marks: list[tuple[str | None, str, str]]) -> Callable[[Column], Column]:
    """A rewrite by ``marks``, each of which has a backslash, a dollar sign or a brace, of texts that have one."""

    def rewritten(text: Column) -> Column:
        for sign, mark, meaning in marks:
            text = F.replace(text, F.lit(mark), F.lit(meaning)) if sign is None else _rewrite_if(text, sign, [(mark, meaning)])
        return text

    return lambda text: bind(text, lambda t: F.when(t.contains("\\") | t.contains("$") | t.contains("{"), rewritten(t)).otherwise(t))


def clean_latex(text: Column) -> Column:
    """Rewrite LaTeX marks by what they stand for; linear in the text."""
    # many texts have no more marks once degrees and percentages are rewritten
    return strip(_collapse(_rewrite_latex(_LATEX[5:])(_rewrite_latex(_LATEX[:5])(text)), r"[ \t]++"))


def clean_noise(text: Column) -> Column:
    """Drop control characters and collapse spaces and blank lines."""
    return strip(_collapse_lines(F.regexp_replace(text, r"[\x00-\x1f&&[^\t\n\r]]", "")))


def _may_repeat(stripped: Column) -> Column:
    """Whether so many of ``stripped`` are equal to others that one may be there more than ``REPEATED_OVER`` times."""
    return F.size(stripped) - F.size(F.array_distinct(stripped)) >= REPEATED_OVER


def repeated_lines(text: Column) -> Column:
    """Stripped lines that occur more than three times (longer than five characters), each once."""
    repeated = lambda lines: F.array_distinct(F.filter(lines, lambda x, i: x == F.get(lines, i + REPEATED_OVER)))
    long = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > REPEATED_CHARS)
    return bind(long, lambda lines: F.when(_may_repeat(lines), bind(F.sort_array(lines), repeated)).when(lines.isNotNull(), F.array().cast("array<string>")))


def remove_repeated_lines(text: Column) -> Column:
    """``text`` without the lines that :func:`repeated_lines` gives; where some may be, lines are sorted, so equal ones stand side by side."""

    def kept(rows: Column) -> Column:
        among = lambda x, i: reduce(Column.__or__, [(F.get(rows, i - k).s == x.s) & (F.get(rows, i - k + REPEATED_OVER).s == x.s) for k in range(REPEATED_OVER + 1)])
        rest = F.filter(rows, lambda x, i: (F.length(x.s) <= REPEATED_CHARS) | ~F.coalesce(among(x, i), F.lit(False)))
        return F.array_join(F.transform(F.sort_array(F.transform(rest, lambda x: F.struct(x.pos.alias("pos"), x.line.alias("line")))), lambda x: x.line), "\n")

    def cleaned(t: Column, lines: Column) -> Column:
        return bind(F.transform(lines, strip), lambda stripped: F.when(_may_repeat(stripped), bind(F.sort_array(F.zip_with(_numbered(stripped), lines, lambda x, line: x.withField("line", line))), kept)).otherwise(t))

    return bind(text, lambda t: bind(F.split(t, "\n"), lambda lines: cleaned(t, lines)))


def _numbered(stripped: Column) -> Column:
    return F.transform(stripped, lambda x, i: F.struct(x.alias("s"), i.alias("pos")))


def _closed(name: str) -> tuple[str, str]:
    """Pattern of elements of ``name``, the last of which may be unclosed to the end, and of one that is closed (group 1: inside)."""
    return rf"(?s)<{name}[^>]*+>.*?</{name}>|<{name}[^>]*+(?:>.*+)?\z", rf"(?s)\A<{name}[^>]*+>(.*)</{name}>\z"


def _inside(html: Column, name: str) -> Column:
    """What the elements of ``name`` hold, in order."""
    every, closed = _closed(name)
    found = F.filter(F.regexp_extract_all(html, F.lit(every), F.lit(0)), lambda x: x.rlike(closed))
    return F.transform(found, lambda x: F.regexp_extract(x, closed, 1))


def html_tables_to_markdown(text: Column) -> Column:
    """Rewrite HTML tables as markdown tables; tables without rows and unclosed ones stay; linear in the text."""
    every, closed = _closed("table")

    def lines(rows: Column) -> Column:
        cells = F.transform(rows, lambda r: F.transform(_inside(r, "t[dh]"), strip))
        rule = lambda c: F.concat(F.lit("\n|"), F.array_join(F.transform(c, lambda _: F.lit("---")), "|"), F.lit("|"))
        return F.array_join(F.transform(cells, lambda c, i: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"), F.when(i == 0, rule(c)).otherwise(""))), "\n")

    def convert(table: Column) -> Column:
        rows = F.when(table.rlike(closed), _inside(table, "tr")).otherwise(F.array().cast("array<string>"))
        return bind(rows, lambda r: F.when(F.size(r) == 0, table).otherwise(lines(r)))

    gaps, tables = F.split(text, every, -1), F.regexp_extract_all(text, F.lit(every), F.lit(0))
    pieces = F.zip_with(gaps, F.transform(tables, convert), lambda gap, table: F.concat(gap, F.coalesce(table, F.lit(""))))
    return F.when(text.contains("<table"), F.array_join(pieces, "")).otherwise(text)


def clean_page(markdown: Column) -> Column:
    """A page of an OCR response: no images, no dollar signs around formulas, tables in markdown, stripped."""
    text = F.regexp_replace(markdown, r"(?d)!\[(?>.*?\]\()(?>.*?\))|(!\[.*+)", "$1")
    return bind(text, lambda t: strip(F.regexp_replace(html_tables_to_markdown(t), r"\$([^$]++)\$", "$1")))
