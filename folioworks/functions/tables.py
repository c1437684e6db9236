"""Markdown tables as sentences, within the row: no line leaves its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bind
from .text import strip

# Cells of the line between headers and data.
RULE = r"^-+:?$|^:?-+:?$|^:?-+$"


def _sentence(headers: Column, cells: Column) -> Column:
    """``Header : value`` of each cell, joined; null without any."""
    named = lambda c, i: F.when((i < F.size(headers)) & (F.get(headers, i) != c), F.concat(F.get(headers, i), F.lit(" : "), c)).otherwise(c)
    parts = F.array_compact(F.transform(cells, lambda c, i: F.when(c != "-", named(c, i))))
    return bind(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, ". "), F.lit("."))))


def _block_sentences(block: Column) -> Column:
    """Lines that stand for a run of table lines (stripped); none without a row of headers."""
    cells = F.transform(block, lambda s: F.filter(F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), strip), lambda c: c != ""))
    kept = F.filter(cells, lambda row: ~F.forall(row, lambda c: c.rlike(RULE)))
    none = F.array().cast("array<string>")
    return bind(
        kept,
        lambda k: F.when(F.size(k) == 0, none)
        .when(F.size(k) == 1, F.array(F.concat(F.array_join(F.get(k, F.lit(0)), ", "), F.lit("."))))
        .otherwise(F.array_compact(F.transform(F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))), lambda row: _sentence(F.get(k, F.lit(0)), row)))),
    )


def table_sentences(text: Column) -> Column:
    """``text`` with each run of table lines (bars at both ends, or two of them) as sentences; null stays null."""

    def marked(line: Column) -> Column:
        bars = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
        return bind(F.when(line.contains("|"), strip(line)), lambda s: F.struct(line.alias("line"), s.alias("s"), F.coalesce((s.startswith("|") & s.endswith("|")) | (bars(s) >= 2), F.lit(False)).alias("is")))

    def rewritten(rows: Column) -> Column:
        n = F.size(rows)
        inside = lambda i: F.coalesce(F.get(rows, i)["is"], F.lit(False))
        places = F.sequence(F.lit(0), n)
        # a run begins where the line before is no table line, and ends before the next that is none
        begins, ends = F.filter(places, lambda i: inside(i) & ~inside(i - 1)), F.filter(places, lambda i: ~inside(i) & inside(i - 1))
        return bind(F.struct(begins.alias("a"), ends.alias("b")), lambda run: joined(rows, n, run["a"], run["b"]))

    def joined(rows: Column, n: Column, begins: Column, ends: Column) -> Column:
        part = lambda a, b, field: F.transform(F.slice(rows, a + 1, b - a), lambda r: r[field])
        between = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(begins, F.array(n)), lambda a, b: part(a, b, "line"))
        tables = F.zip_with(begins, ends, lambda a, b: _block_sentences(part(a, b, "s")))
        pieces = F.zip_with(between, tables, lambda lines, table: F.concat(lines, F.coalesce(table, F.array().cast("array<string>"))))
        return F.array_join(F.flatten(pieces), "\n")

    return F.when(text.contains("|"), bind(F.transform(F.split(text, "\n"), marked), rewritten)).otherwise(text)


def tables_to_sentences(docs: DataFrame) -> DataFrame:
    """Rewrite runs of table lines in ``text`` of ``docs``; every row keeps its own lines, whatever its id."""
    return docs.withColumn("text", table_sentences(F.col("text")))
