"""Keys of documents: rows stay apart whatever their ids.

A document is told by its id, a hash of its text and the number of the repeat among
rows that share both.  A row without an id gets one made of the hash, so that reruns and
retried tasks give the same.  Keys are made once, before any other window; windows and
groups by them share its shuffle, which moves documents before they become lines.
Documents without an id are spread by their texts; only rows equal in id and text share
a task, which passes over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What tells rows of documents apart; ``document_id`` is what users see.
KEY = ["row_id", "row_hash", "row_copy", "document_id"]


def generated_id(text_hash: Column, copy: Column) -> Column:
    """An id for a row without one: from the hash of its text, copies from the second on numbered."""
    return F.concat(F.lit("doc-"), text_hash, F.when(copy > 0, F.concat(F.lit("-"), (copy + 1).cast("string"))).otherwise(""))


def keyed(docs: DataFrame) -> DataFrame:
    """Add the columns ``KEY`` to ``docs`` (``document_id, text``); ids that are null or empty are filled in.

    Rows that share id and text are numbered in an order of all their columns (maps
    apart), so equal rows alone are interchangeable.  Rows that have keys keep them.
    """
    if set(KEY) <= set(docs.columns):
        return docs
    sortable = [c for c, kind in docs.dtypes if "map<" not in kind]
    given = F.nullif(F.col("document_id").cast("string"), F.lit(""))
    rows = docs.withColumns({"row_id": F.coalesce(given, F.lit("")), "row_hash": F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16)})
    copies = Window.partitionBy("row_id", "row_hash").orderBy(F.xxhash64(*sortable))
    rows = rows.withColumn("row_copy", F.row_number().over(copies) - 1)
    return rows.withColumn("document_id", F.coalesce(given, generated_id(F.col("row_hash"), F.col("row_copy"))))


def by(rows: DataFrame) -> list[str]:
    """The columns that tell documents apart in ``rows``: the keys, or the id alone where there are none."""
    return KEY if set(KEY) <= set(rows.columns) else ["document_id"]


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    """The columns that tell documents apart in both tables."""
    return KEY if by(left) == by(right) == KEY else ["document_id"]
