"""Substring deduplication by level-wise doubling.

A window is a run of ``window`` consecutive words of one document.  A word is
removed when a window over it also starts in a document with a smaller id.

Level by level, from a few words to ``window`` (each length at most twice the one
before), only windows all of whose shorter parts looked at so far repeat in
different documents stay candidates, until none is left:

1. At a short level, of the short windows inside each candidate only the one with
   the least hash is counted (its *anchor*); equal windows have equal anchors, so a
   repeated window always has a repeated anchor, and few short windows (two of
   eleven at 4 words, one of four at 7) have to be shuffled.
2. The candidates of a level are the windows whose anchors of all levels before
   repeat; where no anchor of a level does, no window can, and nothing is removed.
   The last level holds all repeated windows with the least document that starts one.
3. Windows are joined with that table, and documents with their windows.

Nothing is sampled or capped.  A Bloom filter of bounded size carries the
candidates of a level to the next scan; what it lets through wrongly fails the
exact join.  Window equality is that of 64-bit hashes of word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .storage import release, settle
from .words import text_slices, window_hashes, window_owner, word_hashes


#: Words of the shortest level; shorter windows repeat in nearly all documents and rule nothing out.
SHORTEST = 4


def levels(window: int) -> list[int]:
    """Window lengths from the first level to ``window``, each at most twice the last."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _anchors(words: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Short-window hashes, and for each full window the index of the short one with the least hash."""
    hashes = window_hashes(words, short)
    inside = window - short + 1
    if len(hashes) < inside:
        return hashes, np.empty(0, np.int64)
    least = np.argmin(sliding_window_view(hashes, inside), axis=1)
    return hashes, least + np.arange(len(least))


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def _scan(docs: DataFrame, window: int, length: int, seen: list[tuple[int, object]]) -> DataFrame:
    """Rows ``(h, id)`` of a level: the anchors of ``length`` words of the windows that ``seen`` (length and filter of each level before) leaves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end, data, offsets in text_slices(batch.column(1)):
                words, first = word_hashes(data, offsets)
                row, held = window_owner(first, window, len(words))
                for short, repeats in seen:
                    if held.any():
                        hashes, least = _anchors(words, short, window)
                        at = np.flatnonzero(held)
                        held[at] = repeats.value.may_contain(hashes[least[at]])
                if not held.any():
                    continue
                hashes, least = _anchors(words, length, window)
                at, keep = np.unique(least[held], return_index=True)
                row, out = _distinct(row[held][keep], hashes[at])
                yield pa.record_batch({"h": out.view(np.int64), "id": ids[start:end][row]})

    return docs.select("id", "text").mapInArrow(scan, "h long, id long")


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("h", "least")


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove words that windows of ``window`` words repeat from documents with smaller ids.

    ``docs`` has ``id`` (long) and ``text``; other columns are ignored.  Returns
    ``id, text, n_words, n_removed, kept`` (the kept words joined by one space).
    Null and empty texts have no words and keep none; rows with a null id are
    returned unchanged (they precede nothing); rows that share an id are one
    document's and never count against each other.  Input rows are all returned; texts of
    any length are cut whole; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("id", "text")
    known = docs.filter(F.col("id").isNotNull())
    seen: list[tuple[int, object]] = []
    for length in levels(window)[:-1]:
        anchors = settle(_repeated(_scan(known, window, length, seen)).select("h"))
        count = anchors.count()
        seen = [*seen, (length, spark.sparkContext.broadcast(bloom.build(anchors, F.col("h"), count)))]
        release(anchors)
        if not count:  # nothing repeats at this length, so nothing does at a greater one
            return _cut(docs, None, seen[-1][1], window)
    candidates = _scan(known, window, window, seen)
    repeated = _repeated(candidates)
    removed = settle(
        candidates.join(repeated, "h").filter("least < id").groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("windows"))
    )
    ids = removed.select(F.xxhash64("id").alias("i"))
    touched = spark.sparkContext.broadcast(bloom.build(ids, F.col("i"), removed.count()))
    return _cut(docs, removed, touched, window)


def _cut(docs: DataFrame, removed: DataFrame | None, seen: object, window: int) -> DataFrame:
    """Apply the windows of ``removed`` to the texts; documents that the filter rules out keep everything, and all do without windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, windows = batch.column(1), batch.column(2)
            kept, n_words, n_removed = [], [], []
            for start, end, data, offsets in text_slices(texts):
                words, first = word_hashes(data, offsets)
                hashes = window_hashes(words, window)
                for i in range(start, end):
                    own = bytes(data[offsets[i - start] : offsets[i - start + 1]]).split()
                    gone = np.zeros(len(own), bool)
                    held = windows[i].as_py() if windows[i].is_valid else None
                    if held:
                        a = first[i - start]
                        n = len(own) - window + 1
                        hit = np.flatnonzero(np.isin(hashes[a : a + n], np.array(held, np.int64).view(np.uint64)))
                        change = np.zeros(len(own) + 1, np.int64)
                        np.add.at(change, hit, 1)
                        np.add.at(change, hit + window, -1)
                        gone = np.cumsum(change)[:-1] > 0
                    kept.append(b" ".join([w for w, g in zip(own, gone) if not g] if gone.any() else own).decode())
                    n_words.append(len(own))
                    n_removed.append(int(gone.sum()))
            yield pa.record_batch({"id": batch.column(0), "text": texts, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    def part(wanted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            touched_rows = seen.value.may_contain(ids) & ~np.asarray(batch.column(0).is_null())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "text"]).filter(pa.array(touched_rows == wanted))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part(False, batches):
            yield from cut([batch.append_column("windows", pa.nulls(batch.num_rows))])

    schema = "id long, text string, n_words long, n_removed long, kept string"
    hashed = docs.withColumn("i", F.xxhash64("id"))
    if removed is None:
        return hashed.mapInArrow(untouched, schema)
    partly = hashed.mapInArrow(lambda batches: part(True, batches), "id long, text string").join(removed, "id", "left")
    return hashed.mapInArrow(untouched, schema).unionByName(partly.mapInArrow(cut, schema))


def op10(docs: DataFrame, window: int = 13) -> DataFrame:
    """Digest columns of :func:`remove_repeats` for a ``documents`` table."""
    out = remove_repeats(docs.select(F.col("doc_id").alias("id"), "text"), window)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
