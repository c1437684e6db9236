"""Document fingerprints: quartile bucket digests.

Byte triplets inside a sliding window are hashed into buckets and counted.  The
quartiles of the counts cut the buckets into four classes, two bits each; the
digest is these bits and the logarithm of the length.  Two digests differ by the
steps between their classes and lengths, and the likeness is 1 less that
difference over its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, text_slices

BUCKETS = 256
#: Offsets of the bytes of a triplet from its first: wide ones tell documents of one language apart.
TRIPLETS = ((0, 3, 7), (0, 4, 9), (0, 5, 11))
#: Texts of fewer bytes count these triplets as well.
SHORT, SHORT_TRIPLETS = 64, ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Steps of the digest's length field for each doubling of the length.
LENGTH_STEPS = 4
#: Weight of one class step in the difference, for steps of 0 to 3: opposite classes tell most.
STEP = np.array([0, 1, 3, 6])
#: Difference of two digests whose likeness is 0: what unrelated texts have, about.
BOUND = 2.0
#: Bytes of text that are compared in one task, about; more where that would make more than MOST_GROUPS.
GROUP_BYTES = 8 << 20
MOST_GROUPS = 1 << 19
#: Texts whose buckets are counted at a time.
ROWS = 4096

_U = np.uint64


def digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Hexadecimal digests of a slice of texts (bytes and offsets)."""
    out = []
    for start in range(0, len(offsets) - 1, ROWS):
        own = offsets[start : start + ROWS + 1]
        out += _digests(data[own[0] : own[-1]].astype(np.uint64), own - own[0])
    return out


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    n_rows, sizes = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros(n_rows * BUCKETS, np.int64)
    row = np.repeat(np.arange(n_rows), sizes)
    for k, triplet in enumerate(TRIPLETS + SHORT_TRIPLETS):
        n = max(0, len(data) - max(triplet))
        use = np.arange(n) + max(triplet) < offsets[1:][row[:n]]
        if k >= len(TRIPLETS):
            use &= (sizes < SHORT)[row[:n]]
        key = np.full(n, k + 1, _U)
        for at in triplet:
            key = (key << _U(8)) | data[at : at + n]
        bucket = (mix(key[use]) % _U(BUCKETS)).astype(np.int64)
        counts += np.bincount(row[:n][use] * BUCKETS + bucket, minlength=n_rows * BUCKETS)
    counts = counts.reshape(n_rows, BUCKETS)
    ordered = np.sort(counts, axis=1)
    codes = np.zeros(counts.shape, np.uint8)
    for quarter in (1, 2, 3):
        codes += counts > ordered[:, quarter * BUCKETS // 4 - 1][:, None]
    packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    length = np.minimum(255, np.round(LENGTH_STEPS * np.log2(1 + sizes))).astype(np.uint8)
    return [bytes([size]).hex() + row.tobytes().hex() for size, row in zip(length, packed, strict=True)]


def likeness(one: list[str], other: list[str]) -> np.ndarray:
    """1 for equal digests, to 0 for ones that differ by the bound or more; pairwise over two lists."""
    if not len(one):
        return np.empty(0)
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(x), -1) for x in (one, other))
    apart = np.abs(a[:, :1].astype(int) - b[:, :1])[:, 0] / (LENGTH_STEPS * 8)
    steps = np.zeros(len(a))
    for shift in (0, 2, 4, 6):
        steps += STEP[np.abs((a[:, 1:] >> shift & 3).astype(int) - (b[:, 1:] >> shift & 3))].sum(1)
    return np.clip(1 - (steps / BUCKETS + apart) / BOUND, 0.0, 1.0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Return ``id, fingerprint`` for each row of ``docs`` (``id, text``); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                yield pa.record_batch({"id": batch.column(0).slice(start, end - start), "fingerprint": pa.array(digests(data, offsets), pa.string())})

    return docs.select("id", "text").mapInArrow(run, "id long, fingerprint string")


def _digests_of(texts: list[str]) -> list[str]:
    column = pa.array(texts, pa.large_string())
    return [x for _, _, data, offsets in text_slices(column) for x in digests(data, offsets)]


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``part`` of consecutive ids, and with the first row of each part also at the end of the one before.

    ``last`` marks those copies; the first row of all is copied to the end of the last part.
    """
    got = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = min(MOST_GROUPS, max(1, round((got["bytes"] or 0) / GROUP_BYTES)))
    cuts = sorted(set(docs.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    # part k holds cuts[k - 1] <= id < cuts[k]; null ids go first
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(np.array(cuts, np.int64))  # a number for each part

    def part_of(ids: pa.Array) -> np.ndarray:
        part = np.searchsorted(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(np.asarray(ids.is_null()), 0, part).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(part_of(batch.column(0))))

    ids = docs.select("id").mapInArrow(deal, "id long, part int")
    firsts = ids.groupBy("part").agg(F.max(F.col("id").isNull()).alias("nulls"), F.min("id").alias("first")).collect()
    held = sorted((r["part"], None if r["nulls"] else r["first"]) for r in firsts)
    follow = context.broadcast({first: held[i - 1][0] for i, (_, first) in enumerate(held)})

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text", "part", "last"]
        for batch in deal(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, bool))], names=names)
            before = np.array([follow.value.get(x, -1) for x in batch.column(0).to_pylist()], np.int32)
            first = pa.array(before >= 0)
            columns = [batch.column(0), batch.column(1), pa.array(before), first]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(first)

    return docs.mapInArrow(copy, "id long, text string, part int, last boolean")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint each of ``docs`` (``id, text``), an edited text of it and its next document.

    Next is the one that follows in order of id and text (after the last one: the
    first).  The edited text has the last quarter of the code points replaced by as
    many of the next document's first, or all it has.  Returns ``id, text,
    edited, fingerprint, edited_fingerprint, near_edited, near_next`` with a row for
    each input row; null texts count as empty, null ids come first, a single row is
    its own next; an empty table gives an empty one.
    """

    def compare(held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, [("last", "ascending"), ("id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        own = held.num_rows - pc.sum(held["last"]).as_py()
        texts = held["text"].to_pylist()[: own + 1]  # of rows that share the next part's first id, the first follows
        after = [*range(1, len(texts)), 0][:own]
        edited = [t[: len(t) - len(t) // 4] + texts[i][: len(t) // 4] for t, i in zip(texts, after, strict=False)]
        prints, of_edited = _digests_of(texts), _digests_of(edited)
        return pa.table({
            "id": held["id"][:own], "text": held["text"][:own], "edited": pa.array(edited, pa.string()),
            "fingerprint": pa.array(prints[:own], pa.string()), "edited_fingerprint": pa.array(of_edited, pa.string()),
            "near_edited": likeness(prints[:own], of_edited), "near_next": likeness(prints[:own], [prints[i] for i in after]),
        })

    dealt = _dealt(docs.select("id", F.coalesce("text", F.lit("")).alias("text")))
    schema = "id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.groupBy("part").applyInArrow(compare, schema)


def op7(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`compare_neighbours` for a ``documents`` table."""
    out = compare_neighbours(docs.select(F.col("doc_id").alias("id"), "text"))
    return out.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
