"""SentencePiece encoding and decoding through tables of distinct words.

A sentencepiece model writes each space as a marker and puts one before the text.  No
piece of the models meant here has a marker behind another character, so no piece and
no merge crosses the place before a run of markers: a *chunk* (a run of markers and
what follows up to the next one) is segmented alike wherever it stands.

1. Chunks are counted over all documents (sums for each slice of text, then one
   aggregation by chunk), and the most frequent ones, ``TABLE`` at most, are segmented
   once, by Spark tasks: the table that every executor gets.
2. Documents are cut into chunks a slice at a time, a slice's distinct chunks are
   looked up in that table, those that it has not are segmented once for the slice, and
   ids are joined back to chunks by position.

The table is a matter of speed alone: what it lacks is segmented where it stands.
Decoding joins the bytes of pieces; the library decodes the rare rows that this cannot
(control pieces, bytes that are no UTF-8).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle

MARKER = "▁"
#: Bytes of text cut in one go, and chunks of the table at most.
SLICE_BYTES, TABLE = 4 << 20, 200_000
#: Steps of a doubling of a chunk's count in the histogram that tells where the table ends.
STEPS = 16
_CHUNK = regex.compile(f"{MARKER}+[^{MARKER}]*")


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield start, end
        start = end


def chunks_of(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """Chunks of all texts one after the other, and where each text's end."""
    chunks: list[str] = []
    ends = []
    for text in texts:
        if text:
            chunks += _CHUNK.findall(MARKER + text.replace(" ", MARKER))
        ends.append(len(chunks))
    return chunks, ends


class Pieces:
    """One sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        if any(MARKER in name.lstrip(MARKER) for name in names):
            raise ValueError("pieces of this model cross markers, so words cannot be segmented apart")
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        self.special = np.array(special)
        self.begins = np.array([name.startswith(MARKER) and not odd for name, odd in zip(names, special, strict=True)])
        self.bytes = pa.array([bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace(MARKER, " ").encode() for i, name in enumerate(names)], pa.large_binary())
        self.marker = [self.model.piece_to_id(MARKER)]
        # a lone marker behind a text's first one cannot be asked for as a text of its own
        if self.model.encode(f"a{MARKER}")[-1:] != self.marker:
            self.marker = self.model.encode(f"a{MARKER}")[len(self.model.encode("a")) :]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; the library puts one marker before a text, which is the chunk's first."""
        return [ids if chunk != MARKER else self.marker for chunk, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1), strict=True)] if chunks else []

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each stretch of ``ids``, as the library decodes it."""
        if not len(ids):
            return [""] * (len(offsets) - 1)
        taken = self.bytes.take(pa.array(ids))
        bounds = np.frombuffer(taken.buffers()[1], np.int64, count=len(taken) + 1)
        data = taken.buffers()[2].to_pybytes()
        odd = np.concatenate([[0], np.cumsum(self.special[ids])])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = data[bounds[a] : bounds[b]]
            if a < b and self.begins[ids[a]]:
                own = own[1:]  # the marker that encoding put before the text
            try:
                out.append(own.decode() if odd[a] == odd[b] else self.model.decode(ids[a:b].tolist()))
            except UnicodeDecodeError:
                out.append(self.model.decode(ids[a:b].tolist()))
        return out


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """``chunk, n``: how often each chunk occurs in all of ``docs`` (``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch.column(0)):
                found = pc.value_counts(pa.array(chunks_of(batch.column(0).slice(start, end - start).to_pylist())[0], pa.string()))
                yield pa.record_batch({"chunk": found.field("values"), "n": found.field("counts")})

    return docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, path: str, size: int = TABLE) -> DataFrame:
    """``chunk, ids``: the most frequent chunks of ``docs``, ``size`` at most, each segmented once.

    A histogram of counts tells how frequent a chunk must be, so that no task sorts all
    chunks; where more than ``size`` are equally frequent, none of these is taken.
    """
    counted = settle(chunk_counts(docs).withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    least, taken = None, 0
    for row in sorted(counted.groupBy("step").count().collect(), reverse=True):
        taken += row["count"]
        if taken > size:
            break
        least = row["step"]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _pieces(path).segment(batch.column(0).to_pylist())
            yield pa.record_batch({"chunk": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    frequent = counted.filter(F.lit(False) if least is None else F.col("step") >= least).select("chunk")
    return frequent.mapInArrow(segment, "chunk string, ids array<int>")


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int32, int(length.sum())), length


def encode(docs: DataFrame, path: str, size: int = TABLE, and_decode: bool = False) -> DataFrame:
    """Return ``id, ids`` (``array<int>``) for ``docs`` (``id`` long, ``text``), and with ``and_decode`` also ``decoded``.

    ``path`` names a model file that every executor has; ids are those of the
    sentencepiece library without begin, end or sampling.  Null and empty texts give no
    ids; repeated rows are encoded each; other columns are ignored; texts and chunks
    may be of any length; ties between merges are the library's; an empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    rows = chunk_table(docs, path, size).toArrow()  # at most ``size`` chunks
    known = pa.concat_arrays(rows.column("chunk").chunks) if rows.num_rows else pa.array([], pa.string())
    flat, length = _flat(rows.column("ids").to_pylist())
    table = spark.sparkContext.broadcast((known, flat, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        known, flat, length = table.value
        for batch in batches:
            for start, end in text_slices(batch.column(1)):
                chunks, ends = chunks_of(batch.column(1).slice(start, end - start).to_pylist())
                coded = pa.array(chunks, pa.string()).dictionary_encode()
                del chunks
                place = pc.index_in(coded.dictionary, value_set=known)
                more, more_length = _flat(pieces.segment(coded.dictionary.filter(place.is_null()).to_pylist()))
                # distinct chunks get ids from the table, or from those segmented here, which follow it
                place = place.to_numpy(zero_copy_only=False).astype(np.float64)
                missing = np.isnan(place)
                place[missing] = len(known) + np.arange(missing.sum())
                every, lengths = np.concatenate([flat, more]), np.concatenate([length, more_length])
                begins = np.cumsum(lengths) - lengths
                at = place.astype(np.int64)[coded.indices.to_numpy()]
                own = lengths[at]
                bounds = np.concatenate([[0], np.cumsum(own)])
                ids = every[np.repeat(begins[at] - bounds[:-1], own) + np.arange(bounds[-1])]
                offsets = bounds[np.concatenate([[0], ends])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                out = {"id": batch.column(0).slice(start, end - start), "ids": lists}
                yield pa.record_batch(out | ({"decoded": pa.array(pieces.decode_batch(ids, offsets), pa.string())} if and_decode else {}))

    return docs.select("id", "text").mapInArrow(run, "id long, ids array<int>" + ", decoded string" * and_decode)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` to a table of ``id, ids`` as the library's decode gives it; null ids decode to no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            yield batch.append_column("decoded", pa.array(_pieces(path).decode_batch(flat, offsets), pa.string()))

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, decoded string")


def op11(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """Digests of ids and of decoded texts for a ``documents`` table."""
    import public_tokenizers

    out = encode(docs.select(F.col("doc_id").alias("id"), "text"), public_tokenizers.path(name), and_decode=True)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
