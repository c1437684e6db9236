"""Byte-level BPE encoding and decoding through a sentencepiece model.

The vocabulary (``.tiktoken``: base64 token and rank on each line) is serialised
as a sentencepiece BPE model: each token's bytes become one printable character
each, its score is the negative rank, and normalisation is the identity.  The
merges sentencepiece then makes are those of the ranks.  Texts are cut by the
pattern first, each pre-token is encoded separately, and ids are decoded by the
inverse byte mapping.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SLICE_BYTES

#: Encoded pre-tokens kept by a Python worker; it starts anew when they are more.
CACHED = 150_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Read a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: an integer, a 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """Serialise ``ranks`` as a sentencepiece model; piece ``i + 1`` is the ``i``-th token by rank."""
    characters = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(characters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.whole = ranks
        self.ids = [rank for _, rank in sorted(ranks.items(), key=lambda x: x[1])]
        tokens = dict(zip(self.ids, (token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), strict=True))
        self.tokens = pa.array([tokens.get(i) for i in range(max(self.ids, default=-1) + 1)], pa.large_binary())
        self.pattern = regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.characters = dict(enumerate(byte_characters()))
        self.cache: dict[str, bytes] = {}

    def _look_up(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of each of some different pre-tokens, as 32-bit integers."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        found = list(map(self.cache.get, pre_tokens))
        missing = [i for i, ids in enumerate(found) if ids is None]
        mapped = [pre_tokens[i].encode().decode("latin-1").translate(self.characters) for i in missing]
        for i, pieces in zip(missing, self.pieces.encode(mapped, num_threads=1) if mapped else [], strict=True):
            whole = self.whole.get(pre_tokens[i].encode())
            ids = [self.ids[p - 1] for p in pieces] if whole is None else [whole]
            found[i] = array("i", ids).tobytes()
            if len(pre_tokens[i]) < 64:
                self.cache[pre_tokens[i]] = found[i]
        return found

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and the offset of each text (one more at the end)."""
        pre_tokens, counts = [], [0]
        for text in texts:
            pre_tokens += self.pattern.findall(text)
            counts.append(len(pre_tokens))
        if not pre_tokens:
            return np.empty(0, np.int32), np.zeros(len(counts), np.int64)
        coded = pa.array(pre_tokens, pa.large_string()).dictionary_encode()
        ids = self._look_up(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), np.int32)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy()
        begin, own = (np.cumsum(length) - length)[code], length[code]
        ends = np.concatenate([[0], np.cumsum(own)])
        out = flat[np.repeat(begin - ends[:-1], own) + np.arange(ends[-1])]
        return out, ends[counts]

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; no special tokens."""
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Bytes that each stretch of ``ids`` stands for."""
        taken = self.tokens.take(pa.array(ids))
        bounds = np.frombuffer(taken.buffers()[1], np.int64, count=len(taken) + 1)[offsets] if len(taken) else np.zeros(len(offsets), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(bounds.tobytes()), taken.buffers()[2]]).cast(pa.binary())

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that ``ids`` stand for."""
        return self.decode_batch(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py()


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_BYTES``, or of one longer text."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))).astype(np.int64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield start, end
        start = end


def encode(docs: DataFrame, path: str, pattern: str, and_decode: bool = False) -> DataFrame:
    """Return ``id, ids`` (``array<int>``) for ``docs`` (``id`` long, ``text``), and with ``and_decode`` also ``decoded``.

    ``path`` names a vocabulary file that every executor has.  Null and empty
    texts give no ids; repeated rows are encoded each; other columns are ignored.
    Texts and single matches of the pattern may be of any length; of equal pairs the
    leftmost merges first; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            for start, end in _slices(batch.column(1)):
                ids, offsets = tokenizer.encode_batch(batch.column(1).slice(start, end - start).fill_null("").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                out = {"id": batch.column(0).slice(start, end - start), "ids": lists}
                yield pa.record_batch(out | ({"decoded": tokenizer.decode_batch(ids, offsets)} if and_decode else {}))

    return docs.select("id", "text").mapInArrow(run, "id long, ids array<int>" + ", decoded binary" * and_decode)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary) to a table of ``id, ids``; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield batch.append_column("decoded", tokenizer.decode_batch(flat.astype(np.int32), offsets))

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, decoded binary")


def tokenized(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Encode and decode a ``documents`` table: ``doc_id, n_tokens, ids`` and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    place = public_tokenizers.path(name), public_tokenizers.PATTERN
    out = encode(docs.select(F.col("doc_id").alias("id"), "text"), *place, and_decode=True)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6(docs: DataFrame) -> DataFrame:
    """Digests of ids and of decoded bytes for a ``documents`` table."""
    return tokenized(docs).drop("ids")
