"""Vectorised word hashing shared by the text operators of this subpackage.

A *word* is a maximal run of characters other than space and tab..carriage
return (``[^\\x20\\x09-\\x0D]+``).  UTF-8 keeps those six characters as single
bytes that occur nowhere else, so words can be found on the raw bytes of an
Arrow column, a whole slice of documents at a time.

Hashes are 64-bit and depend on the bytes alone: they are equal in every
process, so they may be shuffled, joined and recomputed by retried tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text hashed in one go; keeps the work arrays near 100 MB.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32

_powers = np.ones(1, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, _BASE, _U))])
    return _powers


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` over a string column.

    Slices hold whole texts, about ``limit`` bytes of them or one longer text.
    Null texts count as empty.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        chunk = chunk.fill_null("") if chunk.null_count else chunk
        if pa.types.is_string(chunk.type):
            chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if not n:
            continue
        _, offset_buffer, data_buffer = chunk.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64, count=n + 1, offset=chunk.offset * 8)
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.empty(0, np.uint8)
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield row + start, row + end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
        row += n


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash the words of a slice of texts.

    Returns the word hashes in text order and, for each text, the index of its
    first word (one more entry at the end).  ``fold_case`` maps A-Z to a-z.
    """
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]]) if len(data) else np.empty(0, bool)
    if len(data):
        before[offsets[:-1][offsets[:-1] < len(data)]] = True  # a word never spans two texts
    starts = np.flatnonzero(before & ~space)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, _U), first
    bounds = np.concatenate([starts, [len(data)]])
    position = np.arange(len(data), dtype=np.int64)
    position -= np.repeat(bounds[:-1], np.diff(bounds), axis=0) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.repeat(bounds[:-1], np.diff(bounds))])
    body = (_FOLD[data] if fold_case else data).astype(_U)
    body += _U(1)
    body[space] = 0
    body *= _powers_to(int(position.max()) + 1)[position]
    return mix(np.add.reduceat(body, starts)), first


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash each run of ``length`` consecutive word hashes (texts are not told apart)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.full(n, seed * 0x632BE59BD9B4E019 + length & 0xFFFFFFFFFFFFFFFF, _U)
    for i in range(length):
        out = out * _U(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


def window_owner(first: np.ndarray, length: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each window start and whether the window stays within that row."""
    n = max(0, total - length + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    return row, np.arange(n) + length <= first[1:][row]
