"""Words of texts and hashes of their character n-grams, many at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from .words import mix

#: Longest run of letters that is one word.  A longer one (glued text, scripts without spaces) is taken whole, as
#: consecutive pieces; they overlap by one character less than the longest n-gram, so that each n-gram is in a piece,
#: and are short, so that a few of them are no more text than a few words.
WORD_CHARS = 64
PIECE_CHARS = 16
LONGEST_GRAM = 6
#: Marks the ends of a piece that are not ends of its run; no letter.
CUT = "-"
#: Words whose n-grams are taken at a time; keeps arrays under 100 MB.
BLOCK_WORDS = 1 << 14
#: Characters of text taken at a time; keeps word lists near 30 MB.
SLICE_CHARS = 1 << 20

_U = np.uint64
#: Letters with the marks on them (vowel signs, accents); number signs such as one half or Roman eight are none.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; those over ``WORD_CHARS`` in pieces that together hold all of the run."""
    found = _WORD.findall(text.lower()) if text else []
    if max(map(len, found), default=0) <= WORD_CHARS:
        return found
    return [w for run in found for w in (_pieces(run) if len(run) > WORD_CHARS else (run,))]


def _pieces(run: str) -> Iterator[str]:
    overlap = LONGEST_GRAM - 1
    last = len(run) - overlap
    for at in range(0, last, PIECE_CHARS - overlap):
        end = at + PIECE_CHARS
        yield (CUT if at else "") + run[at:end] + (CUT if end < len(run) else "")


def blocks(words: list[str]) -> Iterator[list[str]]:
    """``words`` in lists of at most ``BLOCK_WORDS``."""
    for at in range(0, len(words), BLOCK_WORDS):
        yield words[at : at + BLOCK_WORDS]


def coded_texts(texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """Yield ``(first row, different words, code of each word, word count of each text)`` over slices of texts."""
    start = 0
    while start < len(texts):
        words, counts, size = [], [], 0
        while start + len(counts) < len(texts) and size < SLICE_CHARS:
            text = texts[start + len(counts)]
            own = words_of(text)
            words += own
            counts.append(len(own))
            size += len(text or "")
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        yield start, coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array(counts, np.int64)
        start += len(counts)


class Marked:
    """Code points of words of :func:`words_of` with their ends marked, one after the other."""

    def __init__(self, words: list[str]):
        marked = [f"<{w}>".replace("<" + CUT, "").replace(CUT + ">", "") if CUT in w else f"<{w}>" for w in words]
        self.sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        self.points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(_U)
        self.ends = np.cumsum(self.sizes)
        self.owner = np.repeat(np.arange(len(marked)), self.sizes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Owner and hash of every n-gram, by owner."""
        count = max(0, len(self.points) - n + 1)
        owner = self.owner[:count]
        inside = np.arange(count) + n <= self.ends[owner]
        out = np.full(count, n, _U)
        for k in range(n):
            out = out * _U(0xD6E8FEB86659FD93) + self.points[k : k + count]
        return owner[inside], mix(out[inside])

    def whole(self) -> np.ndarray:
        """Hash of each word."""
        if not len(self.sizes):
            return np.empty(0, _U)
        start = self.ends - self.sizes
        powers = np.cumprod(np.full(WORD_CHARS + 2, 0x9E3779B97F4A7C15, _U))
        place = np.arange(len(self.points)) - np.repeat(start, self.sizes)
        return mix(np.add.reduceat((self.points + _U(1)) * powers[place], start))
