"""Runs: stretches of a text in which the words repeat with a period, and texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends, of at least ``EXPONENT`` periods and ``LEAST`` words.

1. In numpy, over a slice of texts at a time: a run of period q is full of short windows
   that occur again within q words.  Stretches of such windows, whose distances are
   narrowed by how long a stretch is, hold every run; the rest of a text has none.
2. The words of a stretch go into a suffix automaton.  States are visited from the
   longest to the shortest, and the ordered set of places where a state's words end is
   that of its largest child, into which the smaller ones are merged.  Two places that
   thereby become neighbours at a distance d no greater than the state's length l seed a
   square: the words between, and l words before, have period d, which is the smallest
   (an occurrence between would be a nearer neighbour).
3. Two states meet where their common words end on the left, so a seed names the start
   of its run; of the seeds with one start and period the last place is the run's end.

Sets are kept in blocks, so that a very long text costs n log n steps.  Words are equal
where their 64-bit hashes are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .source_mix import WORD
from .words import mix, text_slices, window_hashes, window_owner, word_hashes

EXPONENT, LEAST = 4, 6
#: Words of a window of the first step, rounds that narrow its stretches, and places in a block of a set.
WINDOW, ROUNDS, BLOCK = 3, 8, 1024


class SuffixAutomaton:
    """States of all stretches of ``words``: length of the longest, suffix link and, for prefixes, the place where it ends."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.place = [0], [-1], [-1]
        self._next: list[dict[int, int]] = [{}]
        last = 0
        for place, word in enumerate(words):
            last = self._append(last, word, place)
        del self._next

    def _state(self, length: int, link: int, place: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.place.append(place)
        self._next.append(following)
        return len(self.length) - 1

    def _append(self, last: int, word: int, place: int) -> int:
        new = self._state(self.length[last] + 1, 0, place, {})
        at = last
        while at >= 0 and word not in self._next[at]:
            self._next[at][word] = new
            at = self.link[at]
        if at < 0:
            return new
        old = self._next[at][word]
        if self.length[old] > self.length[at] + 1:
            # only the shorter stretches of ``old`` also end here: they become a state of their own
            part = self._state(self.length[at] + 1, self.link[old], -1, self._next[old].copy())
            self.link[old] = part
            while at >= 0 and self._next[at].get(word) == old:
                self._next[at][word] = part
                at = self.link[at]
            old = part
        self.link[new] = old
        return new


class Places:
    """An ordered set of numbers in blocks."""

    __slots__ = ("blocks", "size")

    def __init__(self, place: int):
        self.blocks, self.size = [[place]], 1

    def _block(self, x: int) -> int:
        if len(self.blocks) == 1:
            return 0
        return min(bisect_left(self.blocks, x, key=lambda b: b[-1]), len(self.blocks) - 1)

    def add(self, x: int) -> None:
        i = self._block(x)
        block = self.blocks[i]
        insort(block, x)
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[i : i + 1] = [block[:BLOCK], block[BLOCK:]]

    def beside(self, x: int) -> tuple[int | None, int | None]:
        """The numbers before and after ``x``, which is in the set."""
        i = self._block(x)
        block = self.blocks[i]
        j = bisect_left(block, x)
        before = block[j - 1] if j else self.blocks[i - 1][-1] if i else None
        after = block[j + 1] if j + 1 < len(block) else self.blocks[i + 1][0] if i + 1 < len(self.blocks) else None
        return before, after

    def all(self) -> list[int]:
        return [x for block in self.blocks for x in block]


def least_overlap(exponent: int, least: int) -> int:
    """Words that a run and itself, moved by its period, have in common at least."""
    return min(max(least, exponent * q) - q for q in range(1, least // exponent + 2))


def squares(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """Seeds ``(end place, distance, length of the state)`` whose stretch is long enough for a run."""
    automaton = SuffixAutomaton(words)
    length, link = automaton.length, automaton.link
    shortest = least_overlap(exponent, least)  # no shorter state can seed
    held: list[Places | None] = [None] * len(length)
    merged: dict[int, list[int]] = {}
    for state, place in enumerate(automaton.place):
        if place >= 0:
            held[state] = Places(place)
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        long = length[state]
        if long < shortest:
            break
        own = held[state]
        for x in merged.pop(state, ()):
            before, after = own.beside(x)
            for end, distance in ((x, x - before if before is not None else 0), (after, after - x if after is not None else 0)):
                if distance and long + distance >= max(least, exponent * distance):
                    yield end, distance, long
        above = link[state]
        if length[above] >= shortest:
            other = held[above]
            if other is None:
                held[above] = own
            else:
                small, large = (own, other) if own.size <= other.size else (other, own)
                places = small.all()
                for x in places:
                    large.add(x)
                held[above] = large
                merged.setdefault(above, []).extend(places)
        held[state] = None


def runs_of(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a sequence, by start and period."""
    last: dict[tuple[int, int], int] = {}
    for end, period, long in squares(words, exponent, least):
        start = end - period - long + 1
        # two places of one child were neighbours before, with more words in common
        if not start or words[start - 1] != words[start - 1 + period]:
            last[start, period] = max(last.get((start, period), 0), end)
    return sorted((start, end + 1 - start, period) for (start, period), end in last.items())


def _stretches(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]])))
    return edge[::2], edge[1::2]


def candidates(words: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of stretches that hold all runs, in hashes of a slice of texts (``first``: each text's first word)."""
    window = min(WINDOW, least_overlap(exponent, least))
    hashes = window_hashes(words, window)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row, inside = window_owner(first, window, len(words))
    key = mix(hashes + mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    distance = np.zeros(len(hashes), np.int64)
    distance[order[:-1][again]] = np.diff(order)[again]
    alive = inside & (distance > 0)
    for _ in range(ROUNDS):
        a, b = _stretches(alive)
        # a run of period q has q (exponent - 1) - window + 1 such windows at least
        most = (b - a + window - 1) // (exponent - 1)
        bound = np.zeros(len(hashes), np.int64)
        bound[alive] = np.repeat(most, b - a)
        fewer = alive & (distance <= bound)
        if (fewer == alive).all():
            break
        alive = fewer
    a, b = _stretches(alive)
    if not len(a):
        return a, b
    most = (b - a + window - 1) // (exponent - 1)
    ends = np.minimum(b - 1 + window + most, first[1:][row[a]])
    # stretches that touch become one
    starts = np.concatenate([[True], (a[1:] >= np.maximum.accumulate(ends)[:-1]) | (row[a[1:]] != row[a[:-1]])])
    return a[starts], np.maximum.reduceat(ends, np.flatnonzero(starts))


def find_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Return ``id, n_words, runs, collapsed`` for ``docs`` (``id`` long, ``text``).

    ``runs`` (``array<struct<start, length, period>>``, words numbered from 0) is sorted
    by start and period; ``collapsed`` has the words that no run contains after its
    first period, joined by one space.  Null and empty texts have no words and no runs;
    repeated rows and null ids are rows like others; other columns are ignored; texts
    are read whole, a stretch that may hold runs takes some hundred bytes a word; an
    empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                words, first = word_hashes(data, offsets)
                found: list[list[dict]] = [[] for _ in range(end - start)]
                gone = np.zeros(len(words) + 1, np.int64)
                for a, b in zip(*(x.tolist() for x in candidates(words, first, exponent, least)), strict=True):
                    row = int(np.searchsorted(first, a, "right")) - 1
                    numbers = np.unique(words[a:b], return_inverse=True)[1].tolist()
                    for at, length, period in runs_of(numbers, exponent, least):
                        found[row].append({"start": a - int(first[row]) + at, "length": length, "period": period})
                        gone[a + at + period] += 1
                        gone[a + at + length] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                collapsed = []
                for i in range(end - start):
                    own, drop = bytes(data[offsets[i] : offsets[i + 1]]).split(), gone[first[i] : first[i + 1]]
                    collapsed.append(b" ".join([w for w, d in zip(own, drop.tolist(), strict=True) if not d] if drop.any() else own).decode())
                yield pa.record_batch({
                    "id": batch.column(0).slice(start, end - start), "n_words": pa.array(np.diff(first), pa.int64()),
                    "runs": pa.array(found, kind), "collapsed": pa.array(collapsed, pa.string()),
                })

    return docs.select("id", "text").mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated_tail(docs: DataFrame) -> DataFrame:
    """``id, text`` of a ``documents`` table where a tenth of the texts, by crc32 of the id, repeat the words from some place on.

    With h the crc32, g = floor(h / 10) and n words, word i from a = g % n on is word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).  Null ids and texts stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").alias("id"), "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    tail = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p)))
    return rows.select("id", F.when(a.isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op13(docs: DataFrame) -> DataFrame:
    """Runs of every text of a ``documents`` table after :func:`repeated_tail`: their number, the longest one, digests."""
    rows = find_runs(repeated_tail(docs))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    rows = rows.withColumn("best", longest)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
