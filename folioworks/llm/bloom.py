"""A Bloom filter of bounded size, built by Spark and used inside Python tasks.

It only spares work: what it lets through is checked exactly afterwards, so a
filter that fills up at a larger scale costs time and never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter, as a power of two: 16 MB pass the driver to each Python worker.
MAX_BITS = 27
#: Parts that the top bits of a value choose from, as a power of two.
_PARTS = 6

_U = np.uint64


class Bloom:
    """Answers "may this 64-bit value be in the set?" for numpy arrays."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def may_contain(self, values: np.ndarray) -> np.ndarray:
        part = values >> _U(64 - _PARTS)
        out = np.ones(len(values), bool)
        for p in _places(values, self.bits):
            at = (part << _U(self.bits - _PARTS)) | p
            out &= self.cells[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1 == 1
        return out


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << (bits - _PARTS)) - 1)
    return values & mask, (values >> _U(26)) & mask


def build(df: DataFrame, hashed: Column, count: int) -> Bloom:
    """Build the filter over ``hashed``, a column of well-mixed 64-bit values.

    ``count`` (their number) sets the size, up to ``MAX_BITS``.  Bits are gathered as
    64-bit words by an aggregation that combines before it shuffles, so however many
    values there are, no task and not the driver sees more than the filter.
    """
    bits = min(MAX_BITS, max(_PARTS + 6, (16 * max(count, 1)).bit_length()))
    h, mask = F.col("h"), F.lit((1 << (bits - _PARTS)) - 1)
    part = F.shiftleft(F.shiftrightunsigned(h, 64 - _PARTS), bits - _PARTS)
    places = F.array(*(part.bitwiseOR(x.bitwiseAND(mask)) for x in (h, F.shiftrightunsigned(h, 26))))
    at = F.col("at")
    words = df.select(hashed.alias("h")).select(F.explode(places).alias("at"))
    words = words.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("bits"))
    got = words.toArrow()
    cells = np.zeros(1 << (bits - 6), np.int64)
    cells[got["word"].to_numpy()] = got["bits"].to_numpy()
    return Bloom(bits, cells.view(np.uint8))
