"""Numbers as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(x: Column) -> Column:
    """``x`` (not negative) in tenths, rounded by its exact binary value, ties to even.

    20 x is split into two parts that are exact, so its sign against the nearest tie is too.
    """
    low = F.floor(x * 10)
    high = x.cast("float").cast("double")
    over = (20 * high - (2 * low + 1)) + 20 * (x - high)
    return low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)


def one_decimal(x: Column) -> Column:
    """``x`` as text with one decimal, rounded as :func:`tenths` does."""
    t = tenths(x.cast("double"))
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))
