"""Array expressions: values bound to a name, and ordered scans in about linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """An array cut into pieces of about the square root of its length."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), size), lambda i: F.slice(items, i, size)))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """An ordered fold that tells of its way: the array of what ``emit(state, item)`` gives (an int; null: nothing) before each item.

    ``step(state, item)`` is the state after an item.  What is emitted is gathered block by
    block, so that no array is copied more than a few times.
    """
    none = F.array().cast("array<int>")

    def within(acc: Column, item: Column) -> Column:
        return bind(emit(acc.state, item), lambda told: F.struct(step(acc.state, item).alias("state"), F.when(told.isNotNull(), F.concat(acc.out, F.array(told))).otherwise(acc.out).alias("out")))

    def over(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc.state.alias("state"), none.alias("out")), within)
        return bind(inner, lambda x: F.struct(x.state.alias("state"), F.concat(acc.out, F.array(x.out)).alias("out")))

    zero = F.struct(start.alias("state"), F.array().cast("array<array<int>>").alias("out"))
    return F.coalesce(F.aggregate(bind(items, blocks), zero, over, lambda acc: F.flatten(acc.out)), none)


def groups(items: Column, starts: Column) -> Column:
    """Slices of ``items`` from each start (a place from 0) to the next."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.size(items)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(items, a + 1, b - a))
