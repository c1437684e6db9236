"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, settle


def connected_components(links: DataFrame) -> DataFrame:
    """Return ``id, component`` for the ids of ``links`` (``a``, ``b``: long, not null).

    ``component`` is the least id reachable.  Each round hangs every neighbour on
    the least one (large star, then small star), so long chains shrink by a
    constant factor; a hub's neighbours are joined with its minimum and never
    gathered in one row.
    """
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, edges = edges, settle(small.distinct())
        release(last)
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
