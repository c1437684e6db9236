"""Search in tables of vectors (``vec_id, embedding``) by cosine similarity, for many queries at once.

Queries are taken in blocks of bounded size.  A block is broadcast, and every task
compares its rows with it by matrix products, a slice at a time.  For the nearest rows a
task keeps the best ``k`` of each query only, and the tasks' best ones meet by query; for
a threshold it emits the pairs above it and nothing else.  Similarities are rounded to six decimals before
they are compared, so ties are told apart by id, alike everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of queries, and rows and queries compared at a time (8 MB of similarities).
BLOCK_BYTES, SLICE_ROWS, SLICE_QUERIES = 32 << 20, 2048, 512
_PAIRS = "query_id long, vec_id long, similarity double"


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which of them have one (null, empty and zero vectors and those of another width do not)."""
    lists = vectors.to_pylist()
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        if x and len(x) == width and None not in x:
            out[i] = x
    length = np.sqrt((out * out).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / length[:, None], length > 0


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[DataFrame, int]]:
    """``queries`` in classes by a hash that hold about ``block_bytes`` each, and the width that most of them have."""
    sized = queries.agg(F.count("*").alias("n"), F.mode(F.size("embedding")).alias("width")).first()
    width = max(sized["width"] or 0, 1)
    parts = max(1, -(-(sized["n"] * width * 8) // block_bytes))
    for i in range(parts):
        yield (queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i)), width


def _compare(vectors: DataFrame, block: DataFrame, width: int, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs of one block of queries with all rows that ``pick`` takes from each slice of rounded similarities (queries by rows)."""
    got = block.select("vec_id", "embedding").toArrow()  # bounded by the size of a block
    ids = got.column("vec_id").to_numpy()
    matrix, has = _matrix(got.column("embedding"), width)
    shared = vectors.sparkSession.sparkContext.broadcast((ids[has], matrix[has]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows, there = _matrix(part.column(1), width)
                if not len(query_ids) or not there.any():
                    continue
                of = part.column(0).to_numpy(zero_copy_only=False)[there]
                columns = rows[there].T
                for at in range(0, len(query_ids), SLICE_QUERIES):
                    similar = np.round(queries[at : at + SLICE_QUERIES] @ columns, 6) + 0.0
                    q, r = pick(similar)
                    yield pa.record_batch({"query_id": query_ids[at + q], "vec_id": of[r], "similarity": similar[q, r]})

    return vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, _PAIRS)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: the ``k`` rows nearest to each query, ties by lesser id.

    Null, empty and zero vectors, and those of another width, are near nothing.
    """

    def best(similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the k best of a slice, and all that are as good as the k-th."""
        if similar.shape[1] <= k:
            return np.nonzero(np.ones_like(similar, bool))
        least = np.partition(similar, similar.shape[1] - k, axis=1)[:, similar.shape[1] - k]
        return np.nonzero(similar >= least[:, None])

    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    parts = [_compare(vectors, block, width, best).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k) for block, width in _blocks(queries, block_bytes)]
    return _union(parts)


def within(vectors: DataFrame, queries: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, vec_id, similarity`` of all rows at least ``threshold`` near to a query."""
    return _union([_compare(vectors, block, width, lambda similar: np.nonzero(similar >= threshold)) for block, width in _blocks(queries, block_bytes)])


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
