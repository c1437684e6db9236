"""Which rows a classifier may learn from, bounded samples of them, and learning in a task."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Share of rows held out: 1 of so many.
FOLDS = 5
#: Rows of a sample in all, however many classes there are, and the classes that are learned (the most frequent ones).
SAMPLE_ROWS, CLASSES = 24_000, 1_000


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by ``FOLDS``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def per_class_sample(rows: DataFrame, label: str, size: int) -> DataFrame:
    """About ``size`` rows of each value of ``label``, chosen by a hash of all columns; smaller classes are taken whole.

    At most ``CLASSES`` classes, and fewer rows of each where all would be over
    ``SAMPLE_ROWS``.  Rows that share an id, or have none, are told apart by the other
    columns; classes meet their shares in a join with a small table.
    """
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(CLASSES).collect()
    size = max(1, min(size, SAMPLE_ROWS // max(1, len(counts))))
    kind = StructType([StructField("_class", rows.schema[label].dataType), StructField("_share", DoubleType())])
    shares = rows.sparkSession.createDataFrame([(r[label], min(1.0, size / r["count"])) for r in counts], kind)  # CLASSES rows at most
    chosen = rows.join(F.broadcast(shares), F.col(label).eqNullSafe(F.col("_class")))
    return chosen.filter(F.pmod(F.xxhash64(*rows.columns, F.lit(17)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).select(*rows.columns)


def give_back() -> None:
    """Return freed memory of this Python worker to the machine; Spark keeps workers for later stages."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def learn_in_task(rows: DataFrame, learn: Callable[[list[tuple]], object], most: int) -> object:
    """Return ``learn(rows)`` as one task computes it; the driver sees neither the rows nor the work arrays.

    ``rows`` is a sample; should rows share ids, so that it holds more than ``most``,
    those with the least hashes count.  Rows come sorted, so a retried task learns the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {tuple(row.values()) for batch in batches for row in batch.to_pylist()}
        model = pickle.dumps(learn(sorted(found, key=repr)))
        found.clear()
        give_back()
        yield pa.record_batch({"model": pa.array([model], pa.binary())})

    bounded = rows.orderBy(F.xxhash64(*rows.columns)).limit(most)
    got = bounded.mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else learn([])
