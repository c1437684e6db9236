"""A table of states by key on shared storage, replaced whole and at once.

The table is a folder of versions, one for each batch, and a pointer: a small file that
names the version in force.  A batch writes its version aside and then renames a new
pointer over the old one, which file systems do at once; readers follow the pointer and
see the state before or after, never half of it.  A batch that comes again, or a version
left half-written, changes nothing: versions are named by batch number, and numbers not
above the one in force are passed over.  The version before stays for readers under way.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .chunks import latest_states

_POINTER, _VERSION = "CURRENT", "version="


def _files(spark: SparkSession, root: str) -> tuple[JavaObject, JavaObject]:
    """The file context of ``root``, and its path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    return hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()), path


def current_batch(spark: SparkSession, root: str) -> int | None:
    """Number of the last batch in force, None before the first."""
    rows = spark.read.text(f"{root}/{_POINTER}").collect() if _exists(spark, root, _POINTER) else []
    return int(rows[0]["value"]) if rows else None


def _exists(spark: SparkSession, root: str, name: str) -> bool:
    files, path = _files(spark, root)
    return files.util().exists(spark._jvm.org.apache.hadoop.fs.Path(path, name))


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The table in force, None before the first batch."""
    batch = current_batch(spark, root)
    return None if batch is None else spark.read.parquet(f"{root}/{_VERSION}{batch}")


def _point(spark: SparkSession, root: str, batch: int) -> None:
    """Rename a new pointer over the old one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, path = _files(spark, root)
    aside, pointer = hadoop.Path(path, f"{_POINTER}.{batch}"), hadoop.Path(path, _POINTER)
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    out = files.create(aside, flags, spark.sparkContext._gateway.new_array(hadoop.Options.CreateOpts, 0))
    out.write(bytearray(str(batch).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    files.rename(aside, pointer, over)


def upsert(updates: DataFrame, root: str, batch: int, key: str = "document_id", order: str = "updated_at") -> bool:
    """Apply ``updates`` as batch number ``batch``; False if it, or a later one, is in force already.

    There is one writer at a time (as with ``foreachBatch``).  Empty updates make a
    version as well, so that the number moves on.
    """
    spark = updates.sparkSession
    last = current_batch(spark, root)
    if last is not None and batch <= last:
        return False
    before = spark.read.parquet(f"{root}/{_VERSION}{last}") if last is not None else updates.limit(0)
    latest_states(before, updates, key, order).write.mode("overwrite").parquet(f"{root}/{_VERSION}{batch}")
    _point(spark, root, batch)
    files, path = _files(spark, root)
    found = files.listStatus(path)
    while found.hasNext():
        name = found.next().getPath().getName()
        if name.startswith(_VERSION) and int(name.removeprefix(_VERSION)) not in (batch, last):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)
    return True


def start(updates: DataFrame, root: str, checkpoint: str, key: str = "document_id", order: str = "updated_at") -> StreamingQuery:
    """Keep the table up to date with a stream of updates; a batch that Spark runs again is applied once."""
    writer = updates.writeStream.foreachBatch(lambda rows, number: upsert(rows, root, number, key, order) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
