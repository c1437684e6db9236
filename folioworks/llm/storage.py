"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; where it is unset and the master is this machine (tests) a folder of it serves."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before.  The table goes when the application ends or by :func:`release`.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/folioworks-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    settled = spark.read.schema(df.schema).parquet(place)
    _places[settled] = place
    return settled


def release(*settled: DataFrame | None) -> None:
    """Delete tables of :func:`settle` that nothing reads any more."""
    for df in settled:
        place = _places.pop(df, None) if df is not None else None
        if place is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
