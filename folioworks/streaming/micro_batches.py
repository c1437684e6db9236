"""The transformation over a stream of documents.

Documents are independent, so a micro-batch is transformed as a table is: no
state, watermark or late data.  A batch that runs again overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.structuring import chunks, clean


def start(documents: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write chunks of a streaming table ``document_id, text`` below ``path``, a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        chunks(clean(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
