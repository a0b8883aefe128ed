"""Streams into a delta table: micro-batches of rows are appended, and searched beside the base at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vanespark.operators.ivf import latest


def append_rows(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream (vec_id, embedding[, tags]) to the table at ``path``, each batch under its number as version.

    A batch that is written again after a failure replaces its own folder, so rows are there exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_rows(delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The latest version of each id that isn't tombstoned, from (vec_id, embedding, tags, version)."""
    return latest(delta).join(tombstones.select("vec_id").distinct(), "vec_id", "left_anti")
