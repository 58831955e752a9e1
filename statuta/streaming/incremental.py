"""Incremental indexing: a stream over a folder of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.schema import DOCUMENT_JSON


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """New document files as they arrive, each doc_id once within a day of its event time."""
    rows = spark.readStream.schema(DOCUMENT_JSON).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    timed = rows.withColumn("event_time", F.coalesce(F.try_to_timestamp("last_updated"), F.current_timestamp()))
    return timed.withWatermark("event_time", "1 day").dropDuplicatesWithinWatermark(["doc_id"])


def start(stream: DataFrame, table_path: str, checkpoint_path: str, once: bool = True):
    """Appends the stream to a Parquet table; with ``once`` it ends when all present files are read."""
    writer = stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint_path).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
