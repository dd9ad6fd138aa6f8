"""Tables written by streaming batches, safe against replays of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchTable:
    """Parquet folder with one sub-folder per batch id.

    Writing a batch replaces its own sub-folder only, so a batch that runs twice leaves one copy; readers inside
    a batch look at earlier batches only. Batch -1 holds what was there before the stream.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def start(self, rows: DataFrame | None = None) -> "BatchTable":
        first = rows if rows is not None else self.spark.createDataFrame([], self.schema)
        self.write(first, -1)
        return self

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None, only: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, batch_id BIGINT").parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        return rows if only is None else rows.where(F.col("batch_id") == only)


def run_to_end(writer, checkpoint: str) -> None:
    """Start a prepared stream writer on everything available now and wait for it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_to(stream: DataFrame, table: BatchTable, checkpoint: str) -> None:
    """Trigger after trigger until the source has nothing more; every batch goes to the table."""
    query = stream.writeStream.foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    run_to_end(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)


def update_to(stream: DataFrame, table: BatchTable, checkpoint: str) -> None:
    """Every batch's changed rows go to the table; the newest batch of a key holds its current row."""
    run_to_end(stream.writeStream.outputMode("update").foreachBatch(table.write), checkpoint)
