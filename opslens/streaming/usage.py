"""Daily usage kept fresh by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.usage import with_totals


def stream_usage_daily(turns: DataFrame, delay: str = "2 days") -> DataFrame:
    """Totals per day, re-emitted whenever they change; turns later than `delay` are dropped."""
    timed = with_totals(turns).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    days = timed.groupBy(F.window("at", "1 day")).agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    return days.select(
        F.to_date("window.start").alias("day"), "input", "output", (F.col("input") + F.col("output")).alias("total")
    )
