"""Current phase per job from a stream of transitions; the earliest terminal phase is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.jobs import TERMINAL
from opslens.streaming.keyed import JobPhase, keyed


def stream_job_state(events: DataFrame) -> DataFrame:
    """Native form: a streaming aggregate, so hot jobs shrink before the shuffle and no row leaves the JVM.

    Whatever the order of arrival, the phase is the earliest terminal one by event time, else the latest one.
    State is kept for every job; `stream_job_state_ttl` forgets idle ones.
    """
    order = F.struct("ts", "seq")
    ended = F.col("phase").isin(*TERMINAL)
    jobs = events.groupBy("job_id").agg(
        F.min_by(F.when(ended, F.col("phase")), F.when(ended, order)).alias("_end"),
        F.max_by("phase", order).alias("_last"),
        F.count("*").alias("events"),
    )
    return jobs.select("job_id", F.coalesce("_end", "_last").alias("phase"), "events")


def stream_job_state_ttl(events: DataFrame, ttl_hours: int, delay: str = "1 hour") -> DataFrame:
    """The same with event-time expiry: a job idle for `ttl_hours` behind the watermark is given a last time, with `expired`, and loses its state."""
    timed = events.select("job_id", "seq", "phase", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", delay)
    rows = timed.withColumn("us", F.unix_micros("at"))
    return keyed(rows, "job_id", JobPhase(ttl_hours * 3_600_000), "job_id STRING, phase STRING, events LONG, expired BOOLEAN", "update", "EventTime")
