"""Streaming forms of capture deduplication and bounded capture windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.streaming.keyed import OrderedCaptures, keyed_frames


def stream_capture_dedup(captures: DataFrame, delay: str = "1 hour", processor: OrderedCaptures | None = None) -> DataFrame:
    """First arrival of every (session, generation, seq) over both paths, with `gen`, the number of page loads so far.

    Captures wait until the watermark has passed them (`captured_at` is the event time and never falls with `arrival`), so the order of delivery
    changes nothing. Rows without a body go, rows without a seq all stay; rows later than `delay` are dropped.
    """
    timed = captures.withWatermark("captured_at", delay).withColumn("at_ms", F.unix_millis("captured_at"))
    texts = timed.withColumns({c: F.col(c).cast("string") for c in ("session_id", "arrival", "seq", "at_ms")})
    schema = "session_id STRING, gen LONG, arrival STRING, path STRING, seq STRING, url STRING, body STRING"
    found = keyed_frames(texts, "session_id", processor or OrderedCaptures(), schema, "append", "EventTime")
    return found.withColumns({c: F.col(c).cast("long") for c in ("session_id", "arrival", "seq")})


def stream_bounded_capture(
    captures: DataFrame, starts: DataFrame, seconds: int, cancels: DataFrame | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Captures inside the window of their job, as an interval join of two streams.

    `captures` has `job_id, captured_at`, `starts` has `job_id, started_at`. `cancels` (`job_id, cancelled_at`)
    is read anew by every batch and closes windows early.
    """
    left = captures.withWatermark("captured_at", delay)
    right = starts.select(F.col("job_id").alias("_job"), "started_at").withWatermark("started_at", delay)
    inside = (
        (F.col("job_id") == F.col("_job"))
        & (F.col("captured_at") >= F.col("started_at"))
        & (F.col("captured_at") < F.col("started_at") + F.expr(f"INTERVAL {int(seconds)} SECOND"))
    )
    joined = left.join(right, inside).drop("_job")
    if cancels is None:
        return joined
    closed = joined.join(cancels, "job_id", "left")
    return closed.where(F.col("cancelled_at").isNull() | (F.col("captured_at") < F.col("cancelled_at"))).drop("cancelled_at")
