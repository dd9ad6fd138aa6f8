"""Messages: handle once, retry what was deferred, keep order within an identity. All by keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.streaming.keyed import HandleOnce, Positions, keyed

LEDGER_SCHEMA = "key STRING, processed_at TIMESTAMP, status STRING, seq BIGINT, metadata STRING"
#: (key, attempt) -> (status, metadata); runs in the tasks
Handler = Callable[[str, int], tuple[str, str]]


def _ledger_rows(items: DataFrame, processor: HandleOnce, time: str) -> DataFrame:
    answers = keyed(items, "key", processor, "key STRING, status STRING, attempts LONG, metadata STRING", "append", time)
    return answers.select("key", F.current_timestamp().alias("processed_at"), "status", F.col("attempts").alias("seq"), "metadata")


def stream_unprocessed(items: DataFrame, handle: Handler) -> DataFrame:
    """Ledger rows of items (`key`): each is handled until its status is ok, at most once in a batch."""
    return _ledger_rows(items.select("key", F.lit(0).cast("long").alias("at_ms")), HandleOnce(handle), "None")


def stream_defer_retry(items: DataFrame, handle: Handler, max_attempts: int, retry_hours: float, delay: str = "1 hour") -> DataFrame:
    """As above for items (`key, at`), but `handle` may also answer defer: no ledger row, and a timer tries again `retry_hours` of event time later.

    An item deferred at its last attempt becomes an error, which later deliveries of the same item try again.
    """
    timed = items.withWatermark("at", delay).select("key", "at", F.unix_millis("at").alias("at_ms"))
    return _ledger_rows(timed, HandleOnce(handle, max_attempts, int(retry_hours * 3_600_000)), "EventTime")


def stream_ordered_groups(events: DataFrame, piece: int = 1024) -> DataFrame:
    """Position of every event (`identity, message_id, sent_s`) within its identity by time, for an update sink: a late event takes its place,
    and the positions it moves are given again.
    """
    rows = events.select("identity", "message_id", "sent_s")
    return keyed(rows, "identity", Positions(piece), "identity STRING, message_id LONG, sent_s LONG, position LONG", "update")
