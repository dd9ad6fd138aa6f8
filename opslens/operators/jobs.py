"""Job lifecycle tables built from a log of transitions `job_id, ts, seq, phase, ...`."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.columns import one_of
from opslens.functions.scale import HOT_ROWS, last_per_key, running_total

# Phases after which a job can no longer be cancelled.
TERMINAL = ("completed", "failed", "cancelled")


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(micros / F.lit(1_000_000), F.lit(0.0))


def job_snapshot(events: DataFrame) -> DataFrame:
    """One row per job: first and last instant, last phase, last result and last error."""
    order = F.struct("ts", "seq")

    def last_filled(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    optional = [last_filled(c) for c in ("result", "error", "job_type") if c in events.columns]
    jobs = events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("phase", order).alias("phase"), *optional
    )
    return jobs.withColumn("elapsed_seconds", F.round(seconds_between(F.col("created_at"), F.col("updated_at")), 3))


def merge_metadata(updates: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Shallow merge of map updates, later keys win: long rows `job_id, key, value`.

    With `jobs`, updates of unknown jobs are left out.
    """
    if jobs is not None:
        updates = updates.join(jobs.select("job_id"), "job_id", "left_semi")
    entries = updates.select("job_id", "ts", "seq", F.explode("metadata"))
    return last_per_key(entries, ["job_id", "key"], ["ts", "seq"], ["value"])


def recent_jobs(snapshot: DataFrame, n: int = 20) -> DataFrame:
    return snapshot.orderBy(F.desc("updated_at"), "job_id").limit(n)


def apply_cancel(snapshot: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer of every cancel request: accepted with the previous phase, or the reason why not."""
    asked = requests.select("job_id").distinct()
    known = snapshot.select("job_id", "phase")
    terminal = F.col("phase").isin(*TERMINAL)
    answers = asked.join(known, "job_id", "left")
    reason = one_of(
        [(F.col("phase").isNull(), "not_found"), (terminal, F.concat(F.lit("already_"), F.col("phase")))], F.col("phase")
    )
    accepted = F.col("phase").isNotNull() & ~terminal
    return answers.select(
        "job_id", accepted.alias("accepted"), reason.alias("reason"), F.when(accepted, "cancelled").otherwise(F.col("phase")).alias("new_phase")
    )


def capacity(events: DataFrame, as_of: Column, max_active: int) -> DataFrame:
    """Running jobs and free slots at one instant."""
    then = job_snapshot(events.where(F.col("ts") <= as_of))
    counts = then.agg(F.count_if(~F.col("phase").isin(*TERMINAL)).alias("active"))
    return counts.withColumn("free", F.lit(max_active) - F.col("active"))


def overlap_profile(intervals: DataFrame, cap: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """In-flight count after every instant at which it changes; an interval covers [start, end).

    Changes are summed per instant first, then added up inside even chunks of the instants on top of the chunk offsets.
    """
    marks = intervals.select(
        F.explode(
            F.array(
                F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("delta")),
                F.struct(F.col("end_ts").alias("ts"), F.lit(-1).alias("delta")),
            )
        ).alias("m")
    ).select("m.*")
    steps = marks.groupBy("ts").agg(F.sum("delta").alias("delta"))
    profile = running_total(steps, [], [F.col("ts")], F.col("delta"), "in_flight", hot_rows)
    return profile.select("ts", "in_flight", (F.col("in_flight") > cap).alias("over_cap"))


def job_counters(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("job_type", "phase").agg(F.count("*").alias("jobs"))


def duration_histogram(snapshot: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Cumulative histogram of durations per type, one row per upper bound and one for no bound."""
    tests = [F.count_if(F.col("elapsed_seconds") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = snapshot.groupBy("job_type").agg(*tests, F.count("*").alias("le_all"))
    pairs = ", ".join(f"'{b:g}', le_{i}" for i, b in enumerate(bounds)) + ", '+Inf', le_all"
    return wide.selectExpr("job_type", f"stack({len(bounds) + 1}, {pairs}) AS (le, jobs)")


def migrate_legacy_jobs(jobs: DataFrame) -> DataFrame:
    """Old job rows to the current shape; rows already in it pass unchanged."""
    if {"phase", "metadata"} <= set(jobs.columns):
        return jobs
    if "phase" not in jobs.columns and "status" in jobs.columns:
        jobs = jobs.withColumnRenamed("status", "phase")
    folded = [c for c in ("type", "request_id") if c in jobs.columns]
    metadata = F.to_json(F.struct(*folded), {"ignoreNullFields": "false"}) if folded else F.lit("{}")
    return jobs.withColumn("metadata", metadata).drop(*folded)


def drop_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows that stay after the given keys are deleted."""
    return table.join(keys.select(key), key, "left_anti")


def drop_hits(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Which of the given keys existed."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").select(key, F.coalesce("_known", F.lit(False)).alias("deleted"))


def expired(snapshot: DataFrame, as_of: dt.datetime, ttl_hours: int) -> DataFrame:
    cut = F.lit(as_of - dt.timedelta(hours=ttl_hours)).cast("timestamp_ntz")
    return snapshot.where(F.col("updated_at") < cut)
