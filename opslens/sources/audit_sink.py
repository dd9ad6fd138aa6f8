"""Append-only audit table, partitioned by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Audit columns and the length limit of free text.
COLUMNS = ("stage", "action", "ok", "detail", "event_type", "project_ref")
MAX_TEXT = 500


def audit_rows(rows: DataFrame, columns: Sequence[str] = COLUMNS, stamp: Column | None = None) -> DataFrame:
    """Rows in the audit shape: declared columns only, missing ones empty, second-precise UTC time, cut text."""
    unknown = [c for c in rows.columns if c not in columns and c != "timestamp"]
    if unknown:
        raise ValueError(f"unknown audit columns {sorted(unknown)}")
    if "timestamp" in columns:
        raise ValueError("the timestamp is added, do not declare it")
    given = F.col("timestamp") if "timestamp" in rows.columns else F.current_timestamp()
    time = F.date_trunc("second", stamp if stamp is not None else given).cast("timestamp_ntz")

    def value(name: str) -> Column:
        col = F.col(name) if name in rows.columns else F.lit("")
        return F.substring(col, 1, MAX_TEXT) if name in ("detail", "message") else col

    return rows.select(time.alias("timestamp"), *[value(c).alias(c) for c in columns], F.to_date(time).alias("day"))


def append_audit(rows: DataFrame, path: str, columns: Sequence[str] = COLUMNS, stamp: Column | None = None) -> None:
    audit_rows(rows, columns, stamp).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")
