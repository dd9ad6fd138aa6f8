"""Processed-item ledger kept as an append-only log of versions `key, processed_at, seq, status, metadata`.

The current row of a key is its last version; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.scale import last_per_key

# The status domain.
STATUSES = ("pending", "ok", "error")


COLUMNS = ("processed_at", "seq", "status", "metadata")


def ledger_latest(log: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Current row of every key: the last write replaces status, metadata and time. Only `columns` are read and shuffled."""
    return last_per_key(log, ["key"], ["processed_at", "seq"], list(columns))


def unprocessed(items: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """Items whose latest status is not ok; pending and failed ones come back."""
    done = ledger_latest(log, ["status"]).where(F.col("status") == "ok").select(F.col("key").alias("_done"))
    return items.join(done, items[key] == done["_done"], "left_anti")


def by_status(log: DataFrame, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return ledger_latest(log).where(F.col("status") == status).orderBy("processed_at", "key")


def status_counts(log: DataFrame) -> DataFrame:
    """Keys per status and a `total` row."""
    counts = ledger_latest(log, ["status"]).rollup("status").agg(F.count("*").alias("keys"))
    return counts.select(F.coalesce("status", F.lit("total")).alias("status"), "keys")


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(*STATUSES), F.lit(False))


def check_status(log: DataFrame, strict: bool = False) -> DataFrame:
    """Flag rows outside the status domain, or fail the job on the first one in strict mode."""
    ok = valid_status(F.col("status"))
    if strict:
        message = F.concat(F.lit("invalid status: "), F.coalesce("status", F.lit("null")))
        return log.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(message).cast("string")))
    return log.withColumn("valid", ok)


def metadata_value(path: str, cast: str = "string") -> Column:
    """Typed field of the metadata JSON; null where the path, the JSON or the type does not fit."""
    return F.try_variant_get(F.try_parse_json("metadata"), path, cast)


def metadata_has(path: str) -> Column:
    return F.try_variant_get(F.try_parse_json("metadata"), path, "variant").isNotNull()


def reset_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """New pending versions for the known ones of `keys`, remembering the previous status."""
    asked = keys.select("key").distinct()
    current = ledger_latest(log, ["status", "seq"]).join(asked, "key", "left_semi")
    note = F.to_json(F.struct(F.lit("reset").alias("action"), F.col("status").alias("prev_status")))
    return current.select("key", F.lit("pending").alias("status"), note.alias("metadata"), F.col("seq").alias("prev_seq"))


def backfill_keys(log: DataFrame) -> DataFrame:
    """Finished keys to sweep again; rows without a key are counted as skipped."""
    done = ledger_latest(log, ["status"]).where(F.col("status").isin("ok", "error"))
    empty = F.coalesce("key", F.lit("")) == ""
    return done.select("key", "status", F.when(empty, "skipped").otherwise("labeled").alias("outcome"))


def retry_outcome(log: DataFrame) -> DataFrame:
    """Attempts, failures and final state of every key."""
    final = F.max_by(F.struct("status", "metadata"), F.struct("processed_at", "seq"))
    return (
        log.groupBy("key")
        .agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "error").alias("failures"), final.alias("final"))
        .select("key", "attempts", "failures", "final.*")
    )
