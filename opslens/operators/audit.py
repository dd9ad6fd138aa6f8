"""Analytics over the audit table `ts, stage, action, ok, detail, project_ref`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.scale import top_per_key

# Stages every decision passes.
STAGES = ("parser", "brain", "orchestrator")


def audit_counts(audit: DataFrame) -> DataFrame:
    """Rows by stage, action and outcome, failures first."""
    counts = audit.groupBy("stage", "action", "ok").agg(F.count("*").alias("rows"))
    return counts.orderBy("ok", F.desc("rows"), "stage", "action")


def audit_coverage(audit: DataFrame, key: str = "project_ref", stages: Sequence[str] = STAGES) -> DataFrame:
    """Per key which of the stages have a row; flags instead of collected sets keep hot keys small."""
    flags = [F.bool_or(F.col("stage") == s).alias(f"has_{s}") for s in stages]
    covered = F.lit(True)
    for s in stages:
        covered = covered & F.col(f"has_{s}")
    return audit.groupBy(key).agg(*flags).withColumn("complete", covered)


def render_logfmt(fields: Sequence[str], types: dict[str, str]) -> Column:
    """`key=value` pairs of the non-empty fields; booleans in lower case, values with white space quoted."""
    parts = []
    for name in fields:
        text = F.col(name).cast("string")
        shown = text if types.get(name) == "boolean" else F.when(text.rlike(r"\s"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
        parts.append(F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{name}="), shown)))
    return F.concat_ws(" ", *parts)


def tail(audit: DataFrame, n: int = 200, source: str = "stage") -> DataFrame:
    """Last `n` rows per source."""
    return top_per_key(audit, [source], [F.desc("ts"), F.desc("event_id")], n, out="back")
