"""Account usage from API bodies of three shapes, row by row inside the JVM.

Every body is read once with one explicit schema; the shape is decided by what is filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.columns import clamp, one_of, truthy_number

# Field names of the bodies, in the order in which they are tried.
LIST_KEYS = ("results", "data", "buckets", "items")
START_KEYS = ("start_time", "period_start", "from", "start")
STAMP_KEYS = ("start_time", "period_start", "from", "start", "timestamp")
END_KEYS = ("end_time", "period_end", "to", "end")
TOKEN_KEYS = (
    "uncached_input_tokens", "input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens",
)

_BUCKET = ", ".join(
    [f"{k}: BIGINT" for k in TOKEN_KEYS] + [f"`{k}`: STRING" for k in dict.fromkeys(STAMP_KEYS + END_KEYS)]
)
_WINDOW = "STRUCT<utilization: DOUBLE, resets_at: STRING>"
BODY_SCHEMA = "STRUCT<{}>".format(
    ", ".join(
        [f"{k}: ARRAY<STRUCT<{_BUCKET}>>" for k in LIST_KEYS]
        + [f"{k}: BIGINT" for k in TOKEN_KEYS]
        + [f"five_hour: {_WINDOW}", f"seven_day: {_WINDOW}", "extra_usage: STRING"]
    )
)


def _counts(b: Column) -> tuple[Column, Column, Column, Column]:
    inp = truthy_number(b["uncached_input_tokens"], b["input_tokens"])
    return inp, *[truthy_number(b[k]) for k in ("cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")]


def _bucket(b: Column, as_of: Column, week_start: Column) -> Column:
    inp, create, read, out = _counts(b)
    tokens = inp + create + read + out
    stamps = [F.when(F.try_to_timestamp(b[k]).isNotNull(), F.substring(b[k], 1, 10).try_cast("date")) for k in STAMP_KEYS]
    day = F.coalesce(*stamps)
    starts = F.array(*[F.nullif(b[k], F.lit("")) for k in START_KEYS])
    ends = F.array(*[F.nullif(b[k], F.lit("")) for k in END_KEYS])
    return F.struct(
        inp.alias("input"),
        create.alias("cache_create"),
        read.alias("cache_read"),
        out.alias("output"),
        tokens.alias("tokens"),
        F.when(day == as_of, tokens).otherwise(F.lit(0)).alias("daily"),
        F.when(day >= week_start, tokens).otherwise(F.lit(0)).alias("weekly"),
        F.array_min(starts).alias("start"),
        F.array_max(ends).alias("end"),
    )


def _sum(buckets: Column, field: str) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda acc, b: acc + b[field].cast("bigint"))


def account_usage(bodies: DataFrame, as_of: Column) -> DataFrame:
    """Normalise bodies to one row each; `format` is buckets, flat, utilization or null."""
    week_start = F.to_date(F.date_trunc("week", as_of))
    parsed = bodies.withColumn("j", F.from_json("body", BODY_SCHEMA))
    lists = {k: F.filter(F.col("j")[k], lambda b: b.isNotNull()) for k in LIST_KEYS}
    # the first list with tokens is chosen as it came, and only that one is worked out
    chosen = F.coalesce(*[F.when(F.exists(v, lambda b: sum(_counts(b), F.lit(0)) > 0), v) for v in lists.values()])
    flat_input = truthy_number(F.col("j.input_tokens"), F.col("j.uncached_input_tokens"))
    flat_output = truthy_number(F.col("j.output_tokens"))
    rows = parsed.withColumn("chosen", chosen)
    rows = rows.withColumns({"b": F.transform("chosen", lambda b: _bucket(b, as_of, week_start)), "flat_input": flat_input, "flat_output": flat_output})
    has_window = F.col("j.five_hour.utilization").isNotNull() | F.col("j.seven_day.utilization").isNotNull()
    shape = one_of(
        [(F.col("b").isNotNull(), "buckets"), (F.col("flat_input") + F.col("flat_output") > 0, "flat"), (has_window, "utilization")]
    )
    rows = rows.withColumn("format", shape)
    buckets, flat, util = (F.col("format") == s for s in ("buckets", "flat", "utilization"))

    def tokens(name: str, flat_value: Column) -> Column:
        return F.when(buckets, _sum(F.col("b"), name)).when(flat, flat_value)

    five, seven = F.col("j.five_hour"), F.col("j.seven_day")
    five_ok, seven_ok = five["utilization"].isNotNull(), seven["utilization"].isNotNull()
    reset = F.when(seven_ok, seven["resets_at"]).otherwise(five["resets_at"])
    return rows.select(
        "body_id",
        "format",
        tokens("input", F.col("flat_input")).alias("input"),
        tokens("cache_create", truthy_number(F.col("j.cache_creation_input_tokens"))).alias("cache_create"),
        tokens("cache_read", truthy_number(F.col("j.cache_read_input_tokens"))).alias("cache_read"),
        tokens("output", F.col("flat_output")).alias("output"),
        F.when(buckets, _sum(F.col("b"), "daily")).when(flat | util, F.lit(0)).alias("daily_total"),
        F.when(buckets, _sum(F.col("b"), "weekly")).when(flat | util, F.lit(0)).alias("weekly_total"),
        F.when(buckets, F.array_min(F.transform("b", lambda b: b["start"]))).alias("period_start"),
        F.when(buckets, F.array_max(F.transform("b", lambda b: b["end"]))).when(util, reset).alias("period_end"),
        F.when(util & five_ok, five["utilization"]).alias("five_hour_utilization"),
        F.when(util & five_ok, five["resets_at"]).alias("five_hour_resets_at"),
        F.when(util & seven_ok, seven["utilization"]).alias("seven_day_utilization"),
        F.when(util & seven_ok, seven["resets_at"]).alias("seven_day_resets_at"),
        F.when(util & F.col("j.extra_usage").startswith("{"), F.col("j.extra_usage")).alias("extra_usage"),
    ).withColumn(
        "total",
        F.when(util, F.lit(0)).otherwise(F.col("input") + F.col("cache_create") + F.col("cache_read") + F.col("output")),
    )


def account_pct_of_period(usage: DataFrame) -> DataFrame:
    """Today and this week as percent of the period's total; null where either side is empty."""
    def pct(part: str) -> Column:
        return F.when((F.col("total") > 0) & (F.col(part) > 0), F.col(part) / F.col("total") * 100)

    def bar(part: str) -> Column:
        return clamp(pct(part) / 100, 0.0, 1.0)

    return usage.withColumns(
        {"daily_pct": pct("daily_total"), "weekly_pct": pct("weekly_total"), "daily_bar": bar("daily_total"), "weekly_bar": bar("weekly_total")}
    )
