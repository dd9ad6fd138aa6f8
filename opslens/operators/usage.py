"""Token usage from session logs: daily, weekly and per-project totals, limits and shares.

A *turn* has `turn_id, ts, project, cwd` and four token counts. All relative dates come from `as_of`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.columns import band, clamp, one_of

LOOKBACK_DAYS = 63


def flatten_usage(logs: DataFrame) -> DataFrame:
    """Nested log lines to turns; lines without usage, output tokens or a timestamp are no turns.

    `day` is the calendar date in the stamp's own offset, `ts` the instant in UTC.
    """
    usage = F.col("message.usage")
    turns = logs.where(
        (F.coalesce(usage["output_tokens"], F.lit(0)) != 0) & (F.coalesce(F.col("timestamp"), F.lit("")) != "")
    )
    return turns.select(
        "turn_id",
        F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("ts"),
        F.substring("timestamp", 1, 10).try_cast("date").alias("day"),
        "project",
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        usage["input_tokens"].alias("input_tokens"),
        usage["cache_creation_input_tokens"].alias("cache_creation_input_tokens"),
        usage["cache_read_input_tokens"].alias("cache_read_input_tokens"),
        usage["output_tokens"].alias("output_tokens"),
    ).where(F.col("ts").isNotNull())


def completed_turns(turns: DataFrame) -> DataFrame:
    """Flat turns that count: truthy output and a timestamp."""
    kept = turns.where((F.col("output_tokens") != 0) & F.col("ts").isNotNull())
    return kept if "day" in turns.columns else kept.withColumn("day", F.to_date("ts"))


def include_paths(turns: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Case-insensitive prefix match on `cwd`, any of the prefixes; none given keeps all."""
    hit = None
    for prefix in prefixes:
        test = F.lower("cwd").startswith(prefix.lower())
        hit = test if hit is None else hit | test
    return turns if hit is None else turns.where(hit)


def billable_input() -> Column:
    parts = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    total = F.lit(0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0))
    return total


def with_totals(turns: DataFrame) -> DataFrame:
    return completed_turns(turns).withColumn("input", billable_input()).withColumn("output", F.col("output_tokens"))


def usage_daily(turns: DataFrame, since: dt.date) -> DataFrame:
    return (
        with_totals(turns)
        .where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        .groupBy("day")
        .agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
        .withColumn("total", F.col("input") + F.col("output"))
    )


def _last_turn() -> Column:
    carried = F.struct(
        "ts", "turn_id", "input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"
    )
    return F.max_by(carried, F.struct(F.col("ts"), -F.col("turn_id")))


def last_turn(turns: DataFrame) -> DataFrame:
    """Latest turn of all; the lowest id wins a tie."""
    return completed_turns(turns).agg(_last_turn().alias("t")).select("t.*")


def project_label(project: Column, cwd: Column) -> Column:
    """Last path segment of the working folder, else the readable tail of the log folder's name."""
    segment = F.regexp_extract(F.regexp_replace(cwd, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    tail = F.trim(F.replace(F.element_at(F.split(project, "--"), -1), F.lit("-"), F.lit(" ")))
    readable = F.when(F.coalesce(cwd, F.lit("")) != "", segment).otherwise(tail)
    return F.coalesce(F.nullif(readable, F.lit("")), project)


def project_day(turns: DataFrame, as_of: dt.date) -> DataFrame:
    """Per log folder totals of one day, with the earliest non-empty working folder and a label."""
    named = F.col("cwd") != ""
    first_cwd = F.min_by(F.when(named, F.col("cwd")), F.when(named, F.struct("ts", "turn_id")))
    return (
        with_totals(turns)
        .where(F.col("day") == F.lit(as_of))
        .groupBy("project")
        .agg(F.sum("input").alias("input"), F.sum("output").alias("output"), first_cwd.alias("cwd"))
        .withColumn("total", F.col("input") + F.col("output"))
        .withColumn("label", project_label(F.col("project"), F.col("cwd")))
    )


def project_share(turns: DataFrame, as_of: dt.date) -> DataFrame:
    """Share of every project in the day's total, with a label cut to 24 characters."""
    projects = project_day(turns, as_of)
    day_total = projects.agg(F.coalesce(F.sum("total"), F.lit(0))).scalar()
    share = F.when(day_total > 0, F.col("total") / day_total).otherwise(F.lit(0.0))
    cut = F.when(F.length("label") <= 24, F.col("label")).otherwise(F.concat(F.substring("label", 1, 21), F.lit("…")))
    rows = projects.select("project", cut.alias("label"), "total", share.alias("share"), band(share).alias("band"))
    return rows.orderBy(F.desc("total"), "project")


def today_totals(daily: DataFrame, as_of: dt.date) -> DataFrame:
    return _period_totals(daily, F.col("day") == F.lit(as_of))


def week_to_date(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """Monday through `as_of`, both included."""
    return _period_totals(daily, F.col("day").between(F.lit(monday(as_of)), F.lit(as_of)))


def _period_totals(daily: DataFrame, inside: Column) -> DataFrame:
    sums = daily.where(inside).agg(
        F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("output"), F.lit(0)).alias("output")
    )
    return sums.withColumn("total", F.col("input") + F.col("output"))


def trailing_7d(daily: DataFrame) -> DataFrame:
    """Total of the seven days ending on each day: every day adds itself to the seven windows it is in."""
    windows = daily.select(
        F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"), "total"
    ).groupBy("day").agg(F.sum("total").alias("trailing_total"))
    return windows.join(daily.select("day"), "day", "left_semi")


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def _mean_or_zero(total: Column, count: Column) -> Column:
    return F.coalesce((total / F.nullif(count, F.lit(0))).cast("bigint"), F.lit(0))


def _counted_day(excluded: Sequence[int]) -> Column:
    return ~F.weekday("day").isin(list(excluded)) if excluded else F.lit(True)


def _prior_days(as_of: dt.date, excluded: Sequence[int]) -> Column:
    first, last = as_of - dt.timedelta(days=7), as_of - dt.timedelta(days=1)
    return F.col("day").between(F.lit(first), F.lit(last)) & (F.col("total") > 0) & _counted_day(excluded)


def daily_limit(daily: DataFrame, as_of: dt.date, excluded: Sequence[int] = ()) -> DataFrame:
    """Mean of the previous seven days; excluded weekdays (Monday is 0) and empty days do not count."""
    days = daily.where(_prior_days(as_of, excluded))
    return days.agg(_mean_or_zero(F.sum("total"), F.count("*")).alias("daily_limit"))


def _weekly(daily: DataFrame, excluded: Sequence[int]) -> DataFrame:
    counted = daily.where(_counted_day(excluded))
    return counted.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.sum("total").alias("total"))


def _prior_weeks(as_of: dt.date) -> Column:
    last = monday(as_of) - dt.timedelta(weeks=1)
    return F.col("week").between(F.lit(last - dt.timedelta(weeks=6)), F.lit(last)) & (F.col("total") > 0)


def weekly_limit(daily: DataFrame, as_of: dt.date, excluded: Sequence[int] = ()) -> DataFrame:
    """Mean of the seven previous full weeks, without excluded weekdays; empty weeks do not count."""
    weeks = _weekly(daily, excluded).where(_prior_weeks(as_of))
    return weeks.agg(_mean_or_zero(F.sum("total"), F.count("*")).alias("weekly_limit"))


def usage_summary(turns: DataFrame, as_of: dt.date, excluded: Sequence[int] = ()) -> DataFrame:
    """One row: today, week to date, both limits and the latest turn.

    The turns are hash-aggregated by day once; all totals then come from a handful of rows (day, week, one row).
    The latest turn is a second narrow scan without keys: inside the first one its row struct would turn the
    hash aggregate into a sort of all turns.
    """
    daily = usage_daily(turns, as_of - dt.timedelta(days=LOOKBACK_DAYS))
    days = daily.withColumn("week", F.to_date(F.date_trunc("week", "day")))
    today = F.col("day") == F.lit(as_of)
    this_week = F.col("day").between(F.lit(monday(as_of)), F.lit(as_of))

    def part(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0))

    weeks = days.groupBy("week").agg(
        part(today, "input").alias("today_input"),
        part(today, "output").alias("today_output"),
        part(this_week, "input").alias("week_input"),
        part(this_week, "output").alias("week_output"),
        part(_prior_days(as_of, excluded), "total").alias("prior_total"),
        F.count_if(_prior_days(as_of, excluded)).alias("prior_days"),
        part(_counted_day(excluded), "total").alias("total"),
    )
    prior_weeks = _prior_weeks(as_of)
    sums = weeks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("today_input", "today_output", "week_input", "week_output")],
        _mean_or_zero(F.sum("prior_total"), F.sum("prior_days")).alias("daily_limit"),
        _mean_or_zero(F.sum(F.when(prior_weeks, F.col("total"))), F.count_if(prior_weeks)).alias("weekly_limit"),
    )
    last = completed_turns(turns).agg(_last_turn().alias("t")).scalar()
    return sums.withColumn("last", last).select(
        F.lit(as_of).alias("as_of"),
        F.lit(monday(as_of)).alias("week_start"),
        "today_input",
        "today_output",
        (F.col("today_input") + F.col("today_output")).alias("today_total"),
        "week_input",
        "week_output",
        (F.col("week_input") + F.col("week_output")).alias("week_total"),
        "daily_limit",
        "weekly_limit",
        F.col("last.ts").alias("last_ts"),
        F.col("last.input_tokens").alias("last_input"),
        F.col("last.cache_creation_input_tokens").alias("last_cache_create"),
        F.col("last.cache_read_input_tokens").alias("last_cache_read"),
        F.col("last.output_tokens").alias("last_output"),
    )


def usage_report(turns: DataFrame, as_of: dt.date, excluded: Sequence[int] = ()) -> DataFrame:
    """The summary in a first row without a project, then the day's projects, largest first, in rows of their own.

    Projects are as many as the day has, so they are rows and never one list.
    """
    rows = usage_summary(turns, as_of, excluded).unionByName(project_breakdown(turns, as_of).drop("as_of"), allowMissingColumns=True)
    return rows.orderBy(F.desc_nulls_first("project_total"), F.asc_nulls_first("project"))


def project_breakdown(turns: DataFrame, as_of: dt.date) -> DataFrame:
    """The day's projects that go with the summary of `as_of`, largest first, a row each: they are as many as the day has."""
    columns = {"project": "project", "label": "project_label", "input": "project_input", "output": "project_output", "total": "project_total"}
    projects = project_day(turns, as_of).select(F.lit(as_of).alias("as_of"), *[F.col(a).alias(b) for a, b in columns.items()])
    return projects.orderBy(F.desc("project_total"), "project")


def limit_status(df: DataFrame, total: str, limit: str) -> DataFrame:
    """Percent of the limit, what remains, traffic-light band and bar length; null where there is no limit."""
    share = F.when(F.col(limit) > 0, F.col(total) / F.col(limit))
    return df.withColumns(
        {
            "pct": share * 100,
            "remaining": F.when(F.col(limit) > 0, F.greatest(F.col(limit) - F.col(total), F.lit(0))),
            "band": F.when(share.isNotNull() & (F.col(total) > 0), band(share)),
            "bar": F.when(F.col(total) > 0, clamp(share, 0.0, 1.0)),
        }
    )


def reset_countdown(resets_at: Column, as_of: Column) -> Column:
    """Time left until `resets_at` as `Nd Nh`, `Nh Nm` or `Nm`; past times give `0m`, no time gives ''."""
    left = F.unix_timestamp(F.try_to_timestamp(resets_at)) - F.unix_timestamp(as_of)
    seconds = F.when(left > 0, left).when(left.isNotNull(), F.lit(0))
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    text = one_of(
        [
            (hours >= 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit("h"))),
            (hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))),
            (minutes >= 0, F.concat(minutes.cast("string"), F.lit("m"))),
        ],
        "",
    )
    return F.coalesce(text, F.lit(""))
