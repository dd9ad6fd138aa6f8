"""Registered usage queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opslens.operators import bodies, usage
from opslens.plans.registry import query
from opslens.plans.views import view

AS_OF = dt.date(2024, 1, 30)
SINCE = AS_OF - dt.timedelta(days=usage.LOOKBACK_DAYS)
WEEKEND = (5, 6)
NOW = "2024-01-30 09:30:00"

DONE = """done AS (SELECT *, CAST(ts AS DATE) AS day,
 input_tokens + coalesce(cache_creation_input_tokens, 0) + coalesce(cache_read_input_tokens, 0) AS inp
 FROM usage_turns WHERE output_tokens <> 0 AND ts IS NOT NULL),
daily AS (SELECT day, CAST(sum(inp) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output,
 CAST(sum(inp) + sum(output_tokens) AS BIGINT) AS total FROM done WHERE ts >= DATE '2023-11-28' GROUP BY day)"""
U = ("usage_turns",)


def turns(spark, sf_dir):
    return view(spark, sf_dir, "usage_turns")


def daily(spark, sf_dir):
    return usage.usage_daily(turns(spark, sf_dir), SINCE)


def nested_logs(spark, sf_dir):
    """The turns in the nested shape of a session log line."""
    counts = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
    return turns(spark, sf_dir).select(
        "turn_id",
        "project",
        "cwd",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
        F.struct(F.struct(*counts).alias("usage")).alias("message"),
    )


def as_text(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query("u01_flatten_usage", U, """SELECT turn_id, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, project, cwd, input_tokens,
 cache_creation_input_tokens, cache_read_input_tokens, output_tokens FROM usage_turns WHERE output_tokens <> 0""")
def u01(spark, sf_dir):
    return as_text(usage.flatten_usage(nested_logs(spark, sf_dir)), "day")


@query("u02_include_paths", U, """SELECT turn_id, cwd FROM usage_turns
 WHERE lower(cwd) LIKE '/srv/team1%' OR lower(cwd) LIKE '/srv/team3/app-3%'""")
def u02(spark, sf_dir):
    return usage.include_paths(turns(spark, sf_dir), ["/srv/TEAM1", "/srv/team3/app-3"]).select("turn_id", "cwd")


@query("u03_billable_input", U, """SELECT turn_id, input_tokens + coalesce(cache_creation_input_tokens, 0)
 + coalesce(cache_read_input_tokens, 0) AS billable FROM usage_turns""")
def u03(spark, sf_dir):
    return turns(spark, sf_dir).select("turn_id", usage.billable_input().alias("billable"))


@query("u04_event_day", U, DONE + " SELECT CAST(day AS VARCHAR) AS day, count(*) AS turns FROM done GROUP BY day")
def u04(spark, sf_dir):
    flat = usage.flatten_usage(nested_logs(spark, sf_dir))
    return as_text(flat.groupBy("day").agg(F.count("*").alias("turns")), "day")


@query("u05_usage_daily", U, DONE + " SELECT CAST(day AS VARCHAR) AS day, input, output, total FROM daily")
def u05(spark, sf_dir):
    return as_text(daily(spark, sf_dir), "day")


@query("u06_last_turn", U, DONE + """ SELECT ts, turn_id, input_tokens, cache_creation_input_tokens,
 cache_read_input_tokens, output_tokens FROM done ORDER BY ts DESC, turn_id LIMIT 1""")
def u06(spark, sf_dir):
    return usage.last_turn(turns(spark, sf_dir))


PROJECTS = DONE + """, per_project AS (SELECT project, CAST(sum(inp) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output,
 CAST(sum(inp) + sum(output_tokens) AS BIGINT) AS total, first(cwd ORDER BY ts, turn_id) FILTER (WHERE cwd <> '') AS cwd
 FROM done WHERE day = DATE '2024-01-30' GROUP BY project),
labelled AS (SELECT *, coalesce(nullif(CASE WHEN coalesce(cwd, '') <> '' THEN regexp_extract(regexp_replace(cwd, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1)
 ELSE trim(replace(list_extract(string_split(project, '--'), -1), '-', ' ')) END, ''), project) AS label FROM per_project)"""


@query("u07_project_day", U, PROJECTS + " SELECT project, input, output, total, cwd FROM labelled")
def u07(spark, sf_dir):
    return usage.project_day(turns(spark, sf_dir), AS_OF).drop("label")


@query("u08_project_label", U, """seen AS (SELECT DISTINCT project, cwd FROM usage_turns)
 SELECT project, cwd, coalesce(nullif(CASE WHEN cwd <> '' THEN regexp_extract(regexp_replace(cwd, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1)
 ELSE trim(replace(list_extract(string_split(project, '--'), -1), '-', ' ')) END, ''), project) AS label FROM seen""")
def u08(spark, sf_dir):
    seen = turns(spark, sf_dir).select("project", "cwd").distinct()
    return seen.withColumn("label", usage.project_label(F.col("project"), F.col("cwd")))


@query("u09_project_share", U, PROJECTS + """, shares AS (SELECT *, CASE WHEN sum(total) OVER () > 0 THEN total / sum(total) OVER () ELSE 0.0 END AS s FROM labelled)
 SELECT project, CASE WHEN length(label) <= 24 THEN label ELSE substr(label, 1, 21) || '…' END AS label, total, round(s, 6) AS share,
 CASE WHEN s >= 0.9 THEN 'red' WHEN s >= 0.7 THEN 'amber' ELSE 'green' END AS band FROM shares""")
def u09(spark, sf_dir):
    return usage.project_share(turns(spark, sf_dir), AS_OF).withColumn("share", F.round("share", 6))


@query("u10_today_totals", U, DONE + """ SELECT CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(output), 0) AS BIGINT) AS output,
 CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM daily WHERE day = DATE '2024-01-30'""")
def u10(spark, sf_dir):
    return usage.today_totals(daily(spark, sf_dir), AS_OF)


@query("u11_week_to_date", U, DONE + """ SELECT CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(output), 0) AS BIGINT) AS output,
 CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM daily WHERE day BETWEEN date_trunc('week', DATE '2024-01-30') AND DATE '2024-01-30'""")
def u11(spark, sf_dir):
    return usage.week_to_date(daily(spark, sf_dir), AS_OF)


@query("u12_trailing_7d", U, DONE + """ SELECT CAST(day AS VARCHAR) AS day, CAST(sum(total) OVER (ORDER BY day
 RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_total FROM daily""")
def u12(spark, sf_dir):
    return as_text(usage.trailing_7d(daily(spark, sf_dir)), "day")


@query("u13_daily_limit", U, DONE + """ SELECT CAST(coalesce(trunc(sum(total) / nullif(count(*), 0)), 0) AS BIGINT) AS daily_limit FROM daily
 WHERE day BETWEEN DATE '2024-01-23' AND DATE '2024-01-29' AND total > 0 AND isodow(day) - 1 NOT IN (5, 6)""")
def u13(spark, sf_dir):
    return usage.daily_limit(daily(spark, sf_dir), AS_OF, WEEKEND)


@query("u14_weekly_limit", U, DONE + """, weeks AS (SELECT date_trunc('week', day) AS week, sum(total) AS total FROM daily
 WHERE isodow(day) - 1 NOT IN (5, 6) GROUP BY 1)
 SELECT CAST(coalesce(trunc(sum(total) / nullif(count(*), 0)), 0) AS BIGINT) AS weekly_limit FROM weeks
 WHERE week BETWEEN DATE '2023-12-11' AND DATE '2024-01-22' AND total > 0""")
def u14(spark, sf_dir):
    return usage.weekly_limit(daily(spark, sf_dir), AS_OF, WEEKEND)


SUMMARY = DONE + """, weeks AS (SELECT date_trunc('week', day) AS week, sum(total) AS total FROM daily
 WHERE isodow(day) - 1 NOT IN (5, 6) GROUP BY 1),
wl AS (SELECT CAST(coalesce(trunc(sum(total) / nullif(count(*), 0)), 0) AS BIGINT) AS weekly_limit FROM weeks
 WHERE week BETWEEN DATE '2023-12-11' AND DATE '2024-01-22' AND total > 0),
dl AS (SELECT CAST(coalesce(trunc(sum(total) / nullif(count(*), 0)), 0) AS BIGINT) AS daily_limit FROM daily
 WHERE day BETWEEN DATE '2024-01-23' AND DATE '2024-01-29' AND total > 0 AND isodow(day) - 1 NOT IN (5, 6)),
td AS (SELECT CAST(coalesce(sum(input), 0) AS BIGINT) AS today_input, CAST(coalesce(sum(output), 0) AS BIGINT) AS today_output,
 CAST(coalesce(sum(total), 0) AS BIGINT) AS today_total FROM daily WHERE day = DATE '2024-01-30'),
wk AS (SELECT CAST(coalesce(sum(input), 0) AS BIGINT) AS week_input, CAST(coalesce(sum(output), 0) AS BIGINT) AS week_output,
 CAST(coalesce(sum(total), 0) AS BIGINT) AS week_total FROM daily WHERE day BETWEEN DATE '2024-01-29' AND DATE '2024-01-30'),
lt AS (SELECT ts AS last_ts, input_tokens AS last_input, cache_creation_input_tokens AS last_cache_create,
 cache_read_input_tokens AS last_cache_read, output_tokens AS last_output FROM done ORDER BY ts DESC, turn_id LIMIT 1),
summary AS (SELECT '2024-01-30' AS as_of, '2024-01-29' AS week_start, * FROM td, wk, dl, wl, lt)"""


@query("u15_usage_summary", U, SUMMARY + PROJECTS.removeprefix(DONE) + """ SELECT summary.*, project, label AS project_label, input AS project_input, output AS project_output, total AS project_total
 FROM summary FULL JOIN labelled ON false""")
def u15(spark, sf_dir):
    return as_text(usage.usage_report(turns(spark, sf_dir), AS_OF, WEEKEND), "as_of", "week_start")


@query("u15_project_breakdown", U, SUMMARY + PROJECTS.removeprefix(DONE) + """ SELECT as_of, project, label AS project_label, input AS project_input, output AS project_output, total AS project_total
 FROM summary CROSS JOIN labelled""")
def u15_projects(spark, sf_dir):
    return as_text(usage.project_breakdown(turns(spark, sf_dir), AS_OF), "as_of")


@query("u16_limit_status", U, SUMMARY + """ SELECT period, total, lim, round(total / lim * 100, 6) AS pct, greatest(lim - total, 0) AS remaining,
 CASE WHEN total <= 0 THEN NULL WHEN total / lim >= 0.9 THEN 'red' WHEN total / lim >= 0.7 THEN 'amber' ELSE 'green' END AS band,
 round(CASE WHEN total > 0 THEN least(total / lim, 1.0) END, 6) AS bar
 FROM (SELECT 'day' AS period, today_total AS total, daily_limit AS lim FROM summary UNION ALL SELECT 'week', week_total, weekly_limit FROM summary) x""")
def u16(spark, sf_dir):
    summary = usage.usage_summary(turns(spark, sf_dir), AS_OF, WEEKEND)
    periods = summary.selectExpr("stack(2, 'day', today_total, daily_limit, 'week', week_total, weekly_limit) AS (period, total, lim)")
    status = usage.limit_status(periods, "total", "lim")
    return status.withColumns({"pct": F.round("pct", 6), "bar": F.round("bar", 6)})


def _usage_bodies(spark, sf_dir):
    return bodies.account_usage(view(spark, sf_dir, "api_bodies"), F.lit(AS_OF))


BUCKETS = """keyed AS (SELECT body_id, k.ord, k.name, json_extract(body, '$.' || k.name) AS arr FROM api_bodies
 CROSS JOIN (VALUES (1, 'results'), (2, 'data'), (3, 'buckets'), (4, 'items')) k(ord, name)),
elems AS (SELECT body_id, ord, unnest(CAST(arr AS JSON[])) AS e FROM keyed WHERE json_type(arr) = 'ARRAY'),
toks AS (SELECT body_id, ord, e,
 coalesce(nullif(CAST(e->>'$.uncached_input_tokens' AS BIGINT), 0), nullif(CAST(e->>'$.input_tokens' AS BIGINT), 0), 0) AS inp,
 coalesce(CAST(e->>'$.cache_creation_input_tokens' AS BIGINT), 0) AS cc, coalesce(CAST(e->>'$.cache_read_input_tokens' AS BIGINT), 0) AS cr,
 coalesce(CAST(e->>'$.output_tokens' AS BIGINT), 0) AS outp,
 CAST(substr(coalesce(e->>'$.start_time', e->>'$.from'), 1, 10) AS DATE) AS d FROM elems),
per_key AS (SELECT body_id, ord, CAST(sum(inp) AS BIGINT) AS input, CAST(sum(cc) AS BIGINT) AS cache_create, CAST(sum(cr) AS BIGINT) AS cache_read,
 CAST(sum(outp) AS BIGINT) AS output, CAST(sum(inp + cc + cr + outp) AS BIGINT) AS total,
 CAST(coalesce(sum(inp + cc + cr + outp) FILTER (WHERE d = DATE '2024-01-30'), 0) AS BIGINT) AS daily_total,
 CAST(coalesce(sum(inp + cc + cr + outp) FILTER (WHERE d >= DATE '2024-01-29'), 0) AS BIGINT) AS weekly_total,
 min(least(coalesce(e->>'$.start_time', e->>'$.from'), coalesce(e->>'$.from', e->>'$.start_time'))) AS period_start,
 max(e->>'$.end_time') AS period_end FROM toks GROUP BY body_id, ord HAVING max(inp + cc + cr + outp) > 0),
a AS (SELECT * FROM per_key QUALIFY row_number() OVER (PARTITION BY body_id ORDER BY ord) = 1)"""


@query("u17_account_usage_buckets", ("api_bodies",), BUCKETS + """ SELECT body_id, input, cache_create, cache_read, output, total, daily_total,
 weekly_total, period_start, period_end FROM a""")
def u17(spark, sf_dir):
    rows = _usage_bodies(spark, sf_dir).where(F.col("format") == "buckets")
    return rows.select(
        "body_id", "input", "cache_create", "cache_read", "output", "total", "daily_total", "weekly_total", "period_start", "period_end"
    )


@query("u18_account_usage_other", ("api_bodies",), BUCKETS + """, f AS (SELECT body_id, body,
 coalesce(nullif(CAST(body->>'$.input_tokens' AS BIGINT), 0), nullif(CAST(body->>'$.uncached_input_tokens' AS BIGINT), 0), 0) AS inp,
 coalesce(CAST(body->>'$.output_tokens' AS BIGINT), 0) AS outp, CAST(body->>'$.five_hour.utilization' AS DOUBLE) AS five FROM api_bodies WHERE body_id NOT IN (SELECT body_id FROM a))
 SELECT body_id, CASE WHEN inp + outp > 0 THEN 'flat' WHEN five IS NOT NULL THEN 'utilization' END AS format,
 CASE WHEN inp + outp > 0 THEN inp END AS input, CASE WHEN inp + outp > 0 THEN outp END AS output,
 CASE WHEN inp + outp > 0 THEN inp + outp WHEN five IS NOT NULL THEN 0 END AS total, CASE WHEN inp + outp = 0 THEN five END AS five_hour_utilization,
 CASE WHEN inp + outp = 0 THEN body->>'$.five_hour.resets_at' END AS five_hour_resets_at,
 CASE WHEN json_type(body, '$.extra_usage') = 'OBJECT' THEN body->>'$.extra_usage' END AS extra_usage FROM f""")
def u18(spark, sf_dir):
    rows = _usage_bodies(spark, sf_dir).where(F.coalesce("format", F.lit("")) != "buckets")
    return rows.select("body_id", "format", "input", "output", "total", "five_hour_utilization", "five_hour_resets_at", "extra_usage")


@query("u19_reset_countdown", U, """SELECT turn_id, CASE WHEN h >= 24 THEN CAST(h // 24 AS VARCHAR) || 'd ' || CAST(h % 24 AS VARCHAR) || 'h'
 WHEN h > 0 THEN CAST(h AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm' ELSE CAST(s % 3600 // 60 AS VARCHAR) || 'm' END AS countdown
 FROM (SELECT turn_id, s, s // 3600 AS h FROM (SELECT turn_id, greatest(CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-30 09:30:00') AS BIGINT), 0) AS s FROM usage_turns) x) y""")
def u19(spark, sf_dir):
    resets = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return turns(spark, sf_dir).select("turn_id", usage.reset_countdown(resets, F.lit(NOW).cast("timestamp")).alias("countdown"))


@query("u20_account_pct_of_period", ("api_bodies",), BUCKETS + """ SELECT body_id,
 round(CASE WHEN daily_total > 0 THEN daily_total / total * 100 END, 6) AS daily_pct,
 round(CASE WHEN weekly_total > 0 THEN weekly_total / total * 100 END, 6) AS weekly_pct FROM a""")
def u20(spark, sf_dir):
    rows = bodies.account_pct_of_period(_usage_bodies(spark, sf_dir).where(F.col("format") == "buckets"))
    return rows.select("body_id", F.round("daily_pct", 6).alias("daily_pct"), F.round("weekly_pct", 6).alias("weekly_pct"))
