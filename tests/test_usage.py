"""Hand-worked usage cases: ties, zero days, excluded weekdays, empty input, limits."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from opslens.operators import bodies, usage
from opslens.sources.logs import quarantine_bad_lines, read_session_logs

SCHEMA = (
    "turn_id BIGINT, ts TIMESTAMP_NTZ, project STRING, cwd STRING, input_tokens BIGINT, "
    "cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, output_tokens BIGINT"
)
WED = dt.date(2024, 3, 6)


def turns(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def at(day, hour=12, month=3):
    return dt.datetime(2024, month, day, hour)


def summary(spark, rows, excluded=()):
    return usage.usage_summary(turns(spark, *rows), WED, excluded).collect()[0]


def test_empty_input(spark):
    row = usage.usage_summary(turns(spark), WED).collect()[0]
    assert (row.today_total, row.week_total, row.daily_limit, row.weekly_limit, row.last_ts) == (0, 0, 0, 0, None)


def test_limits_skip_zero_and_excluded_days(spark):
    rows = [
        (at(6), "p", "", 10, 5, None, 1),
        (at(5), "p", "", 99, None, None, 1),  # Tuesday
        (at(4), "p", "", 50, None, None, 0),  # no output: no turn
        (at(3), "p", "", 1000, None, None, 1),  # Sunday
        (at(29, month=2), "p", "", 200, None, None, 2),  # Thursday
    ]
    row = summary(spark, rows, excluded=(5, 6))
    assert (row.today_input, row.today_output, row.today_total) == (15, 1, 16)
    assert row.week_total == 116
    assert row.daily_limit == (100 + 202) // 2
    assert row.weekly_limit == 202
    assert summary(spark, rows).daily_limit == int((100 + 1001 + 202) / 3)
    assert summary(spark, rows).weekly_limit == 1203


def test_limit_is_cut_not_rounded(spark):
    rows = [(at(5), "p", "", 1, None, None, 1), (at(4), "p", "", 2, None, None, 1)]
    assert summary(spark, rows).daily_limit == 2


def test_last_turn_first_wins_tie_and_ignores_since(spark):
    old = dt.datetime(2023, 1, 1, 5)
    row = summary(spark, [(old, "p", "", 7, None, None, 3), (old, "p", "", 8, None, None, 4)])
    assert (row.last_ts, row.last_input, row.last_output, row.week_total) == (old, 7, 3, 0)


def test_week_starts_on_monday(spark):
    daily = usage.usage_daily(turns(spark, (at(3), "p", "", 1, None, None, 1), (at(4), "p", "", 1, None, None, 1)), dt.date(2024, 1, 1))
    assert usage.week_to_date(daily, WED).collect()[0].total == 2
    assert usage.week_to_date(daily, dt.date(2024, 3, 3)).collect()[0].total == 2


def test_project_day_and_labels(spark):
    rows = [
        (at(6, 8), "home--my-tool", "", 1, None, None, 1),
        (at(6, 9), "home--other", "", 1, None, None, 1),
        (at(6, 10), "home--other", "C:\\work\\thing\\", 1, None, None, 1),
        (at(6, 11), "home--other", "/later", 1, None, None, 1),
        (at(6, 12), "x--", "", 1, None, None, 1),
        (at(6, 13), "long", "/a/" + "n" * 30, 1, None, None, 1),
    ]
    labels = {r.project: r.label for r in usage.project_day(turns(spark, *rows), WED).collect()}
    assert labels == {"home--my-tool": "my tool", "home--other": "thing", "x--": "x--", "long": "n" * 30}
    shares = {r.project: (r.label, round(r.share, 4), r.band) for r in usage.project_share(turns(spark, *rows), WED).collect()}
    assert shares["long"] == ("n" * 21 + "…", round(2 / 12, 4), "green")
    assert usage.project_share(turns(spark), WED).count() == 0


def test_include_paths(spark):
    rows = turns(spark, (at(1), "p", "/Srv/A", 1, None, None, 1), (at(1), "p", "", 1, None, None, 1))
    assert usage.include_paths(rows, []).count() == 2
    assert usage.include_paths(rows, ["/srv", "/x"]).count() == 1


def test_limit_status(spark):
    df = spark.createDataFrame([(90, 100), (70, 100), (69, 100), (150, 100), (5, 0), (0, 10)], "total BIGINT, lim BIGINT")
    got = [(r.band, r.remaining, r.bar) for r in usage.limit_status(df, "total", "lim").collect()]
    assert got == [("red", 10, 0.9), ("amber", 30, 0.7), ("green", 31, 0.69), ("red", 0, 1.0), (None, None, None), (None, 10, None)]


def test_reset_countdown(spark):
    df = spark.createDataFrame([("2024-03-08T14:30:00Z",), ("2024-03-06T14:30:00+02:00",), ("2024-03-06T12:05:00Z",), ("2020-01-01T00:00:00Z",), (None,), ("soon",)], "r STRING")
    now = F.lit("2024-03-06 12:00:00").cast("timestamp")
    got = [r.c for r in df.select(usage.reset_countdown(F.col("r"), now).alias("c")).collect()]
    assert got == ["2d 2h", "30m", "5m", "0m", "", ""]


def test_flatten_keeps_the_stamps_own_date(spark):
    shape = "turn_id BIGINT, project STRING, cwd STRING, timestamp STRING, message STRUCT<usage: STRUCT<input_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT, output_tokens: BIGINT>>"
    usage_row = ((1, None, None, 2),)
    df = spark.createDataFrame(
        [(1, "p", None, "2024-03-06T23:30:00-05:00", usage_row), (2, "p", "", "", usage_row), (3, "p", "", "2024-03-06T10:00:00Z", (None,))], shape
    )
    rows = usage.flatten_usage(df).collect()
    assert [(r.turn_id, r.day, r.ts) for r in rows] == [(1, dt.date(2024, 3, 6), dt.datetime(2024, 3, 7, 4, 30))]


def line(stamp, out=1):
    return json.dumps({"timestamp": stamp, "cwd": "/a", "message": {"usage": {"input_tokens": 1, "output_tokens": out}}})


def test_session_log_files(spark, tmp_path):
    for project in ("one", "two"):
        (tmp_path / project).mkdir()
    deep = tmp_path / "one" / "deeper"
    deep.mkdir()
    (deep / "x.jsonl").write_text(line("2024-03-06T01:00:00Z"))
    (tmp_path / "one" / "notes.txt").write_text("no log")
    (tmp_path / "one" / "a.jsonl").write_text("\n".join([line("2024-03-06T01:00:00Z"), "", "  ", "{broken", line("2024-03-06T02:00:00Z")]))
    (tmp_path / "two" / "b.jsonl").write_text("\n".join([line("2024-03-06T03:00:00Z"), line("not a time"), line("2024-03-06T04:00:00Z")]))
    logs = read_session_logs(spark, str(tmp_path))
    good, bad = quarantine_bad_lines(logs)
    assert sorted((r.project, r.timestamp[11:13]) for r in good.collect()) == [("one", "01"), ("one", "02"), ("two", "03"), ("two", "04")]
    assert {r.bad_line[:7] for r in bad.collect()} == {"{broken", '{"times'}
    strict, _ = quarantine_bad_lines(logs, "stop_at_first_bad")
    assert sorted((r.project, r.timestamp[11:13]) for r in strict.collect()) == [("one", "01"), ("two", "03")]


def test_session_logs_lie_two_levels_deep(spark, tmp_path):
    for path in ("loose.jsonl", "-p/a.jsonl", "-p/day=1/b.jsonl", "_q/c.jsonl", "_q/sub/x/d.jsonl"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(line("2024-03-06T01:00:00Z"))
    logs = read_session_logs(spark, str(tmp_path))
    assert sorted(r.project for r in logs.collect()) == ["-p", "_q"]


def test_strict_mode_over_file_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = [line(f"2024-03-06T0{i % 10}:00:00Z") for i in range(400)]
    lines[250] = "{bad"
    (tmp_path / "p" / "a.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        logs = read_session_logs(spark, str(tmp_path))
        assert logs.rdd.getNumPartitions() > 3
        assert quarantine_bad_lines(logs, "stop_at_first_bad")[0].count() == 250
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_account_usage_shapes(spark):
    texts = [
        {"results": [], "data": [{"uncached_input_tokens": 0, "input_tokens": 5, "timestamp": "2024-03-06T01:00:00Z", "from": "b", "end": "z"}, {"output_tokens": 2, "start": "a", "to": "y"}]},
        {"results": [{"output_tokens": 0}], "input_tokens": 3},
        {"five_hour": {"utilization": 30}, "seven_day": {"utilization": 5.5, "resets_at": "r7"}, "extra_usage": {"on": True}},
        {"five_hour": {"resets_at": "x"}},
        [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(9, "no json")], "body_id BIGINT, body STRING")
    rows = {r.body_id: r for r in bodies.account_usage(df, F.lit(WED)).collect()}
    assert (rows[0].format, rows[0].input, rows[0].output, rows[0].total, rows[0].daily_total) == ("buckets", 5, 2, 7, 5)
    assert (rows[0].period_start, rows[0].period_end) == ("a", "z")
    assert (rows[1].format, rows[1].total) == ("flat", 3)
    assert (rows[2].format, rows[2].period_end, rows[2].five_hour_utilization, rows[2].total) == ("utilization", "r7", 30.0, 0)
    assert rows[2].extra_usage is not None
    assert [rows[i].format for i in (3, 4, 9)] == [None, None, None]


def test_report_holds_the_summary_and_every_project_of_the_day(spark):
    rows = [(at(6), "a--x", "", 10, None, None, 1), (at(6), "b", "/w/app/", 20, None, None, 2), (at(5), "c", "", 5, None, None, 1)]
    report = usage.usage_report(turns(spark, *rows), WED).collect()
    assert [(r.as_of, r.today_total, r.project, r.project_label, r.project_total) for r in report] == [
        (WED, 33, None, None, None), (None, None, "b", "app", 22), (None, None, "a--x", "x", 11),
    ]
