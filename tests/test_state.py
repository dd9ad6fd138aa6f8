"""Ledger, job-table and audit cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslens.operators import audit as au
from opslens.operators import hygiene, jobs, ledger
from opslens.sources import audit_sink
from opslens.sources.folders import write_folders
from opslens.sources.inventory import FolderReader, file_inventory
from opslens.streaming.tables import BatchTable

LOG = "key STRING, processed_at TIMESTAMP_NTZ, seq BIGINT, status STRING, metadata STRING"


def t(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


@pytest.fixture
def log(spark):
    return spark.createDataFrame(
        [
            ("a", t(1), 1, "error", '{"e":1}'), ("a", t(2), 2, "pending", "{}"), ("a", t(2), 3, "ok", '{"id":7}'),
            ("b", t(1), 4, "ok", "{}"), ("b", t(3), 5, "error", "oops"), ("c", t(1), 6, "pending", None),
        ],
        LOG,
    )


def test_retry_workflow(log):
    rows = {r.key: (r.attempts, r.failures, r.status, r.metadata) for r in ledger.retry_outcome(log).collect()}
    assert rows == {"a": (3, 1, "ok", '{"id":7}'), "b": (2, 1, "error", "oops"), "c": (1, 0, "pending", None)}


def test_unprocessed(spark, log):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key STRING")
    assert sorted(r.key for r in ledger.unprocessed(items, log).collect()) == ["b", "c", "d"]


def test_counts_and_metadata(log):
    assert {r.status: r["keys"] for r in ledger.status_counts(log).collect()} == {"ok": 1, "error": 1, "pending": 1, "total": 3}
    values = {r.key: r.v for r in ledger.ledger_latest(log).select("key", ledger.metadata_value("$.id", "int").alias("v")).collect()}
    assert values == {"a": 7, "b": None, "c": None}


def test_status_domain(spark, log):
    with pytest.raises(ValueError):
        ledger.by_status(log, "done")
    bad = spark.createDataFrame([("x", "done"), ("y", None), ("z", "ok")], "key STRING, status STRING")
    assert [r.valid for r in ledger.check_status(bad).orderBy("key").collect()] == [False, False, True]
    with pytest.raises(Exception, match="invalid status"):
        ledger.check_status(bad, strict=True).collect()


def test_reset(spark, log):
    keys = spark.createDataFrame([("b",), ("nope",), ("b",)], "key STRING")
    rows = ledger.reset_keys(log, keys).collect()
    assert [(r.key, r.status, r.metadata) for r in rows] == [("b", "pending", '{"action":"reset","prev_status":"error"}')]


def test_cancel(spark):
    snap = spark.createDataFrame([("a", "processing"), ("b", "completed"), ("c", "cancelled")], "job_id STRING, phase STRING")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "job_id STRING")
    got = {r.job_id: (r.accepted, r.reason, r.new_phase) for r in jobs.apply_cancel(snap, asked).collect()}
    assert got == {
        "a": (True, "processing", "cancelled"), "b": (False, "already_completed", "completed"),
        "c": (False, "already_cancelled", "cancelled"), "z": (False, "not_found", None),
    }


def test_migration_is_idempotent(spark):
    old = spark.createDataFrame([("j", "failed", "assess", None)], "id STRING, status STRING, type STRING, request_id STRING")
    new = jobs.migrate_legacy_jobs(old)
    assert [tuple(r) for r in new.select("id", "phase", "metadata").collect()] == [("j", "failed", '{"type":"assess","request_id":null}')]
    assert jobs.migrate_legacy_jobs(new) is new
    plain = spark.createDataFrame([("j", "ok")], "id STRING, status STRING")
    assert jobs.migrate_legacy_jobs(plain).collect()[0].metadata == "{}"


def test_merge_metadata_ignores_unknown_jobs(spark):
    rows = [("a", t(1), 1, {"x": "1", "y": "1"}), ("a", t(2), 2, {"x": "2"}), ("q", t(1), 3, {"x": "9"})]
    updates = spark.createDataFrame(rows, "job_id STRING, ts TIMESTAMP_NTZ, seq BIGINT, metadata MAP<STRING, STRING>")
    known = spark.createDataFrame([("a",)], "job_id STRING")
    got = {(r.job_id, r.key): r.value for r in jobs.merge_metadata(updates, known).collect()}
    assert got == {("a", "x"): "2", ("a", "y"): "1"}


def test_overlap_profile(spark):
    spans = spark.createDataFrame([(t(0), t(10)), (t(5), t(10)), (t(10), t(59))], "start_ts TIMESTAMP_NTZ, end_ts TIMESTAMP_NTZ")
    rows = [(r.ts.minute, r.in_flight, r.over_cap) for r in jobs.overlap_profile(spans, cap=1).orderBy("ts").collect()]
    assert rows == [(0, 1, False), (5, 2, True), (10, 1, False), (59, 0, False)]


def test_histogram(spark):
    snap = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 50.0)], "job_type STRING, elapsed_seconds DOUBLE")
    assert {r.le: r.jobs for r in jobs.duration_histogram(snap, (1.0, 10.0)).collect()} == {"1": 1, "10": 2, "+Inf": 3}


def test_drop_keys(spark):
    table = spark.createDataFrame([("a",), ("b",)], "id STRING")
    keys = spark.createDataFrame([("b",), ("c",)], "id STRING")
    assert [r.id for r in jobs.drop_keys(table, keys, "id").collect()] == ["a"]
    assert {r.id: r.deleted for r in jobs.drop_hits(table, keys, "id").collect()} == {"b": True, "c": False}


def test_audit_sink(spark, tmp_path):
    rows = spark.createDataFrame([("parser", "parsed", True, "y" * 900)], "stage STRING, action STRING, ok BOOLEAN, detail STRING")
    audit_sink.append_audit(rows, str(tmp_path / "log"))
    audit_sink.append_audit(rows, str(tmp_path / "log"))
    back = audit_sink.read_audit(spark, str(tmp_path / "log"))
    assert back.columns == ["timestamp", *audit_sink.COLUMNS]
    assert [(len(r.detail), r.event_type, r.timestamp.microsecond) for r in back.collect()] == [(500, "", 0)] * 2
    with pytest.raises(ValueError, match="unknown audit columns"):
        audit_sink.append_audit(rows.withColumn("extra", F.lit(1)), str(tmp_path / "log"))
    with pytest.raises(ValueError):
        audit_sink.audit_rows(rows, ("timestamp", "stage", "action", "ok", "detail"))


def test_logfmt_and_coverage(spark):
    df = spark.createDataFrame([("p", True, "two words", None), ("q", False, "", 5)], "stage STRING, ok BOOLEAN, detail STRING, n INT")
    lines = [r.l for r in df.select(au.render_logfmt(df.columns, dict(df.dtypes)).alias("l")).collect()]
    assert lines == ['stage=p ok=true detail="two words"', "stage=q ok=false n=5"]
    rows = spark.createDataFrame([("k", "parser"), ("k", "brain"), ("k", "orchestrator"), ("m", "parser")], "project_ref STRING, stage STRING")
    assert {r.project_ref: r.complete for r in au.audit_coverage(rows).collect()} == {"k": True, "m": False}


def test_screen_urls(spark):
    urls = {
        "ftp://a/": "scheme not allowed", "http:///x": "no host", "https://gone/": "host not resolved", "https://ok/": "ok",
        "http://intern/": "blocked network", "http://u:p@127.0.0.1:8080/": "blocked network", "http://172.15.255.255": "ok",
        "http://172.31.0.1?x": "blocked network", "http://100.127.1.1": "blocked network", "http://100.128.1.1": "ok",
        "http://[::1]:80/": "blocked network", "http://[fd00::2]/": "blocked network", "http://[2001:db8::1]/": "ok",
        "HTTPS://OK/": "ok", "nonsense": "scheme not allowed", "http://0.1.2.3": "blocked network",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    hosts = spark.createDataFrame([("ok", "93.184.0.1"), ("intern", "192.168.7.7")], "host STRING, address STRING")
    assert {r.url: r.outcome for r in hygiene.screen_urls(df, hosts).collect()} == urls


def test_file_inventory(spark, tmp_path):
    for name in ("b", "a", "odd name"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "sub" / "f").write_bytes(b"12345")
    (tmp_path / "a" / "session_ok").write_bytes(b"")
    (tmp_path / "a" / "sub" / "session_ok").write_bytes(b"1")
    (tmp_path / "b" / "sub" / "session_ok").write_bytes(b"1")
    (tmp_path / "loose").write_bytes(b"x")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "session_ok").write_bytes(b"")
    rows = file_inventory(spark, str(tmp_path)).collect()
    assert [(r.name, r.size_bytes, r.marker_present) for r in rows] == [("a", 6, True), ("b", 6, False), ("c", 0, True)]


def test_a_task_lists_many_folders(tmp_path):
    for n in range(300):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "f").write_bytes(b"1" * n)
    reader = FolderReader(str(tmp_path), r"^d\d+$")
    parts = reader.partitions()
    assert len(parts) == 2
    assert {(name, size) for p in parts for name, path, size in reader.read(p) if path} == {(f"d{n}", n) for n in range(300)}


def test_written_folders_hold_their_lines_in_order(spark, tmp_path):
    rows = [("b c/ü", 2, "two"), ("b c/ü", 1, "one"), (None, 1, None), ("", 2, "x")]
    write_folders(spark.createDataFrame(rows, "k STRING, n INT, value STRING"), f"{tmp_path}/out", "f.txt", "k", "n")
    got = {f"{p.parent.name}/{p.name}": p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {"k=b%20c%2F%C3%BC/f.txt": "one\ntwo\n", "k=__HIVE_DEFAULT_PARTITION__/f.txt": "\nx\n"}


def test_batch_table_survives_a_replay(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "key STRING").start()
    rows = spark.createDataFrame([("a",)], "key STRING")
    table.write(rows, 0)
    table.write(rows, 0)
    table.write(rows, 1)
    assert table.read().count() == 2
    assert table.read(before=1).count() == 1
