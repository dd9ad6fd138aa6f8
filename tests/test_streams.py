"""Streams by keyed state: expiry, late rows, retries, and a crash between batches."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from opslens.operators.captures import dedup_captures
from opslens.operators.ledger import ledger_latest
from opslens.streaming import captures as sc
from opslens.streaming import jobs as sj
from opslens.streaming import messages as sm
from opslens.streaming.keyed import OrderedCaptures
from opslens.streaming.tables import BatchTable, append_to, update_to

HOUR = 3600


def stream_of(spark, batches, schema, path):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def last_rows(table, key, *names):
    last = table.read().groupBy(*key).agg(F.max_by(F.struct(*names), "batch_id").alias("c")).select(*key, "c.*")
    return last.collect()


def test_idle_jobs_expire_and_late_rows_are_dropped(spark, tmp_path):
    batches = [
        [("a", 1 * HOUR, 1, "processing"), ("b", 10 * HOUR, 2, "pending")],
        [("c", 20 * HOUR, 3, "pending")],  # the watermark is at 9 h: a was idle for longer than 2 h and goes
        [("a", 21 * HOUR, 4, "completed"), ("z", 1 * HOUR, 5, "failed")],  # the watermark is at 19 h: z comes too late, b goes
    ]
    stream = stream_of(spark, batches, "job_id STRING, s LONG, seq LONG, phase STRING", f"{tmp_path}/in")
    events = stream.select("job_id", F.timestamp_seconds("s").alias("ts"), "seq", "phase")
    table = BatchTable(spark, f"{tmp_path}/jobs", "job_id STRING, phase STRING, events BIGINT, expired BOOLEAN").start()
    update_to(sj.stream_job_state_ttl(events, 2), table, f"{tmp_path}/cp")
    assert {r.job_id: (r.phase, r.events, r.expired) for r in last_rows(table, ["job_id"], "phase", "events", "expired")} == {
        "a": ("completed", 1, False), "b": ("pending", 1, True), "c": ("pending", 1, False),
    }
    gone = table.read().where("expired AND job_id = 'a'").collect()
    assert [(r.phase, r.events) for r in gone] == [("processing", 1)]


def answer(key, attempt):
    if key.startswith("bad"):
        return "error", "{}"
    return "defer" if key == "a" and attempt < 2 or key == "never" else "ok", '{"attempts":%d}' % attempt


def test_items_are_handled_until_ok_and_no_batch_reads_the_history(spark, tmp_path):
    batches = [[("k1",), ("bad1",), ("k1",)], [("k1",), ("bad1",)], *[[(f"new{i}",)] for i in range(4)], [("k1",), ("bad1",)]]
    stream = stream_of(spark, batches, "key STRING", f"{tmp_path}/in")
    rows = sm.stream_unprocessed(stream, answer)
    query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/ledger").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, r.status): r["count"] for r in spark.read.parquet(f"{tmp_path}/ledger").groupBy("key", "status").count().collect()}
    assert got == {("k1", "ok"): 1, ("bad1", "error"): 3, **{(f"new{i}", "ok"): 1 for i in range(4)}}
    steps = [p for p in query.recentProgress if p.numInputRows]
    # the stream itself is all that a batch reads, however long the ledger is
    assert [p.numInputRows for p in steps] == [len(b) for b in batches] and all(len(p.sources) == 1 for p in steps)
    assert all(p.stateOperators[0].numRowsUpdated <= len({k for k, in b}) for p, b in zip(steps, batches))


def test_deferred_items_come_back_by_timer_also_after_a_crash(spark, tmp_path):
    start = 1_000_000
    batches = [[("a", start), ("never", start), ("x", start)], [("b", start + 10 * HOUR)], [("x", start + 20 * HOUR)], [("c", start + 30 * HOUR)], [("d", start + 40 * HOUR)]]
    calls = f"crash-{uuid.uuid4().hex}"

    def run(handle):
        reader = spark.readStream.schema("key STRING, s LONG").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        items = reader.select("key", F.timestamp_seconds("s").alias("at"))
        append_to(sm.stream_defer_retry(items, handle, max_attempts=3, retry_hours=5, delay="0 seconds"), f"{tmp_path}/ledger", f"{tmp_path}/cp")

    def breaking(key, attempt):
        if key == "c":
            raise RuntimeError(calls)
        return answer(key, attempt)

    stream_of(spark, batches, "key STRING, s LONG", f"{tmp_path}/in")
    with pytest.raises(Exception, match=calls):
        run(breaking)
    run(answer)
    ledger = spark.read.schema(sm.LEDGER_SCHEMA).parquet(f"{tmp_path}/ledger")
    assert ledger.groupBy("key").count().where("count > 1").count() == 0
    got = {r.key: (r.status, r.metadata) for r in ledger_latest(ledger).collect()}
    assert got == {"a": ("ok", '{"attempts":2}'), "never": ("error", '{"attempts":3}'), **{k: ("ok", '{"attempts":1}') for k in "xbcd"}}


def test_captures_are_counted_and_deduplicated_in_order_of_arrival(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, s * 1000 + k, rnd.choice(["push", "poll"]), rnd.choice([None, 1, 2, 3]), rnd.random() < 0.1, f"u{k}", rnd.choice([None, f"b{k}", f"b{k}"])) for s in (1, 2) for k in range(120)]
    schema = "session_id LONG, arrival LONG, path STRING, seq LONG, is_load BOOLEAN, url STRING, body STRING"
    names = ["session_id", "gen", "arrival", "path", "seq", "url", "body"]
    want = sorted(map(str, (tuple(r) for r in dedup_captures(spark.createDataFrame(rows, schema)).select(*names).collect())))
    mixed = rnd.sample(rows, len(rows))
    far = [(9, 900_000, "push", None, False, "", None)]
    stream = stream_of(spark, [mixed[:80], mixed[80:160], mixed[160:], far, [(9, 900_001, "push", None, False, "", None)]], schema, f"{tmp_path}/in")
    append_to(sc.stream_capture_dedup(stream.withColumn("captured_at", F.timestamp_seconds("arrival")), "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*names).collect()))) == want


def test_captures_of_a_session_are_merged_from_small_pieces(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(1, k, "push", rnd.choice([None, 1, 2, 3]), rnd.random() < 0.1, f"u{k}", rnd.choice([None, f"b{k}" * 50])) for k in range(150)]
    schema = "session_id LONG, arrival LONG, path STRING, seq LONG, is_load BOOLEAN, url STRING, body STRING"
    names = ["session_id", "gen", "arrival", "path", "seq", "url", "body"]
    want = sorted(map(str, (tuple(r) for r in dedup_captures(spark.createDataFrame(rows, schema)).select(*names).collect())))
    mixed = rnd.sample(rows, len(rows))
    stream = stream_of(spark, [mixed[:100], mixed[100:], [(9, 60, "push", None, False, "", None)], [(9, 900_000, "push", None, False, "", None)]], schema, f"{tmp_path}/in")
    timed = stream.withColumn("captured_at", F.timestamp_seconds("arrival"))
    small = OrderedCaptures(run=4000, piece=900)
    append_to(sc.stream_capture_dedup(timed, "1 hour", small), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*names).collect()))) == want


@pytest.mark.parametrize("piece", [3, 1024])
def test_late_messages_take_their_place(spark, tmp_path, piece):
    rnd = random.Random(piece)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, *range(12)])) for i in range(60)]
    rows += [("c", 100 + i, i) for i in range(10)]
    mixed = rnd.sample(rows, len(rows))
    stream = stream_of(spark, [mixed[:20], mixed[20:25], mixed[25:]], "identity STRING, message_id LONG, sent_s LONG", f"{tmp_path}/in")
    table = BatchTable(spark, f"{tmp_path}/pos", "identity STRING, message_id BIGINT, sent_s BIGINT, position BIGINT").start()
    update_to(sm.stream_ordered_groups(stream, piece), table, f"{tmp_path}/cp")
    got = {(r.identity, r.message_id): r.position for r in last_rows(table, ["identity", "message_id"], "position")}
    want = {}
    for key in "abc":
        for n, (_, i) in enumerate(sorted((-1 if s is None else s, i) for k, i, s in rows if k == key), 1):
            want[key, i] = n
    assert got == want
