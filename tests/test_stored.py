"""Stored tables: in-place upserts, the compacted ledger, the inbox as a stream; and networks from a table."""

from __future__ import annotations

import datetime as dt
import ipaddress
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from opslens.operators import hygiene
from opslens.operators.identity import MilestoneTable, upsert_milestone
from opslens.operators.ledger import ledger_latest
from opslens.sources import ledger_log
from opslens.sources.inbox import deliver, stream_messages
from opslens.sources.ledger_log import SCHEMA, LedgerLog
from opslens.streaming.tables import BatchTable, drain_to, run_to_end


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = f"{tmp_path}/milestones"
    blocks = spark.createDataFrame([(7, "Asia", False), (8, "Dup", False), (9, "dup", False)], "id LONG, name STRING, archived BOOLEAN")
    stages = {"Done": ("asia", 11), "Two": ("dup", 12)}
    target = spark.createDataFrame([(p, 7, 1) for p in range(80)], "project_id LONG, block_id LONG, status_id INT")
    t = dt.datetime(2024, 1, 1)
    rows = [(3, "Done", t, 1), (11, "Done", t, 2), (5000, "Done", t, 3), (3, "Two", t, 4), (None, "Done", t, 5), (4, "What", t, 6)]
    updates = spark.createDataFrame(rows, "project_id LONG, event_type STRING, ts TIMESTAMP, seq LONG")
    table = MilestoneTable(spark, path, buckets=8, span=10, files=2)
    table.write(target)
    before = files_of(path)
    merged, failed = table.upsert(updates, stages, blocks)
    after = files_of(path)
    touched = {f"bucket={b}" for b in (0, 1, 4)}
    assert {f for f in before if f.split("/")[-2] not in touched} == {f for f in after if f.split("/")[-2] not in touched}
    assert all(after[f] == before[f] for f in before if f in after) and not any(f in after for f in before if f.split("/")[-2] in touched)
    want = upsert_milestone(target, updates.where("project_id IS NOT NULL"), stages, blocks)[0].drop("change")
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    assert {(r.project_id, r.reason) for r in failed.collect()} == {(3, "block is not unique"), (None, "no project"), (4, "no mapping")}
    # the same upsert again, as after a job that died on the way
    table.upsert(updates, stages, blocks)
    table.write(merged)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    last = files_of(path)
    table.upsert(updates.limit(0), stages, blocks)
    assert files_of(path) == last


def versions(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, 1, h), s, n, "{}") for k, h, s, n in rows], SCHEMA)


def test_compaction_keeps_the_last_versions_and_may_be_killed(spark, tmp_path, monkeypatch):
    log = LedgerLog(spark, f"{tmp_path}/ledger", buckets=4)
    assert log.latest().count() == 0 and log.compact() is None
    every = [[("a", 1, "error", 1), ("b", 1, "ok", 2), (None, 1, "ok", 3)], [("a", 2, "ok", 4), ("c", 1, "pending", 5)], [("b", 0, "error", 6), ("d", 3, "ok", 7)]]
    for rows in every[:2]:
        log.append(versions(spark, rows))
    plain = sorted(map(str, log.latest().collect()))

    def breaks(rows, columns):
        late = F.when(F.col("key") == "c", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("status"))
        return ledger_latest(rows, columns).withColumn("status", late)

    with monkeypatch.context() as m:
        m.setattr(ledger_log, "ledger_latest", breaks)
        with pytest.raises(Exception, match="killed"):
            log.compact()
    assert log._numbers("base") == [] and sorted(map(str, log.latest().collect())) == plain
    assert log.compact() == 2 and log.compact() == 2
    assert sorted(map(str, log.latest().collect())) == plain
    log.vacuum()
    assert log._numbers("delta", "") == [] and sorted(map(str, log.latest().collect())) == plain
    # an append that was killed leaves a folder without a mark
    os.makedirs(f"{tmp_path}/ledger/delta=3")
    assert log.append(versions(spark, every[2])) == 4
    want = sorted(map(str, ledger_latest(versions(spark, sum(every, []))).collect()))
    assert sorted(map(str, log.latest().collect())) == want
    assert log.compact() == 4 and sorted(map(str, log.latest().collect())) == want
    log.vacuum()
    assert (log._numbers("base", ""), log._numbers("delta", "")) == ([4], [])
    asked = log.read(["b", "zz"])
    assert [(r.key, r.status) for r in asked.collect()] == [("b", "ok")]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", asked._jdf.queryExecution().executedPlan().toString())


def test_inbox_gives_fetches_in_order_and_goes_on_after_a_restart(spark, tmp_path):
    root, schema = f"{tmp_path}/inbox", "message_id LONG, sent_s LONG, sender STRING"
    ids = list(range(60))
    random.Random(1).shuffle(ids)

    def mails(numbers):
        return spark.createDataFrame([(i, i // 2, f"s{i}") for i in numbers], schema).repartition(3)

    deliver(mails(ids), root, 0)
    os.makedirs(f"{root}/delivery=1")  # a delivery that was killed
    table = BatchTable(spark, f"{tmp_path}/fetched", schema).start()
    one = stream_messages(spark, root, schema, fetch=25).writeStream.foreachBatch(table.write)
    run_to_end(one, f"{tmp_path}/cp")
    assert [r.message_id for r in table.read().orderBy("message_id").collect()] == list(range(25))
    drain_to(stream_messages(spark, root, schema, fetch=25), table, f"{tmp_path}/cp")
    deliver(mails(range(100, 130)), root, 2)
    drain_to(stream_messages(spark, root, schema, fetch=25), table, f"{tmp_path}/cp")
    got = table.read().collect()
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r.message_id)
    assert [sorted(v) for _, v in sorted(batches.items())] == [list(range(25)), list(range(25, 50)), list(range(50, 60)), list(range(100, 125)), list(range(125, 130))]
    assert all(r.sender == f"s{r.message_id}" and r.sent_s == r.message_id // 2 for r in got)
    with pytest.raises(ValueError):
        stream_messages(spark, root, schema, fetch=0)


def test_a_trigger_takes_many_fetches_and_numbers_them(spark, tmp_path):
    root, schema = f"{tmp_path}/inbox", "message_id LONG, sent_s LONG, sender STRING, fetch LONG"

    def mails(numbers):
        return spark.createDataFrame([(i, i // 2, f"s{i}") for i in numbers], "message_id LONG, sent_s LONG, sender STRING").repartition(3)

    def drain():
        drain_to(stream_messages(spark, root, schema, fetch=25, fetches=4, number="fetch"), table, f"{tmp_path}/cp")

    table = BatchTable(spark, f"{tmp_path}/fetched", schema).start()
    deliver(mails(range(260)), root, 0)
    drain()
    deliver(mails(range(300, 330)), root, 1)
    drain()
    got = table.read().collect()
    # ten full fetches and a short one, then a full one and a short one
    assert sorted((r.fetch, r.message_id) for r in got) == [(i // 25, i) for i in range(260)] + [(11 + (i - 300) // 25, i) for i in range(300, 330)]
    assert {r.batch_id: {r2.fetch for r2 in got if r2.batch_id == r.batch_id} for r in got} == {0: {0, 1, 2, 3}, 1: {4, 5, 6, 7}, 2: {8, 9, 10}, 3: {11, 12}}
    with pytest.raises(ValueError):
        stream_messages(spark, root, schema, fetches=0)


def test_empty_inbox(spark, tmp_path):
    schema = "message_id LONG, sent_s LONG, sender STRING"
    deliver(spark.createDataFrame([], schema), f"{tmp_path}/inbox", 0)
    table = BatchTable(spark, f"{tmp_path}/fetched", schema).start()
    drain_to(stream_messages(spark, f"{tmp_path}/inbox", schema), table, f"{tmp_path}/cp")
    assert table.read().count() == 0


def test_longest_network_decides(spark):
    rng = random.Random(5)
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3", "fc00::/7", "2001:db8::/32", "2001:db8::5/128"]
    nets += [str(ipaddress.ip_network((rng.getrandbits(32), rng.randint(6, 32)), strict=False)) for _ in range(300)]
    blocks = [(n, rng.random() < 0.5) for n in nets] + [("10.1.2.0/24", True), ("172.16.0.0/12", None)]
    addresses = ["10.1.2.3", "10.1.2.4", "10.1.9.9", "10.9.9.9", "172.16.5.5", "fd00::1", "2001:db8::5", "2001:DB8:0::6", "::1", "300.1.1.1", "x", "", None]
    addresses += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)]
    addresses = addresses * 2
    rows = spark.createDataFrame([(i, a, f"u{i}") for i, a in enumerate(addresses)], "id INT, address STRING, url STRING")
    table = spark.createDataFrame(blocks, "network STRING, blocked BOOLEAN")
    got = {r.id: (r.block, r.block_stops) for r in hygiene.longest_block(rows, table).collect()}
    assert len(got) == len(addresses)
    stops = {}
    for n, b in blocks:
        key = ipaddress.ip_network(n)
        name, old = stops.get(key, (n, False))
        stops[key] = (min(name, n), old or b is not False)
    for i, a in enumerate(addresses):
        try:
            ip = ipaddress.ip_address(a)
            held = [k for k in stops if k.version == ip.version and ip in k]
        except ValueError:
            held = []
        want = stops[max(held, key=lambda k: k.prefixlen)] if held else (None, None)
        assert got[i] == want, a
    none = hygiene.longest_block(rows, table.limit(0)).where("block IS NOT NULL")
    assert none.count() == 0
    for bad in ("10.0.0.0/33", "10.0.0/8", "10.0.0.0/x", None):
        with pytest.raises(Exception, match="no network"):
            hygiene.longest_block(rows, spark.createDataFrame([(bad, True)], "network STRING, blocked BOOLEAN"))


def test_screening_by_table_fails_closed(spark):
    urls = spark.createDataFrame([(1, "http://10.1.2.3/x"), (2, "http://10.1.2.4/"), (3, "ftp://8.8.8.8/"), (4, "http://300.1.1.1/"), (5, "http://[zz::1]/"), (6, "http://h/"), (7, None), (8, "http://8.8.8.8/")], "id INT, url STRING")
    hosts = spark.createDataFrame([("h", "10.1.2.9")], "host STRING, address STRING")
    blocks = spark.createDataFrame([("10.0.0.0/8", True), ("10.1.2.4/32", False)], "network STRING, blocked BOOLEAN")
    got = {r.id: (r.block, r.outcome) for r in hygiene.screen_urls(urls, hosts, blocks).collect()}
    assert got[1] == ("10.0.0.0/8", "blocked network") and got[2] == ("10.1.2.4/32", "ok") and got[6] == ("10.0.0.0/8", "blocked network")
    assert got[3][1] == "scheme not allowed" and got[4][1] == got[5][1] == "host not resolved" and got[8] == (None, "ok")
    assert got[7][1] != "ok"
