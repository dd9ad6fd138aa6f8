"""Registered ledger and job-table queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opslens.operators import jobs, ledger
from opslens.plans.registry import query
from opslens.plans.views import table, view
from opslens.session import scratch_path
from opslens.sources.ledger_log import LedgerLog

L = ("ledger",)
LATEST = "latest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY key ORDER BY processed_at DESC, seq DESC) = 1)"


def log(spark, sf_dir):
    return view(spark, sf_dir, "ledger")


def asked_keys(spark, sf_dir, prefix, modulus, name):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit(prefix), (F.col("o_orderkey") % modulus).cast("string")).alias(name)).distinct()


@query("l01_ledger_latest", L, LATEST + " SELECT key, processed_at, seq, status, metadata FROM latest")
def l01(spark, sf_dir):
    return ledger.ledger_latest(log(spark, sf_dir))


@query("l01_ledger_compacted", L, LATEST + " SELECT key, processed_at, seq, status, metadata FROM latest")
def l01_compacted(spark, sf_dir):
    """Three deltas; two are compacted and deleted, the third comes after."""
    rows = log(spark, sf_dir)
    kept = LedgerLog(spark, scratch_path(spark, "ledger"))
    for part in range(2):
        kept.append(rows.where(F.col("seq") % 3 == part))
    kept.compact()
    kept.vacuum()
    kept.append(rows.where(F.col("seq") % 3 == 2))
    return kept.latest()


@query("l02_unprocessed", L, LATEST + """, items AS (SELECT 'msg-' || CAST(o_orderkey AS VARCHAR) AS key, o_totalprice FROM orders)
 SELECT key, o_totalprice FROM items WHERE key NOT IN (SELECT key FROM latest WHERE status = 'ok')""")
def l02(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("msg-"), F.col("o_orderkey").cast("string")).alias("key"), "o_totalprice")
    return ledger.unprocessed(items, log(spark, sf_dir))


@query("l03_by_status", L, LATEST + " SELECT key, processed_at, metadata FROM latest WHERE status = 'error' ORDER BY processed_at, key")
def l03(spark, sf_dir):
    return ledger.by_status(log(spark, sf_dir), "error").select("key", "processed_at", "metadata")


@query("l04_status_counts", L, LATEST + " SELECT coalesce(status, 'total') AS status, count(*) AS keys FROM latest GROUP BY ROLLUP (status)")
def l04(spark, sf_dir):
    return ledger.status_counts(log(spark, sf_dir))


@query("l05_check_status", (), """SELECT event_id, event_type AS status, event_type IN ('pending', 'ok', 'error') AS valid FROM events""")
def l05(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"))
    return ledger.check_status(rows)


@query("l06_metadata_query", L, LATEST + """ SELECT key, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k, json_extract(metadata, '$.k') IS NOT NULL AS has_k,
 json_extract(metadata, '$.missing') IS NOT NULL AS has_missing FROM latest WHERE CAST(json_extract_string(metadata, '$.k') AS BIGINT) > 20""")
def l06(spark, sf_dir):
    k = ledger.metadata_value("$.k", "bigint")
    latest = ledger.ledger_latest(log(spark, sf_dir))
    return latest.where(k > 20).select(
        "key", k.alias("k"), ledger.metadata_has("$.k").alias("has_k"), ledger.metadata_has("$.missing").alias("has_missing")
    )


@query("l07_reset_keys", L, LATEST + """, asked AS (SELECT DISTINCT 'msg-' || CAST(o_orderkey % 5000 AS VARCHAR) AS key FROM orders)
 SELECT key, 'pending' AS status, 'reset' AS action, status AS prev_status, seq AS prev_seq FROM latest SEMI JOIN asked USING (key)""")
def l07(spark, sf_dir):
    rows = ledger.reset_keys(log(spark, sf_dir), asked_keys(spark, sf_dir, "msg-", 5000, "key"))
    return rows.select(
        "key", "status", F.get_json_object("metadata", "$.action").alias("action"),
        F.get_json_object("metadata", "$.prev_status").alias("prev_status"), "prev_seq",
    )


@query("l08_backfill_keys", ("ledger",), """blanked AS (SELECT CASE WHEN seq % 100 = 0 THEN '' ELSE key END AS key, processed_at, seq, status FROM ledger),
 latest AS (SELECT * FROM blanked QUALIFY row_number() OVER (PARTITION BY key ORDER BY processed_at DESC, seq DESC) = 1)
 SELECT status, CASE WHEN key = '' THEN 'skipped' ELSE 'labeled' END AS outcome, count(*) AS keys FROM latest WHERE status IN ('ok', 'error') GROUP BY 1, 2""")
def l08(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("key", F.when(F.col("seq") % 100 == 0, "").otherwise(F.col("key")))
    return ledger.backfill_keys(rows).groupBy("status", "outcome").agg(F.count("*").alias("keys"))


@query("l09_retry_outcome", L, """SELECT key, count(*) AS attempts, count(*) FILTER (WHERE status = 'error') AS failures,
 last(status ORDER BY processed_at, seq) AS status, last(metadata ORDER BY processed_at, seq) AS metadata FROM ledger GROUP BY key""")
def l09(spark, sf_dir):
    return ledger.retry_outcome(log(spark, sf_dir))


J = ("job_events",)
SNAP = """snap AS (SELECT job_id, min(ts) AS created_at, max(ts) AS updated_at, last(phase ORDER BY ts, seq) AS phase,
 last(job_type ORDER BY ts, seq) AS job_type, last(amount ORDER BY ts, seq) FILTER (WHERE phase = 'completed') AS result,
 last('failed ' || CAST(seq AS VARCHAR) ORDER BY ts, seq) FILTER (WHERE phase = 'failed') AS error,
 round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS elapsed_seconds FROM job_events GROUP BY job_id)"""
BOUNDS = (60.0, 3600.0, 86400.0, 604800.0, 1209600.0, 1814400.0)


def events(spark, sf_dir):
    rows = view(spark, sf_dir, "job_events")
    return rows.withColumns({
        "result": F.when(F.col("phase") == "completed", F.col("amount")),
        "error": F.when(F.col("phase") == "failed", F.concat(F.lit("failed "), F.col("seq").cast("string"))),
    })


def snapshot(spark, sf_dir):
    return jobs.job_snapshot(events(spark, sf_dir))


@query("j01_job_snapshot", J, SNAP + " SELECT * FROM snap")
def j01(spark, sf_dir):
    return snapshot(spark, sf_dir)


@query("j02_merge_metadata", J, """entries AS (SELECT job_id, ts, seq, unnest(['type', 'amount', phase]) AS key,
 unnest([job_type, CAST(amount AS VARCHAR), CAST(seq AS VARCHAR)]) AS value FROM job_events)
 SELECT job_id, key, last(value ORDER BY ts, seq) AS value FROM entries GROUP BY job_id, key""")
def j02(spark, sf_dir):
    rows = view(spark, sf_dir, "job_events")
    pairs = F.create_map(
        F.lit("type"), F.col("job_type"), F.lit("amount"), F.col("amount").cast("string"), F.col("phase"), F.col("seq").cast("string")
    )
    return jobs.merge_metadata(rows.withColumn("metadata", pairs), snapshot(spark, sf_dir))


@query("j03_recent_jobs", J, SNAP + " SELECT job_id, updated_at, phase FROM snap ORDER BY updated_at DESC, job_id LIMIT 20")
def j03(spark, sf_dir):
    return jobs.recent_jobs(snapshot(spark, sf_dir)).select("job_id", "updated_at", "phase")


@query("j04_apply_cancel", J, SNAP + """, asked AS (SELECT DISTINCT 'job-' || CAST(o_orderkey % 4000 AS VARCHAR) AS job_id FROM orders)
 SELECT job_id, phase IS NOT NULL AND phase NOT IN ('completed', 'failed', 'cancelled') AS accepted,
 CASE WHEN phase IS NULL THEN 'not_found' WHEN phase IN ('completed', 'failed', 'cancelled') THEN 'already_' || phase ELSE phase END AS reason,
 CASE WHEN phase IN ('completed', 'failed', 'cancelled') THEN phase WHEN phase IS NOT NULL THEN 'cancelled' END AS new_phase
 FROM asked LEFT JOIN snap USING (job_id)""")
def j04(spark, sf_dir):
    return jobs.apply_cancel(snapshot(spark, sf_dir), asked_keys(spark, sf_dir, "job-", 4000, "job_id"))


@query("j05_capacity", J, """then_ AS (SELECT job_id, last(phase ORDER BY ts, seq) AS phase FROM job_events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY job_id)
 SELECT count(*) FILTER (WHERE phase NOT IN ('completed', 'failed', 'cancelled')) AS active,
 5000 - count(*) FILTER (WHERE phase NOT IN ('completed', 'failed', 'cancelled')) AS free FROM then_""")
def j05(spark, sf_dir):
    return jobs.capacity(events(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 5000)


@query("j06_overlap_profile", J, SNAP + """, steps AS (SELECT ts, sum(delta) AS delta FROM (SELECT created_at AS ts, 1 AS delta FROM snap UNION ALL SELECT updated_at, -1 FROM snap) m GROUP BY ts),
 profile AS (SELECT ts, CAST(sum(delta) OVER (ORDER BY ts) AS BIGINT) AS in_flight FROM steps)
 SELECT ts, in_flight, in_flight > 8 AS over_cap FROM profile""")
def j06(spark, sf_dir):
    spans = snapshot(spark, sf_dir).select(F.col("created_at").alias("start_ts"), F.col("updated_at").alias("end_ts"))
    return jobs.overlap_profile(spans, cap=8)


@query("j07_job_counters", J, SNAP + " SELECT job_type, phase, count(*) AS jobs FROM snap GROUP BY job_type, phase")
def j07(spark, sf_dir):
    return jobs.job_counters(snapshot(spark, sf_dir))


@query("j08_duration_histogram", J, SNAP + """, bounds AS (SELECT * FROM (VALUES ('60', 60.0), ('3600', 3600.0), ('86400', 86400.0), ('604800', 604800.0), ('1.2096e+06', 1209600.0), ('1.8144e+06', 1814400.0), ('+Inf', 1e18)) b(le, top))
 SELECT job_type, le, count(*) FILTER (WHERE elapsed_seconds <= top) AS jobs FROM snap CROSS JOIN bounds GROUP BY job_type, le""")
def j08(spark, sf_dir):
    return jobs.duration_histogram(snapshot(spark, sf_dir), BOUNDS)


@query("j09_migrate_legacy_jobs", J, SNAP + " SELECT job_id AS id, phase, job_type AS type, 'r-' || job_id AS request_id FROM snap")
def j09(spark, sf_dir):
    old = snapshot(spark, sf_dir).select(
        F.col("job_id").alias("id"), F.col("phase").alias("status"), F.col("job_type").alias("type"), F.concat(F.lit("r-"), F.col("job_id")).alias("request_id")
    )
    new = jobs.migrate_legacy_jobs(old)
    return new.select("id", "phase", *[F.get_json_object("metadata", f"$.{c}").alias(c) for c in ("type", "request_id")])


@query("j10_drop_keys", J, SNAP + """, asked AS (SELECT DISTINCT 'job-' || CAST(o_orderkey % 4000 AS VARCHAR) AS job_id FROM orders)
 SELECT job_id, job_id IN (SELECT job_id FROM snap) AS deleted FROM asked""")
def j10(spark, sf_dir):
    return jobs.drop_hits(snapshot(spark, sf_dir), asked_keys(spark, sf_dir, "job-", 4000, "job_id"), "job_id")


@query("j11_expired", J, SNAP + " SELECT job_id, updated_at FROM snap WHERE updated_at < TIMESTAMP '2024-01-28 00:00:00'")
def j11(spark, sf_dir):
    return jobs.expired(snapshot(spark, sf_dir), dt.datetime(2024, 1, 30), 48).select("job_id", "updated_at")
