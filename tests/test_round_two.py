"""Cases of whole inputs and of inputs that must not end a job or pass a screen."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opslens.functions.text import html_to_text
from opslens.operators import hygiene, ledger, proposals
from opslens.operators import messages as m
from opslens.plans.views import view
from opslens.session import scratch_root
from opslens.sources.messages import read_messages

SF = "/root/testdata/sf0.001"


def test_address_literals_fail_closed(spark):
    urls = spark.createDataFrame([("http://999.1.1.1/",), ("http://256.0.0.1",), ("http://8.8.8.8/",), ("http://10.0.0.1/",), ("http://255.255.255.255/",)], "url STRING")
    got = {r.url: r.outcome for r in hygiene.screen_urls(urls, spark.createDataFrame([], "host STRING, address STRING")).collect()}
    assert got["http://999.1.1.1/"] == got["http://256.0.0.1"] == "host not resolved"
    assert got["http://8.8.8.8/"] == "ok" and got["http://10.0.0.1/"] == "blocked network"


def test_malformed_bodies_do_not_end_the_job(spark):
    good = '{"mimeType":"text/plain","body":{"data":"aGk="},"filename":"a.txt","parts":[{"mimeType":"x","filename":"b","body":null}]}'
    rows = [(1, good), (2, "{"), (3, "[1]"), (4, "7"), (5, None), (6, '{"parts":[3]}'), (7, "[" * 100_000)]
    parts = m.mime_parts(spark.createDataFrame(rows, "id BIGINT, payload STRING"))
    got = {r.id: (r.text, r.parts_error) for r in m.mime_bodies(parts).collect()}
    assert got == {1: ("hi", None), 5: ("", None), **{i: ("", "malformed body") for i in (2, 3, 4, 6, 7)}}
    assert [r.id for r in m.attachments(parts, "id").collect()] == [1]


def test_empty_type_keeps_the_name(spark):
    df = spark.createDataFrame([("Ann Ray - 12 Main St", "")], "s STRING, t STRING")
    assert df.select(m.name_address(F.col("s"), F.lit(""), F.col("t"))["name"]).first()[0] == "Ann Ray"


def test_no_break_spaces_are_trimmed(spark):
    df = spark.createDataFrame([("<p>Bob&nbsp;</p>",)], "h STRING")
    assert df.select(html_to_text(F.col("h"))).first()[0] == "Bob"
    pair = spark.createDataFrame([("Ann Ray\u00a0- 12 Main St",)], "s STRING")
    assert pair.select(m.name_address(F.col("s"), F.lit(""), F.lit("x"))["address"]).first()[0] == "12 Main St"


def test_messages_come_whole(spark):
    inbox = view(spark, SF, "messages")
    longest = spark.read.parquet(f"{SF}/conversations.parquet").agg(F.max(F.length("text"))).first()[0]
    assert inbox.agg(F.max(F.length("body_text"))).first()[0] > longest
    assert inbox.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
    all_read = read_messages(inbox.withColumns({"unread": F.lit(True), "labelled": F.lit(False)}), "no-reply")
    assert all_read.count() == inbox.count() > 25


def test_status_questions_read_no_metadata(spark):
    log = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("processed_at"), F.lit("ok").alias("status"), F.col("event_id").alias("seq"), F.col("props").alias("metadata"))
    for df in (ledger.status_counts(log), ledger.backfill_keys(log), ledger.reset_keys(log, log.select("key")), ledger.unprocessed(log.select("key"), log)):
        assert "props" not in df._jdf.queryExecution().executedPlan().toString()


def test_proposal_errors(spark):
    order = '{"price":1}'
    rows = [(1, 1, "other", "custom.order1", "o", order), (2, 1, "init", "custom.order1", None, order), (3, 1, "init", "custom.order1", "o3", order), (4, 1, "mget", "custom.homeowner", "p", '{"stage":"x"}')]
    docs = spark.createDataFrame(rows, "project_id BIGINT, arrival INT, envelope STRING, type STRING, doc_id STRING, payload STRING")
    asked = spark.range(1, 6).withColumnRenamed("id", "project_id")
    got = {r.project_id: r.error for r in proposals.extract_proposal(docs, asked=asked).collect()}
    assert got == {1: "neither init data nor documents", 2: "neither order nor person document", 3: None, 4: None, 5: "no response"}


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            applicationId = "app"

    with pytest.raises(RuntimeError, match="share"):
        scratch_root(Session())
    Session.sparkContext.master = "local[4]"
    assert scratch_root(Session()).endswith("/app")
