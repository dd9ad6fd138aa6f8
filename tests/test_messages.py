"""Message extraction, identity, decisions and plans on invented samples."""

from __future__ import annotations

import base64
import datetime as dt
import html
import json

import pytest
from pyspark.sql import functions as F

from opslens.functions.text import base64url_text, html_to_text, mail_time
from opslens.operators import decisions as d
from opslens.operators import identity as i
from opslens.operators import messages as m
from opslens.operators import proposals as x

MAIL = "message_id BIGINT, sent_s BIGINT, sender STRING, subject STRING, body_text STRING, body_html STRING"
SAMPLES = {
    1: ("RFX | New Comment <n@e.test>", "New Project Comment - Ann  Lee - 12 Oak Road.", 'Hi\n"call me\n@Bob_1 and @Cy2 please"', None),
    2: ("RFX | Estimate Comp. <n@e.test>", "Estimate Complete - Bo O'Neil-Day - 7 Elm St (Reorder)", "", '<a href="http://url9.example.test/ls/click?upn=a-b&x=1">go</a>'),
    3: ("n@e.test", "New Project Task - Cy Dee - 3 Fir Ln", None, None),
    4: ("rfx|  Install Date. <n@e.test>", "Install Date - see below", "Dee Eff - 44 Pine Ave, Town\nmore", None),
    5: ("n@e.test", "", "", None),
    6: ("RFX | New Comment <n@e.test>", "New Project Comment - Ann Lee - 12 Oak Road", "no quote", None),
    7: ("n@e.test", "Weekly digest", "see https://www.example.test/project/17x9 now", None),
    8: ("RFX | HIC Executed <n@e.test>", "HIC Executed - Ann &amp; Co - 5 Bay &quot;x&quot; Rd", "", None),
    9: ("RFX | Tea Time <n@e.test>", "Tea Time - Gil Hay - 9 Low Rd", "", None),
}


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, k * 10, *v) for k, v in SAMPLES.items()]
    return m.parse_messages(spark.createDataFrame(rows, MAIL)).cache()


def test_parse(events):
    got = {r.message_id: r for r in events.collect()}
    assert [got[k].event_type for k in SAMPLES] == [
        "New Comment", "Estimate Complete", "New Task", "Install Date", "Unknown", "New Comment", "Weekly digest", "HIC Executed", "Tea Time",
    ]
    assert (got[1].customer_name, got[1].address) == ("Ann Lee", "12 Oak Road")
    assert got[1].comment_text == "call me\n@Bob_1 and @Cy2 please" and got[1].mentioned_users == ["Bob_1", "Cy2"]
    assert (got[2].customer_name, got[2].address, got[2].address_suffix) == ("Bo O'Neil-Day", "7 Elm St", "Reorder")
    assert got[2].tracking_url == "http://url9.example.test/ls/click?upn=a-b&x=1"
    assert (got[3].customer_name, got[3].address) == ("Cy Dee", "3 Fir Ln")
    assert (got[4].customer_name, got[4].address) == ("Dee Eff", "44 Pine Ave, Town")
    assert (got[5].customer_name, got[5].address) == (None, None)
    assert got[7].tracking_url == "https://www.example.test/project/17x9"
    assert [got[k].parse_complete for k in SAMPLES] == [True, False, True, True, False, False, False, True, True]
    assert (got[8].customer_name, got[8].address, got[8].raw_subject) == ("Co", "5 Bay", 'HIC Executed - Ann & Co - 5 Bay "x" Rd')
    assert got[5].notes == ["no identity in the message"]
    assert got[6].notes == ["comment without quoted text", "identified by name only"]


def test_html_to_text(spark):
    pages = [
        "<style>p{}</style><p>a&nbsp;b&lt;c</p><br/>x\t\t y<div>1</div>\n\n\n<li>2</li><script>if(a<b){}</script>z",
        "", None, "plain &amp;amp; &#8364; &hearts; &notanentity;",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "h STRING")
    got = [r.t for r in df.select(html_to_text(F.col("h")).alias("t")).collect()]
    assert got == ["a\xa0b<c\n\nx y1\n\n2\nz", "", "", html.unescape(pages[3])]


def test_base64url(spark):
    raw = "grüße ✓?>".encode()
    rows = [(base64.urlsafe_b64encode(raw).decode(),), (base64.urlsafe_b64encode(b"ok\xff!").decode(),), ("",)]
    got = [r.t for r in spark.createDataFrame(rows, "d STRING").select(base64url_text(F.col("d")).alias("t")).collect()]
    assert got == ["grüße ✓?>", "ok�!", ""]


def test_mime_tree_of_any_depth(spark):
    leaf = {"mimeType": "text/plain", "filename": "deep.txt", "body": {"data": base64.urlsafe_b64encode(b"deep").decode()}}
    tree = leaf
    for _ in range(12):
        tree = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {}}, tree, {"filename": "", "parts": None}]}
    mails = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(leaf)), (3, None)], "message_id BIGINT, payload STRING")
    parts = m.mime_parts(mails).cache()
    assert {r.message_id: (r.text, r.html) for r in m.mime_bodies(parts).collect()} == {1: ("deep", None), 2: ("deep", None), 3: ("", None)}
    assert [(r.message_id, r.filename) for r in m.attachments(parts, "message_id").collect()] == [(1, "deep.txt")]


def test_mail_time(spark):
    texts = ["Tue, 5 Mar 2024 10:00:00 +0200", "05 Mar 2024 10:00:00 GMT", "Tue, 5 Mar 2024 10:00 -0500 (EST)", "yesterday", None]
    now = dt.datetime(2024, 4, 1)
    df = spark.createDataFrame([(t,) for t in texts], "h STRING")
    got = [r.t for r in df.select(mail_time(F.col("h"), F.lit(now).cast("timestamp_ntz")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 3, 5, 8), dt.datetime(2024, 3, 5, 10), dt.datetime(2024, 3, 5, 15), now, now]


def test_digest(spark):
    mails = spark.createDataFrame([(1, 5, "s", "", None, None)], MAIL)
    text = m.forward_digest(mails, F.struct(F.lit(1).alias("a")), F.lit("why"), F.lit(""), "banner").collect()[0].digest
    assert text.startswith("banner\n\nEvent type: (unknown)\nReason: why\n") and "Subject: (no subject)" in text and '"a" : 1' in text


PROJECT = "id BIGINT, project_name STRING, street1 STRING, ext_id STRING, archived BOOLEAN, status_id INT"


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame(
        [
            (1, "ANN LEE", "12 oak road", "x1", False, 4), (2, "Cy Dee", "3 Fir Ln", "x2", False, 4), (3, "Cy Dee", "3 fir ln", "x2", False, 4),
            (4, "Bo O'Neil-Day", "7 Elm St", None, True, 4), (5, "Bo O'Neil-Day", "7 Elm St", None, False, 59),
            (6, "Bo O'Neil-Day", "7 Elm St", None, False, None), (7, "Dee Eff", None, "x7", False, 4),
        ],
        PROJECT,
    )


def test_context(spark, events, projects):
    got = {r.message_id: (r.found, r.ambiguous, r.project_id, r.candidate_count) for r in i.resolve_context(events, projects).collect()}
    assert got[1] == (True, False, 1, 1) and got[3] == (True, True, None, 2) and got[2] == (False, False, None, 0)
    assert got[4] == (False, False, None, 0) and got[5] == (False, False, None, 0)
    by_id = events.withColumn("ext_id", F.when(F.col("message_id") == 5, "x2").when(F.col("message_id") == 1, "x7").when(F.col("message_id") == 3, "none"))
    got = {r.message_id: (r.found, r.ambiguous, r.project_id) for r in i.resolve_context(by_id, projects).collect()}
    assert got[5] == (True, True, None) and got[1] == (True, False, 7) and got[3] == (True, True, None)
    no_street = events.withColumn("address", F.lit(None).cast("string"))
    got = {r.message_id: r.project_id for r in i.resolve_context(no_street, projects).collect()}
    assert (got[4], got[3]) == (7, None)


RULES = {
    (1, True, False, 9): "comment", (1, False, False, None): "comment on unknown project", (6, True, False, 9): "comment without text",
    (5, True, False, 9): "unidentified", (4, True, True, None): "ambiguous", (4, False, False, None): "milestone of unknown project",
    (4, True, False, 9): "milestone", (2, True, False, 9): "project exists", (2, False, False, None): "create by link",
    (3, False, False, None): "prompt for a person", (9, False, False, None): "no rule",
}


@pytest.mark.parametrize("case", list(RULES))
def test_rules(events, case):
    message, found, ambiguous, project = case
    context = {
        "found": F.lit(found), "ambiguous": F.lit(ambiguous), "project_id": F.lit(project).cast("bigint"), "candidate_count": F.lit(1),
    }
    rows = events.where(F.col("message_id") == message).withColumns(context)
    row = d.decide(rows, phase=1).collect()[0]
    assert row.rule == RULES[case]
    assert row.needs_human == (row.action == "escalate")
    if message == 2:
        assert d.decide(rows, phase=0).collect()[0].action == "ignore"
        assert d.decide(rows.withColumn("tracking_url", F.lit(None).cast("string")), 1).collect()[0].rule in ("create without link", "project exists")


def test_route_order(spark):
    base = ("t", False, False, "o1", True, True, True)
    shape = "action STRING, event_type STRING, needs_human BOOLEAN, forwarded BOOLEAN, fetched_ext_id STRING, is_accepted BOOLEAN, crm_online BOOLEAN, plan_ok BOOLEAN"
    cases = {
        ("ignore", "t", True, False, None, False, False, False): ("ok", "ignored"),
        ("escalate", "t", False, False, None, False, True, False): ("error", "unsupported action"),
        ("create_project", "t", True, True, None, False, True, False): ("ok", "escalated and forwarded"),
        ("append_note", *base): (None, "note appended"),
        ("update_milestone", *base): (None, "no mapping"),
        ("update_milestone", "Install Date", *base[1:]): (None, "milestone set"),
        ("create_project", "t", False, False, None, True, True, True): (None, "nothing fetched"),
        ("create_project", "t", False, False, "o", False, True, True): ("ok", "not accepted"),
        ("create_project", "t", False, False, "o", True, True, False): ("error", "plan failed"),
        ("create_project", *base): ("ok", "project ensured"),
        ("append_note", "t", False, False, "o", True, False, True): (None, "offline"),
    }
    rows = d.route_actions(spark.createDataFrame(list(cases), shape), ("Install Date",)).collect()
    assert [(r.ledger_status, r.detail) for r in rows] == list(cases.values())


def test_model_replies(spark):
    replies = ['```json\n{"action":"ignore","reasoning":"r","target":"5"}\n```', '{"action":null}', "[1]", "", "{", '{"action":"x","needs_human":true}']
    df = spark.createDataFrame(list(enumerate(replies)), "item_id INT, reply STRING")
    rows = [(r.action, r.reasoning, r.needs_human, r.target) for r in d.parse_model_decision(df).orderBy("item_id").collect()]
    assert rows[0] == ("ignore", "r", False, "5")
    assert [r[1] for r in rows[2:5]] == ["no action", "empty reply", "not JSON"]
    assert rows[5] == ("x", "", True, None)


def test_entity_match(spark):
    entities = spark.createDataFrame(
        [
            (1, "Ann", "Lee", "A@x.test", "1 Oak", False, 8), (2, "Ann", "Lee", None, "2 Oak", False, 8),
            (3, "Bo", "Lee", None, "1 Oak", False, 8), (4, "Ann", "Lee", None, None, True, 8), (5, "Ann", "Lee", "a@x.test", None, False, 9),
        ],
        "id BIGINT, first_name STRING, last_name STRING, email STRING, street1 STRING, archived BOOLEAN, object_type_id INT",
    )
    people = [
        (1, "nobody", " a@X.test ", "9"), (2, "ann  lee", None, None), (3, "Ann Lee", "", "2 OAK "), (4, "Lee", None, None),
        (5, "Lee", None, "1 oak"), (6, "", None, "1 oak"), (7, None, "z@x.test", None),
    ]
    df = spark.createDataFrame(people, "pid BIGINT, name STRING, email STRING, street STRING")
    got = {r.pid: (r.entity_matches, r.entity_id) for r in i.match_entity(df, entities, "pid").collect()}
    assert got == {1: (1, 1), 2: (2, None), 3: (1, 2), 4: (3, None), 5: (2, None), 6: (0, None), 7: (0, None)}


def test_plan_creates_once(spark, projects):
    entities = spark.createDataFrame([(50, "Ann", "Lee", "a@x.test", None, False, 8)], "id BIGINT, first_name STRING, last_name STRING, email STRING, street1 STRING, archived BOOLEAN, object_type_id INT")
    proposals = spark.createDataFrame(
        [
            (1, "n1", "Zed Y", "z@x.test", None, None), (2, "n1", "Zed Y", "Z@x.test", None, "later"), (3, "x1", "Ann Lee", "a@x.test", None, None),
            (4, "x7", "Ann Lee", "a@x.test", None, None), (5, "x2", "Ann Lee", "a@x.test", None, None), (6, None, "Ann Lee", "a@x.test", None, None),
            (7, "n2", None, None, None, None),
        ],
        "proposal_id BIGINT, ext_id STRING, name STRING, email STRING, street STRING, display_text STRING",
    )
    links = spark.createDataFrame([(50, 1, False), (50, 7, True)], "entity_id BIGINT, project_id BIGINT, archived BOOLEAN")
    rows = i.plan_entities_projects(proposals, entities, projects, links).orderBy("proposal_id").collect()
    got = [(r.status, r.created_entity, r.created_project, r.created_link, r.project_name) for r in rows]
    assert got == [
        ("ok", True, True, True, "Zed Y"), ("ok", False, False, False, None), ("ok", False, False, False, None), ("ok", False, False, True, None),
        ("review project", False, False, False, None), ("no external id", False, False, False, None), ("no name or email", False, False, False, None),
    ]
    assert rows[2].project_id == 1 and rows[3].entity_id == 50
    assert {r.outcome for r in i.dry_run(proposals, None).collect()} == {"refused"}


def test_note(spark, events):
    rows = events.where("message_id = 1").withColumn("project_id", F.lit(3))
    note = i.append_note(rows, 7, "[S] ").collect()[0]
    assert note.content_text.endswith("\n(Mentions: Bob_1, Cy2)") and note.content_text.startswith("[S] call me")
    assert json.loads(note.content_delta) == {"ops": [{"insert": note.content_text + "\n"}]}


DOC = "project_id BIGINT, arrival INT, envelope STRING, type STRING, doc_id STRING, payload STRING"


def docs(spark, *rows):
    return spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], DOC)


@pytest.mark.parametrize(
    "doc, accepted",
    [
        (("mget", x.CONTRACT, "h", '{"status_option_contingency":"executed"}'), True),
        (("mget", x.CONTRACT, "h", '{"status_option_contingency":"sent","signature_url_text":"u"}'), False),
        (("mget", x.JOB, "j", '{"status_option_job_status":"new"}'), True),
        (("mget", x.JOB, "j", "{}"), False),
        (("mget", x.PERSON, "p", '{"stage_option_type__contact_":"customer"}'), True),
        (("mget", x.WARRANTY, "w", "{}"), False),
    ],
)
def test_single_signals(spark, doc, accepted):
    row = x.extract_proposal(docs(spark, ("init", x.ORDER, "o", "{}"), doc)).collect()[0]
    assert (row.ok, row.is_accepted) == (True, accepted)


def test_proposal_fields(spark):
    order = {
        "price__final__number": "12.5", "staging_price_number": "n/a", "markup__final__number": 0, "rfx_markup_number": 9, "display_text": "D",
        "sales_rep_user": "1__LOOKUP__r9", "estimator_user": "plain", "office_custom_office": "1__LOOKUP__",
    }
    job = {"contract_price_number": 77, "install_date_date": 1700000000000, "status_option_job_status": ""}
    person = {"full_name_text": "Ann Lee", "first_name_text": "Ann", "state_text": "Ohio"}
    row = x.extract_proposal(
        docs(
            spark, ("init", x.ORDER, "o1", json.dumps(order)), ("init", x.ORDER, "o2", "{}"), ("mget", x.ORDER, "o0", "{}"),
            ("mget", x.PERSON, "p1", json.dumps(person)), ("mget", x.PERSON, "p2", "{}"), ("mget", x.JOB, "j1", json.dumps(job)),
        )
    )
    r = row.collect()[0]
    assert (r.ext_id, r.estimated_price, r.staging_price, r.markup, r.display_text) == ("o1", 12.5, None, 9.0, "D")
    assert (r.sales_rep_ref, r.estimator_ref, r.office_ref, r.person_ref) == ("r9", "plain", None, "p1")
    assert (r.actual_contract_price, r.install_date_ms, r.is_accepted, r.full_name) == (77.0, 1700000000000, False, "Ann Lee")
    p = x.payload_projection(row).collect()[0]
    assert (p.customer_name, p.state_text, p.contract_price, p.hic_status, p.person_ref) == ("Ann Lee", "Ohio", 77.0, None, "p1")
    assert set(x.FORWARDED) <= set(p.asDict())


def test_proposal_without_anchor(spark):
    row = x.extract_proposal(docs(spark, ("mget", x.JOB, "j", '{"status_option_job_status":"new"}'), ("mget", x.PERSON, "p", "{ }"))).collect()[0]
    assert (row.ok, row.is_accepted, row.error) == (False, False, "neither order nor person document")
