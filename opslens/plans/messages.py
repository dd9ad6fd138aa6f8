"""Registered message-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions.text import html_to_text, mail_time
from opslens.operators import messages as m
from opslens.plans.registry import query
from opslens.plans.views import table, view
from opslens.sources.messages import read_messages

M = ("messages",)
# The event table in SQL: type, name and address, comment, link, completeness.
PARSED = r"""typed AS (SELECT *, trim(CASE WHEN regexp_matches(sender, '(?i)^\s*RFX\s*\|\s*([^<]+?)\s*<') THEN regexp_extract(sender, '(?i)^\s*RFX\s*\|\s*([^<]+?)\s*<', 1)
 WHEN subject <> '' THEN string_split(subject, ' - ')[1] ELSE 'Unknown' END) AS t0, strpos(subject, ' - ') AS cut FROM messages),
aliased AS (SELECT *, CASE t0 WHEN 'Estimate Comp.' THEN 'Estimate Complete' WHEN 'Estimate Comp' THEN 'Estimate Complete' WHEN 'Deposit Invoi.' THEN 'Deposit Invoice Sent'
 WHEN 'Install Date .' THEN 'Install Date' WHEN 'Install Date.' THEN 'Install Date' WHEN 'New Project Mention' THEN 'New Comment' WHEN 'New Project Comment' THEN 'New Comment'
 WHEN 'Estimate in Progress' THEN 'Estimate' WHEN 'New Project Task' THEN 'New Task' ELSE t0 END AS event_type, lower(substr(subject, 1, cut - 1)) AS head FROM typed),
headless AS (SELECT *, CASE WHEN cut > 0 AND (contains(head, lower(event_type)) OR contains(lower(event_type), head)
 OR regexp_matches(head, '^(new project|new |estimate|install|hic|deposit|job|send|select|submit|sign)')) THEN substr(subject, cut + 3) ELSE subject END AS s FROM aliased),
picked AS (SELECT *, CASE WHEN regexp_matches(s, '[A-Za-z.''\- ]+?\s+-\s+\d[^\n"\[\]]+') THEN s WHEN regexp_matches(body_text, '[A-Za-z.''\- ]+?\s+-\s+\d[^\n"\[\]]+') THEN body_text END AS src FROM headless),
pairs AS (SELECT *, trim(regexp_replace(regexp_extract(src, '([A-Za-z.''\- ]+?)\s+-\s+(\d[^\n"\[\]]+)', 1), '\s{2,}', ' ', 'g')) AS customer_name,
 rtrim(trim(regexp_extract(src, '([A-Za-z.''\- ]+?)\s+-\s+(\d[^\n"\[\]]+)', 2)), '.') AS raw_addr FROM picked),
parsed AS (SELECT message_id, sent_s, event_type, subject, body_text, body_html, sender, CASE WHEN src IS NOT NULL THEN customer_name END AS customer_name,
 CASE WHEN src IS NULL THEN NULL ELSE trim(regexp_replace(raw_addr, '\(([^)]+)\)\s*$', '')) END AS address, nullif(trim(regexp_extract(raw_addr, '\(([^)]+)\)\s*$', 1)), '') AS address_suffix,
 CASE WHEN event_type = 'New Comment' THEN nullif(regexp_replace(regexp_extract(body_text, '(?s)"(.+?)"', 1), '^\s+|\s+$', '', 'g'), '') END AS comment_text,
 coalesce(nullif(regexp_extract(body_html, '(?i)https?://url\d+\.example\.test/ls/click\?[^\s"''<>]+'), ''),
 nullif(regexp_extract(body_text, '(?i)https?://url\d+\.example\.test/ls/click\?[^\s"''<>]+'), '')) AS tracking_url FROM pairs)"""

PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'),
 '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g')"""


def mails(spark, sf_dir):
    return view(spark, sf_dir, "messages")


def events(spark, sf_dir):
    return m.parse_messages(mails(spark, sf_dir))


def with_headers(df):
    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    return df.withColumn("headers", F.array(header("From", F.col("sender")), header("SUBJECT", F.col("subject")), header("Subject", F.lit("second"))))


def mime_mails(spark, sf_dir):
    """The messages as nested MIME trees with base64url data."""

    def data(col):
        return F.struct(F.translate(F.base64(col.cast("binary")), "+/", "-_").alias("data"))

    def leaf(mime, col):
        return F.struct(F.lit(mime).alias("mimeType"), data(col).alias("body"), F.lit(None).cast("string").alias("filename"))

    file_part = F.struct(
        F.lit("application/pdf").alias("mimeType"),
        F.struct(F.lit(None).cast("string").alias("data")).alias("body"),
        F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("f"), F.col("message_id").cast("string"), F.lit(".pdf"))).alias("filename"),
    )
    inner = F.struct(
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(leaf("text/plain", F.col("body_text")), leaf("text/html", F.col("body_html")), leaf("text/plain", F.lit("later part"))).alias("parts"),
    )
    tree = F.concat(
        F.lit('{"mimeType":"multipart/mixed","parts":['), F.to_json(inner), F.lit(","), F.to_json(file_part), F.lit("]}")
    )
    broken = F.when(F.col("message_id") % 37 == 1, '{"mimeType":').when(F.col("message_id") % 37 == 2, "[1]")
    return mails(spark, sf_dir).select("message_id", F.coalesce(broken, tree).alias("payload"))


@query("s03_read_messages", M, """SELECT message_id, sent_s, sender FROM messages WHERE sender LIKE '%no-reply@example.test%'
 AND message_id % 2 = 0 AND NOT message_id % 3 = 0 ORDER BY sent_s, message_id LIMIT 25""")
def s03(spark, sf_dir):
    inbox = mails(spark, sf_dir).withColumns({"unread": F.col("message_id") % 2 == 0, "labelled": F.col("message_id") % 3 == 0})
    return read_messages(inbox, "no-reply@example.test", limit=25).select("message_id", "sent_s", "sender")


@query("m01_html_to_text", (), f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({PLAIN}, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'),
 '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""")
def m01(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query("m02_mime_bodies", M, """SELECT message_id, CASE WHEN message_id % 37 IN (1, 2) THEN '' WHEN body_text = '' THEN 'later part' ELSE body_text END AS text, CASE WHEN message_id % 37 NOT IN (1, 2) THEN body_html END AS html,
 CASE WHEN message_id % 37 IN (1, 2) THEN 'malformed body' END AS parts_error FROM messages""")
def m02(spark, sf_dir):
    return m.mime_bodies(m.mime_parts(mime_mails(spark, sf_dir)))


@query("m03_attachments", M, """SELECT message_id, 5 AS ord, 'f' || CAST(message_id AS VARCHAR) || '.pdf' AS filename, 'application/pdf' AS mime_type FROM messages WHERE message_id % 2 = 0 AND message_id % 37 NOT IN (1, 2)""")
def m03(spark, sf_dir):
    return m.attachments(m.mime_parts(mime_mails(spark, sf_dir)), "message_id")


@query("m04_header_value", M, "SELECT message_id, subject, sender, '' AS missing FROM messages")
def m04(spark, sf_dir):
    rows = with_headers(mails(spark, sf_dir))
    return rows.select(
        "message_id", *[m.header_value(F.col("headers"), n).alias(a) for n, a in (("subject", "subject"), ("FROM", "sender"), ("X-None", "missing"))]
    )


@query("m05_message_time", ("rfc_dates",), """SELECT event_id, CASE WHEN header = 'bad' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE date_trunc('second', ts) END AS sent FROM rfc_dates""")
def m05(spark, sf_dir):
    rows = view(spark, sf_dir, "rfc_dates")
    header = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Mon, "), F.col("header"), F.lit(" (UTC)"))).otherwise(F.col("header"))
    return rows.select("event_id", mail_time(header, F.lit("2024-02-01").cast("timestamp_ntz")).alias("sent"))


@query("m06_body_fallback", M, """SELECT message_id, CASE WHEN message_id % 3 = 0 THEN body_text WHEN body_html IS NOT NULL THEN 'go' ELSE subject END AS body FROM messages""")
def m06(spark, sf_dir):
    text = F.when(F.col("message_id") % 3 == 0, F.col("body_text")).otherwise("")
    return mails(spark, sf_dir).select("message_id", m.body_fallback(text, F.col("body_html"), F.col("subject")).alias("body"))


@query("m07_classify_event", M, PARSED + " SELECT message_id, event_type FROM parsed")
def m07(spark, sf_dir):
    return mails(spark, sf_dir).select("message_id", m.classify_event(F.col("sender"), F.col("subject")).alias("event_type"))


@query("m08_name_address", M, PARSED + " SELECT message_id, customer_name, address, address_suffix FROM parsed")
def m08(spark, sf_dir):
    return events(spark, sf_dir).select("message_id", "customer_name", "address", "address_suffix")


@query("m09_quoted_comment", M, PARSED + """ SELECT message_id, comment_text, array_to_string(regexp_extract_all(coalesce(comment_text, ''), '@([A-Za-z][A-Za-z0-9_]+)', 1), ',') AS mentions FROM parsed""")
def m09(spark, sf_dir):
    return events(spark, sf_dir).select("message_id", "comment_text", F.array_join("mentioned_users", ",").alias("mentions"))


@query("m10_tracking_url", M, PARSED + " SELECT message_id, tracking_url FROM parsed")
def m10(spark, sf_dir):
    return events(spark, sf_dir).select("message_id", "tracking_url")


@query("m11_parse_complete", M, PARSED + """ SELECT message_id, c IS NULL AS parse_complete, concat_ws('; ', c, CASE WHEN coalesce(customer_name, '') <> '' THEN 'identified by name only' END) AS notes
 FROM (SELECT *, CASE WHEN coalesce(customer_name, '') = '' OR coalesce(address, '') = '' THEN 'no identity in the message'
 WHEN event_type IN ('Estimate Complete', 'Estimate') THEN 'details lie behind the link' WHEN event_type = 'New Comment' AND comment_text IS NULL THEN 'comment without quoted text' END AS c FROM parsed) x""")
def m11(spark, sf_dir):
    return events(spark, sf_dir).select("message_id", "parse_complete", F.array_join("notes", "; ").alias("notes"))


@query("m12_forward_digest", M, PARSED + """ SELECT message_id, 'This message was escalated for review.' || chr(10) || chr(10) || 'Event type: ' || event_type || chr(10) || 'Reason: needs a person' AS head,
 'From: ' || sender || chr(10) || 'Date: ' || CAST(sent_s AS VARCHAR) || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body_text AS tail FROM parsed""")
def m12(spark, sf_dir):
    source = mails(spark, sf_dir)
    event_type = m.classify_event(F.col("sender"), F.col("subject"))
    record = F.struct(F.struct("message_id", event_type.alias("event_type")).alias("event"))
    digests = m.forward_digest(source, record, F.lit("needs a person"), event_type, "This message was escalated for review.")
    head = F.regexp_extract("digest", r"(?s)^(.*?)\n\n\{\n", 1)
    tail = F.regexp_extract("digest", r"(?s)\n\}\n\n(From: .*)$", 1)
    return digests.select("message_id", head.alias("head"), tail.alias("tail"))
