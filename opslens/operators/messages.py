"""Structured events from notification mails, as Column expressions over a message table."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.columns import mapping, one_of, regex_group, truthy_text
from opslens.functions.text import base64url_text, html_to_text, map_texts, strip, unescape

# Event types whose data lies behind a link, that move a milestone, or that ask for nothing.
CREATE_TYPES = ("Estimate Complete", "Estimate")
MILESTONE_TYPES = (
    "Install Date", "Job Scheduled", "Job In Progress", "Job Is Complete", "Job Completed", "Job Rescheduled",
    "Deposit Invoice Sent", "Deposit Invoice Paid", "Job Approval Confirmed", "HIC Executed", "Execute HIC",
)
IGNORE_TYPES = (
    "New Task", "Select Funding", "Estimate Ready for Approval", "Submit Credit Application", "Approve Estimate",
    "Please have CPC signed (If applicable)", "Closeout Completed", "Send HIC to Homeowner", "Install Date Confirmed",
    "Sign Contingency", "Send Loan Docs", "Sign Loan Documents",
)
COMMENT_TYPE = "New Comment"
# Spellings of event types and what they stand for.
TYPE_ALIASES = {
    "Estimate Comp.": "Estimate Complete",
    "Estimate Comp": "Estimate Complete",
    "Deposit Invoi.": "Deposit Invoice Sent",
    "Install Date .": "Install Date",
    "Install Date.": "Install Date",
    "New Project Mention": "New Comment",
    "New Project Comment": "New Comment",
    "Estimate in Progress": "Estimate",
    "New Project Task": "New Task",
}
# First words of a subject that belong to an event type and not to a name.
TYPE_HEADS = (
    "new project", "new ", "estimate", "install", "hic", "deposit", "job", "send", "select", "submit", "sign",
)
# Patterns of names with addresses, comments and mentions.
NAME_ADDRESS = r"(?U)([A-Za-z.'\- ]+?)\s+-\s+(\d[^\n\"\[\]]+)"
SUFFIX = r"\(([^)]+)\)\s*$"
QUOTED = r"(?s)\"(.+?)\""
MENTION = r"@([A-Za-z][A-Za-z0-9_]+)"


@dataclass(frozen=True)
class MailSource:
    """What is particular to one sender: its display-name mark and the host of its links (a regex)."""

    mark: str = "RFX"
    host: str = r"example\.test"

    @property
    def sender_pattern(self) -> str:
        return rf"(?i)^\s*{self.mark}\s*\|\s*([^<]+?)\s*<"

    @property
    def click_pattern(self) -> str:
        return rf"(?i)https?://url\d+\.{self.host}/ls/click\?[^\s\"'<>]+"

    @property
    def project_pattern(self) -> str:
        return rf"(?i)https?://(?:www\.)?{self.host}/project/[0-9]+x[0-9]+"


_PART = T.StructType().add("ord", "integer").add("mime", "string").add("filename", "string").add("data", "string")


@F.pandas_udf(T.ArrayType(_PART))
def _part_list(payloads: pd.Series) -> pd.Series:
    """Parts of one MIME tree in depth-first order; the first entry is the tree's root. Null for what is no such tree."""

    def walk(text: str) -> list[dict] | None:
        try:
            return parts(json.loads(text))
        except (ValueError, AttributeError, TypeError, RecursionError):
            return None

    def parts(tree: dict) -> list[dict]:
        stack, found = [tree], []
        while stack:
            part = stack.pop()
            found.append({
                "ord": len(found),
                "mime": part.get("mimeType") or "",
                "filename": part.get("filename"),
                "data": (part.get("body") or {}).get("data"),
            })
            stack.extend(reversed(part.get("parts") or []))
        return found

    return map_texts(payloads, walk)


def mime_parts(mails: DataFrame, payload: str = "payload") -> DataFrame:
    """Mails with a `parts` array of any depth, and `parts_error` where the body is no MIME tree."""
    rows = mails.withColumn("parts", _part_list(payload))
    broken = F.when(F.col("parts").isNull() & F.col(payload).isNotNull(), "malformed body")
    return rows.withColumn("parts_error", broken).drop(payload)


def mime_bodies(mails: DataFrame) -> DataFrame:
    """First plain-text and first HTML part that decode to something, in depth-first order."""

    def first(mime: str) -> Column:
        texts = F.transform(
            F.filter("parts", lambda p: (p["mime"] == mime) & p["data"].isNotNull()), lambda p: base64url_text(p["data"])
        )
        return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))

    return mails.withColumns({"text": F.coalesce(first("text/plain"), F.lit("")), "html": first("text/html")}).drop("parts")


def attachments(mails: DataFrame, key: str) -> DataFrame:
    """Name and type of every part below the root that has a file name."""
    part = F.explode(F.filter("parts", lambda p: (p["ord"] > 0) & (F.coalesce(p["filename"], F.lit("")) != ""))).alias("p")
    return mails.select(key, part).select(key, "p.ord", "p.filename", F.col("p.mime").alias("mime_type"))


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name in any case, '' if there is none."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def body_fallback(text: Column, html: Column, snippet: Column) -> Column:
    return F.coalesce(truthy_text(text, html_to_text(html), snippet), F.lit(""))


def classify_event(sender: Column, subject: Column, source: MailSource = MailSource()) -> Column:
    """Event type from the sender's display name, else the head of the subject, else Unknown."""
    by_sender = regex_group(F.coalesce(sender, F.lit("")), source.sender_pattern, 1)
    head = F.get(F.split(F.nullif(subject, F.lit("")), " - "), F.lit(0))
    found = strip(F.coalesce(by_sender, head, F.lit("Unknown")))
    return F.coalesce(F.try_element_at(mapping(TYPE_ALIASES), found), found)


def _without_type_head(subject: Column, event_type: Column) -> Column:
    cut = F.locate(" - ", subject)
    head = F.lower(F.substring(subject, F.lit(1), cut - 1))
    kind = F.lower(event_type)
    belongs = (kind != "") & (head.contains(kind) | kind.contains(head))
    for word in TYPE_HEADS:
        belongs = belongs | head.startswith(word)
    return F.when((cut > 0) & belongs, F.substring(subject, cut + 3, F.length(subject))).otherwise(subject)


def name_address(subject: Column, body: Column, event_type: Column) -> Column:
    """Struct `name, address, suffix` from the subject, else from the body; all null where neither has them."""
    first = _without_type_head(F.coalesce(subject, F.lit("")), event_type)
    text = F.when(first.rlike(NAME_ADDRESS), first).when(body.rlike(NAME_ADDRESS), body)
    name = strip(F.regexp_replace(F.regexp_extract(text, NAME_ADDRESS, 1), r"\s{2,}", " "))
    raw = F.regexp_replace(strip(F.regexp_extract(text, NAME_ADDRESS, 2)), r"\.+$", "")
    suffix = F.when(raw.rlike(SUFFIX), strip(F.regexp_extract(raw, SUFFIX, 1)))
    address = F.when(suffix.isNotNull(), strip(F.regexp_replace(raw, SUFFIX, ""))).otherwise(raw)
    return F.struct(name.alias("name"), address.alias("address"), suffix.alias("suffix"))


def quoted_comment(body: Column, event_type: Column) -> Column:
    """First quoted span of a comment mail, line breaks allowed; null for other event types."""
    return F.when(event_type == COMMENT_TYPE, F.when(body.rlike(QUOTED), strip(F.regexp_extract(body, QUOTED, 1))))


def mentions(comment: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(comment, F.lit(MENTION), F.lit(1)), F.array().cast("array<string>"))


def tracking_url(html: Column, body: Column, subject: Column, source: MailSource = MailSource()) -> Column:
    """Tokenised link of the HTML, else of the text, else a project link of subject or text."""
    return F.coalesce(
        regex_group(html, source.click_pattern, 0),
        regex_group(body, source.click_pattern, 0),
        regex_group(subject, source.project_pattern, 0),
        regex_group(body, source.project_pattern, 0),
    )


def _filled(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) != ""


def parse_complete(events: DataFrame) -> DataFrame:
    """Adds `parse_complete` and `notes` by four ordered cases."""
    named = _filled("customer_name") & _filled("address")
    case = one_of(
        [
            (~(_filled("ext_id") | named), "no identity in the message"),
            (F.col("event_type").isin(*CREATE_TYPES), "details lie behind the link"),
            ((F.col("event_type") == COMMENT_TYPE) & ~_filled("comment_text"), "comment without quoted text"),
        ]
    )
    by_name = F.when(_filled("customer_name") & ~_filled("ext_id"), F.lit("identified by name only"))
    return events.withColumn("parse_complete", case.isNull()).withColumn("notes", F.array_compact(F.array(case, by_name)))


def parse_messages(mails: DataFrame, source: MailSource = MailSource()) -> DataFrame:
    """Message table to event table; one narrow pass, no shuffle."""
    rows = mails.withColumns(
        {
            "subject": unescape(F.coalesce("subject", F.lit(""))),
            "body_text": unescape(F.coalesce("body_text", F.lit(""))),
            "body_html": F.coalesce("body_html", F.lit("")),
        }
    )
    rows = rows.withColumn("event_type", classify_event(F.col("sender"), F.col("subject"), source))
    rows = rows.withColumns(
        {
            "who": name_address(F.col("subject"), F.col("body_text"), F.col("event_type")),
            "comment_text": quoted_comment(F.col("body_text"), F.col("event_type")),
        }
    )
    ext_id = F.col("ext_id") if "ext_id" in mails.columns else F.lit(None).cast("string")
    events = rows.select(
        "message_id",
        "sent_s",
        "event_type",
        ext_id.alias("ext_id"),
        F.col("who.name").alias("customer_name"),
        F.col("who.address").alias("address"),
        F.col("who.suffix").alias("address_suffix"),
        "comment_text",
        mentions(F.col("comment_text")).alias("mentioned_users"),
        tracking_url(F.col("body_html"), F.col("body_text"), F.col("subject"), source).alias("tracking_url"),
        F.col("subject").alias("raw_subject"),
    )
    return parse_complete(events)


def forward_digest(mails: DataFrame, record: Column, reason: Column, event_type: Column, banner: str) -> DataFrame:
    """One text block per escalated message: why, the record as JSON, and the original."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value)

    digest = F.concat_ws(
        "\n",
        F.lit(banner),
        F.lit(""),
        line("Event type", F.coalesce(F.nullif(event_type, F.lit("")), F.lit("(unknown)"))),
        line("Reason", reason),
        F.lit(""),
        F.to_json(record, {"pretty": "true"}),
        F.lit(""),
        line("From", F.col("sender")),
        line("Date", F.col("sent_s").cast("string")),
        line("Subject", F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("(no subject)"))),
        F.lit(""),
        F.coalesce("body_text", F.lit("")),
    )
    return mails.select("message_id", digest.alias("digest"))
