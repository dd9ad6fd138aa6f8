"""Rule decisions over resolved events, and what each decision leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.columns import one_of
from opslens.functions.text import strip
from opslens.operators.identity import resolve_context
from opslens.operators.messages import COMMENT_TYPE, CREATE_TYPES, IGNORE_TYPES, MILESTONE_TYPES


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def decide(events: DataFrame, phase: int, note_prefix: str = "[Source] ") -> DataFrame:
    """First rule that applies gives `action, target, rule, needs_human, source` and the payload `note_text, link`.

    Whatever no rule covers is queued for a model with action `ask_model`.
    """
    mentions = F.when(F.size("mentioned_users") > 0, F.concat(F.lit("\n(Mentions: "), F.array_join("mentioned_users", ", "), F.lit(")")))
    note = F.concat(F.lit(note_prefix), F.col("comment_text"), F.coalesce(mentions, F.lit("")))
    known = F.col("found")
    project = F.col("project_id").cast("string")
    identified = F.col("parse_complete") | _filled("ext_id") | (_filled("customer_name") & _filled("address"))
    comment = F.col("event_type") == COMMENT_TYPE
    milestone, create, ignored = (F.col("event_type").isin(*t) for t in (MILESTONE_TYPES, CREATE_TYPES, IGNORE_TYPES))

    def answer(action: str, rule: str, target: Column | None = None, human: bool = False, source: str = "rule") -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            (F.lit(None).cast("string") if target is None else target).alias("target"),
            F.lit(rule).alias("rule"),
            F.lit(human).alias("needs_human"),
            F.lit(source).alias("source"),
        )

    def escalate(rule: str) -> Column:
        return answer("escalate", rule, human=True)

    rules = [
        (~identified, escalate("unidentified")),
        (known & F.col("ambiguous"), escalate("ambiguous")),
        (comment & ~known, escalate("comment on unknown project")),
        (comment & ~_filled("comment_text"), escalate("comment without text")),
        (comment, answer("append_note", "comment", project)),
        (milestone & ~known, escalate("milestone of unknown project")),
        (milestone, answer("update_milestone", "milestone", project)),
        (create & F.lit(phase == 0), answer("ignore", "informational in this phase")),
        (create & F.col("project_id").isNotNull(), answer("noop_project_exists", "project exists", project)),
        (create & _filled("tracking_url"), answer("create_project", "create by link", F.col("tracking_url"))),
        (create, escalate("create without link")),
        (ignored, answer("ignore", "prompt for a person")),
    ]
    decided = events.withColumn("_d", one_of(rules, answer("ask_model", "no rule", source="model"))).select("*", "_d.*").drop("_d")
    payload = {"note_text": F.when(F.col("action") == "append_note", note), "link": F.when(F.col("action") == "create_project", F.col("tracking_url"))}
    return decided.withColumns(payload)


def ignore_shortcut(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Context of every event; ignored types bypass both lookups and are joined with nothing."""
    ignored = F.col("event_type").isin(*IGNORE_TYPES)
    looked_up = resolve_context(events.where(~ignored), projects)
    passed = events.where(ignored).withColumns(
        {
            "candidate_count": F.lit(0).cast("bigint"),
            "project_id": F.lit(None).cast("bigint"),
            "found": F.lit(False),
            "ambiguous": F.lit(False),
            "context_note": F.lit("not looked up"),
        }
    )
    return looked_up.unionByName(passed)


def fetch_gate(events: DataFrame, source_available: bool = True) -> DataFrame:
    """`will_fetch` for linked events that are unknown or ambiguous, else the reasons why not."""
    ready = F.lit(source_available) & _filled("tracking_url")
    open_case = ~F.col("found") | F.col("ambiguous")
    reasons = F.array_compact(
        F.array(
            F.when(F.lit(not source_available), F.lit("no source")),
            F.when(~_filled("tracking_url"), F.lit("no link")),
            F.when(F.col("found") & ~F.col("ambiguous"), F.lit("already resolved")),
        )
    )
    acted_on = ~F.col("event_type").isin(*IGNORE_TYPES)
    gated = events.withColumn("will_fetch", acted_on & ready & open_case)
    detail = one_of(
        [
            (~acted_on, "ignored type"),
            (F.col("will_fetch") & F.col("ambiguous"), "fetch: several candidates"),
            (F.col("will_fetch"), "fetch: not found"),
        ],
        F.concat(F.lit("skip: "), F.array_join(reasons, "; ")),
    )
    return gated.withColumn("gate", detail)


def merge_fetched(events: DataFrame, fetched: DataFrame, projects: DataFrame) -> DataFrame:
    """Fetched names and addresses override where present, the fetched id replaces, and context is resolved anew.

    `fetched` has one row per `message_id` with `fetched_ext_id, full_name, street_address, is_accepted`.
    """
    context = ("candidate_count", "project_id", "found", "ambiguous", "context_note")
    rows = events.drop(*context).join(fetched, "message_id", "left")
    got = F.col("fetched_ext_id").isNotNull()
    merged = rows.withColumns(
        {
            "customer_name": F.coalesce(F.nullif("full_name", F.lit("")), "customer_name"),
            "address": F.coalesce(F.nullif("street_address", F.lit("")), "address"),
            "ext_id": F.when(got, F.col("fetched_ext_id")).otherwise(F.col("ext_id")),
            "is_accepted": F.coalesce("is_accepted", F.lit(False)),
            "parse_complete": F.col("parse_complete") | got,
        }
    ).drop("full_name", "street_address")
    return resolve_context(merged, projects)


def route_actions(decisions: DataFrame, mapped_types: tuple[str, ...]) -> DataFrame:
    """End state of every decision: `ledger_status` (null leaves no ledger row), `metadata` of that row, `detail`, `write_ok`.

    The metadata is JSON: action, source and rule, the project of decisions on one, and the error of failed ones, as
    far as the decisions have these columns.

    `forwarded, fetched_ext_id, is_accepted, crm_online, plan_ok` say how the outside steps went.
    """
    action = F.col("action")

    def end(status: str | None, detail: str, ok: bool = True) -> Column:
        return F.struct(F.lit(status).cast("string").alias("ledger_status"), F.lit(detail).alias("detail"), F.lit(ok).alias("write_ok"))

    creating = action == "create_project"
    rules = [
        (action == "ignore", end("ok", "ignored")),
        (action == "noop_project_exists", end("ok", "project exists")),
        (F.col("needs_human") & F.col("forwarded"), end("ok", "escalated and forwarded")),
        (F.col("needs_human"), end("ok", "escalated")),
        (~F.col("crm_online"), end(None, "offline")),
        (action == "append_note", end(None, "note appended")),
        ((action == "update_milestone") & ~F.col("event_type").isin(*mapped_types), end(None, "no mapping", False)),
        (action == "update_milestone", end(None, "milestone set")),
        (creating & F.col("fetched_ext_id").isNull(), end(None, "nothing fetched", False)),
        (creating & ~F.col("is_accepted"), end("ok", "not accepted")),
        (creating & F.col("plan_ok"), end("ok", "project ensured")),
        (creating, end("error", "plan failed", False)),
    ]
    routed = decisions.withColumn("_end", one_of(rules, end("error", "unsupported action", False))).select("*", "_end.*").drop("_end")
    failed = F.col("ledger_status") == "error"

    def known(name: str) -> Column:
        return F.col(name).cast("string") if name in decisions.columns else F.lit(None).cast("string")

    metadata = F.to_json(
        F.struct(
            F.when(~failed, action).alias("action"),
            known("source").alias("source"),
            known("rule").alias("reasoning"),
            F.when(~failed, known("project_id")).alias("project_id"),
            F.when(failed, F.concat("detail", F.lit(" "), action)).alias("error"),
        )
    )
    return routed.withColumn("metadata", F.when(F.col("ledger_status").isNotNull(), metadata))


def visibility(decisions: DataFrame) -> DataFrame:
    """`cleared` unless the message was escalated without being forwarded, or ignored by a model."""
    action = F.col("action")
    stays = ((action == "escalate") & ~F.col("forwarded")) | ((action == "ignore") & (F.col("source") != "rule"))
    return decisions.withColumn("cleared", ~stays)


def decision_tallies(decisions: DataFrame) -> DataFrame:
    """Totals by action, by source and of escalations as `kind, value, n`; one pass, one small shuffle."""
    escalated = F.col("needs_human") | (F.col("action") == "escalate")
    entries = F.array(
        F.struct(F.lit("action").alias("kind"), F.col("action").alias("value")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")),
        F.struct(F.lit("all").alias("kind"), F.lit("decisions").alias("value")),
        F.when(escalated, F.struct(F.lit("all").alias("kind"), F.lit("escalations").alias("value"))),
    )
    rows = decisions.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"))


def parse_model_decision(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Model reply to a decision; anything unusable escalates to a person."""
    text = strip(F.coalesce(F.col(reply), F.lit("")))
    text = strip(F.regexp_replace(F.regexp_replace(text, r"^```(json)?", ""), r"```$", ""))
    parsed = replies.withColumn("_t", text).withColumn("_v", F.try_parse_json("_t"))

    def field(path: str, cast: str) -> Column:
        return F.try_variant_get("_v", path, cast)

    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    good = F.coalesce(is_object & F.try_variant_get("_v", "$.action", "variant").isNotNull(), F.lit(False))
    failure = one_of(
        [(F.col("_t") == "", "empty reply"), (F.col("_v").isNull(), "not JSON"), (~good, "no action")]
    )
    return parsed.select(
        *[c for c in replies.columns if c != reply],
        F.when(good, field("$.action", "string")).otherwise("escalate").alias("action"),
        F.when(good, field("$.target", "string")).alias("target"),
        F.when(good, F.coalesce(field("$.reasoning", "string"), F.lit(""))).otherwise(failure).alias("reasoning"),
        F.when(good, F.coalesce(field("$.needs_human", "boolean"), F.lit(False))).otherwise(True).alias("needs_human"),
        F.lit("model").alias("source"),
    )
