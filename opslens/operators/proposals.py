"""Proposal records from captured documents `project_id, arrival, envelope, type, doc_id, payload`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.columns import one_of

# Document types and the mark inside reference strings.
ORDER, PERSON, CONTRACT, JOB, WARRANTY = (
    "custom.order1", "custom.homeowner", "custom.hic", "custom.job1", "custom.warranty",
)
LOOKUP_MARK = "__LOOKUP__"


@dataclass(frozen=True)
class ProposalFields:
    """Payload field behind every output column. The defaults are the documents' own names."""

    order: dict[str, str] = field(default_factory=lambda: {
        "external_ref": "external_project_id_text",
        "display_text": "display_text",
        "estimated_price": "price__final__number",
        "staging_price": "staging_price_number",
        "markup": "markup__final__number",
        "markup_alt": "rfx_markup_number",
        "funding_type": "funding1_option_funding",
        "financing_provider": "financing_provider_option_loan_provider",
        "trade": "trade_option_trade",
        "project_type": "type_option_type__estimate_",
        "steep_slope_product": "steep_slope_product_option_steep_slope_products",
        "sales_rep_ref": "sales_rep_user",
        "estimator_ref": "estimator_user",
        "office_ref": "office_custom_office",
        "person_ref": "homeowner_custom_homeowner",
        "stage_completed_internal": "pts_trigger_type_completed__internal__option_progress_tracker_stage",
        "stage_upcoming_internal": "pts_trigger_type_upcoming__internal__option_progress_tracker_stage",
        "stage_completed_external": "pts_trigger_type_completed__external__option_progress_tracker_stage",
    })
    person: dict[str, str] = field(default_factory=lambda: {
        "first_name": "first_name_text",
        "last_name": "last_name_text",
        "full_name": "full_name_text",
        "email": "email_text",
        "phone": "phone_nmber_text",
        "street_address": "street_address_text",
        "city": "city_text",
        "state": "state_text",
        "state_abbr": "state_abbr_text",
        "zip_code": "zip_text",
        "portal_code": "portal_code_text",
        "person_stage": "stage_option_type__contact_",
    })
    contract: dict[str, str] = field(default_factory=lambda: {
        "contract_status": "status_option_contingency",
        "contract_signature": "signature_url_text",
    })
    job: dict[str, str] = field(default_factory=lambda: {
        "actual_contract_price": "contract_price_number",
        "job_funding_source": "funding_source_option_funding",
        "shingle_color": "shingle_color_v2_text",
        "install_date_ms": "install_date_date",
        "install_scheduled_date_ms": "install_scheduled_date_date",
        "job_status": "status_option_job_status",
    })


NUMBERS = ("estimated_price", "staging_price", "markup_alt", "actual_contract_price")
WHOLE = ("install_date_ms", "install_scheduled_date_ms")
REFERENCES = ("sales_rep_ref", "estimator_ref", "office_ref", "person_ref")

# The fields handed on to planning.
FORWARDED = (
    "ext_id", "is_accepted", "display_text", "customer_name", "full_name", "first_name", "last_name", "email", "phone",
    "street_address", "city", "state_text", "state_abbr", "zip_code", "contract_price", "actual_contract_price",
    "funding_type", "trade", "job_status", "hic_status", "hic_signature_present", "acceptance_signals", "error",
)


def strip_lookup(ref: Column) -> Column:
    """Text behind the lookup mark; texts without it stay, an empty rest is null."""
    at = F.instr(ref, LOOKUP_MARK)
    tail = F.substring(ref, at + len(LOOKUP_MARK), F.length(ref))
    return F.nullif(F.when(at > 0, tail).otherwise(ref), F.lit(""))


def _first_doc(envelope: str, doc_type: str) -> Column:
    mine = (F.col("envelope") == envelope) & (F.col("type") == doc_type)
    return F.min_by(F.when(mine, F.struct("doc_id", "payload")), F.when(mine, F.col("arrival")))


def _numeric(text: Column) -> Column:
    return text.try_cast("double")


def extract_proposal(docs: DataFrame, fields: ProposalFields = ProposalFields(), asked: DataFrame | None = None) -> DataFrame:
    """One row per project: the first document of every type is pivoted by one partial aggregate,
    then each payload is read once with the schema of the wanted fields.

    Error rows: a project of `asked` (`project_id`, the responses that were awaited) without any response, one whose
    responses hold neither initial data nor documents, and one without an order id and a person.
    """
    picked = docs.groupBy("project_id").agg(
        F.count_if(F.col("envelope").isin("init", "mget")).alias("_docs"),
        _first_doc("init", ORDER).alias("order"),
        *[_first_doc("mget", t).alias(a) for t, a in ((PERSON, "person"), (CONTRACT, "contract"), (JOB, "job"), (WARRANTY, "warranty"))],
    )
    if asked is not None:
        picked = asked.select("project_id").distinct().join(picked, "project_id", "left")
    parts = {"order": fields.order, "person": fields.person, "contract": fields.contract, "job": fields.job}
    values: dict[str, Column] = {}
    for part, names in parts.items():
        schema = "STRUCT<" + ", ".join(f"`{n}`: STRING" for n in dict.fromkeys(names.values())) + ">"
        picked = picked.withColumn(f"_{part}", F.from_json(F.col(part)["payload"], schema))
        for out, name in names.items():
            values[out] = F.col(f"_{part}")[name]
    for name in NUMBERS:
        values[name] = _numeric(values[name])
    for name in WHOLE:
        values[name] = values[name].try_cast("bigint")
    for name in REFERENCES:
        values[name] = strip_lookup(values[name])
    markup, alt = values.pop("markup"), values.pop("markup_alt")
    no_markup = markup.isNull() | (markup == "") | (F.coalesce(_numeric(markup), F.lit(1.0)) == 0)
    values["markup"] = F.when(no_markup, alt).otherwise(_numeric(markup))
    person_id = F.col("person")["doc_id"]
    values["person_ref"] = F.coalesce(values["person_ref"], person_id)
    signature = values.pop("contract_signature")
    empty_person = F.col("person").isNull() | (F.regexp_replace(F.col("person")["payload"], r"\s", "") == "{}")
    no_order_id = F.coalesce(F.col("order")["doc_id"], F.lit("")) == ""
    error = one_of(
        [
            (F.col("_docs").isNull(), "no response"),
            (F.col("_docs") == 0, "neither init data nor documents"),
            (no_order_id & empty_person, "neither order nor person document"),
        ]
    )
    rows = picked.select(
        "project_id",
        error.alias("error"),
        F.col("order")["doc_id"].alias("ext_id"),
        *[c.alias(n) for n, c in values.items()],
        F.col("contract")["doc_id"].alias("contract_ref"),
        F.col("job")["doc_id"].alias("job_ref"),
        F.col("warranty")["doc_id"].alias("warranty_ref"),
        F.coalesce(signature != "", F.lit(False)).alias("contract_signature_present"),
    )
    return acceptance(rows.withColumn("ok", F.col("error").isNull()))


def acceptance(rows: DataFrame) -> DataFrame:
    """Any one of three signals accepts a proposal; all seven signals are kept."""
    executed = F.coalesce(F.col("contract_status") == "executed", F.lit(False))
    working = F.coalesce("job_status", F.lit("")) != ""
    customer = F.coalesce(F.col("person_stage") == "customer", F.lit(False))
    signals = F.struct(
        F.col("contract_ref").isNotNull().alias("contract_present"),
        executed.alias("contract_executed"),
        F.col("contract_signature_present").alias("signature_present"),
        F.col("job_ref").isNotNull().alias("job_present"),
        F.col("job_status").alias("job_status"),
        F.col("person_stage").alias("person_stage"),
        F.col("warranty_ref").isNotNull().alias("warranty_present"),
    )
    return rows.withColumns({"is_accepted": F.col("ok") & (executed | working | customer), "acceptance_signals": signals})


def payload_projection(rows: DataFrame) -> DataFrame:
    """The forwarded fields, each mapped to the column that holds it."""
    renamed = {
        "customer_name": F.col("full_name"),
        "state_text": F.col("state"),
        "contract_price": F.col("actual_contract_price"),
        "hic_status": F.col("contract_status"),
        "hic_signature_present": F.col("contract_signature_present"),
    }
    return rows.select("project_id", *[renamed.get(f, F.col(f)).alias(f) for f in FORWARDED], "person_ref")


def proposals_for_planning(rows: DataFrame) -> DataFrame:
    """Extracted rows in the shape of the find-or-create plan."""
    joined = F.nullif(F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))), F.lit(""))
    name = one_of([(F.coalesce("full_name", F.lit("")) != "", F.col("full_name"))], joined)
    return rows.where("ok").select(
        F.col("project_id").alias("proposal_id"), "ext_id", name.alias("name"), "email",
        F.col("street_address").alias("street"), "display_text", "is_accepted",
    )
