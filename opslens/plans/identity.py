"""Registered identity, planning, decision and proposal queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from opslens.operators import decisions as d
from opslens.operators import identity as i
from opslens.operators import messages as m
from opslens.operators import proposals as x
from opslens.plans.messages import PARSED
from opslens.plans.registry import query
from opslens.plans.views import table, view
from opslens.session import materialize, scratch_path

V = ("messages", "crm_project")
EV = PARSED + """, ev0 AS (SELECT *, CASE WHEN message_id % 3 = 0 THEN 'x' || CAST(message_id % 3000 AS VARCHAR) END AS ext_id FROM parsed),
ev AS (SELECT *, CASE WHEN ext_id IS NOT NULL THEN 'id:' || ext_id ELSE 'na:' || lower(coalesce(customer_name, '')) || '|' || lower(coalesce(address, '')) END AS identity,
 (ext_id IS NOT NULL OR (coalesce(customer_name, '') <> '' AND coalesce(address, '') <> '')) AND event_type NOT IN ('Estimate Complete', 'Estimate')
 AND NOT (event_type = 'New Comment' AND comment_text IS NULL) AS parse_complete FROM ev0)"""
LOOKUPS = """live AS (SELECT * FROM crm_project WHERE NOT archived AND status_id NOT IN (59)),
by_ext AS (SELECT ext_id AS k, count(*) AS n, min(id) AS id FROM live WHERE ext_id IS NOT NULL GROUP BY 1),
by_name AS (SELECT lower(project_name) AS k, count(*) AS n, min(id) AS id FROM live GROUP BY 1),
by_place AS (SELECT lower(project_name) AS k, lower(street1) AS s, count(*) AS n, min(id) AS id FROM live GROUP BY 1, 2)"""


def context_sql(source: str, name: str) -> str:
    """SQL of the resolved context of the rows in `source`."""
    return f"""{name}_n AS (SELECT e.*, coalesce(x.n, 0) AS ext_n, x.id AS ext_hit,
 CASE WHEN coalesce(customer_name, '') = '' THEN 0 WHEN coalesce(address, '') <> '' THEN coalesce(p.n, 0) ELSE coalesce(b.n, 0) END AS name_n,
 CASE WHEN coalesce(address, '') <> '' THEN p.id ELSE b.id END AS name_hit FROM {source} e LEFT JOIN by_ext x ON e.ext_id = x.k
 LEFT JOIN by_name b ON lower(trim(e.customer_name)) = b.k LEFT JOIN by_place p ON lower(trim(e.customer_name)) = p.k AND lower(trim(e.address)) = p.s),
{name}_c AS (SELECT *, CASE WHEN ext_n > 0 THEN ext_n ELSE name_n END AS candidate_count,
 CASE WHEN ext_n = 1 THEN ext_hit WHEN ext_n = 0 AND name_n = 1 THEN name_hit END AS project_id FROM {name}_n),
{name} AS (SELECT *, candidate_count > 0 AS found, candidate_count > 1 AS ambiguous FROM {name}_c)"""


CTX = EV + ", " + LOOKUPS + ", " + context_sql("ev", "ctx")


def events(spark, sf_dir):
    mails = view(spark, sf_dir, "messages")
    ext = F.when(F.col("message_id") % 3 == 0, F.concat(F.lit("x"), (F.col("message_id") % 3000).cast("string")))
    return i.with_identity(m.parse_messages(mails.withColumn("ext_id", ext)))


def projects(spark, sf_dir):
    return view(spark, sf_dir, "crm_project")


def resolved(spark, sf_dir):
    return i.resolve_context(events(spark, sf_dir), projects(spark, sf_dir))


@query("i01_identity_key", ("messages",), EV + " SELECT message_id, identity FROM ev")
def i01(spark, sf_dir):
    return events(spark, sf_dir).select("message_id", "identity")


@query("i02_group_in_order", ("messages",), EV + """ SELECT message_id, identity, row_number() OVER (PARTITION BY identity ORDER BY sent_s, message_id) AS position FROM ev""")
def i02(spark, sf_dir):
    written = materialize(events(spark, sf_dir).select("message_id", "identity", "sent_s"), "events")
    return i.group_in_order(written).select("message_id", "identity", "position")


@query("i03_group_sizes", ("messages",), EV + """, sizes AS (SELECT identity, count(*) AS events FROM ev GROUP BY identity)
 SELECT * FROM (SELECT identity, events FROM sizes ORDER BY events DESC, identity LIMIT 10) t UNION ALL SELECT '(others)', greatest(count(*) - 10, 0) FROM sizes""")
def i03(spark, sf_dir):
    return i.group_sizes(events(spark, sf_dir))


@query("i04_live_projects", ("crm_project",), "SELECT id, project_name, status_id FROM crm_project WHERE NOT archived AND status_id NOT IN (59)")
def i04(spark, sf_dir):
    return i.live_projects(projects(spark, sf_dir)).select("id", "project_name", "status_id")


@query("i05_resolve_by_ext_id", V, CTX + " SELECT message_id, ext_id, ext_n AS matches, CASE WHEN ext_n = 1 THEN ext_hit END AS project_id FROM ctx")
def i05(spark, sf_dir):
    hits = i.resolve_by_ext_id(events(spark, sf_dir), projects(spark, sf_dir))
    return hits.select("message_id", "ext_id", "matches", "project_id")


@query("i06_resolve_by_name", V, CTX + " SELECT message_id, customer_name, name_n AS matches, CASE WHEN name_n = 1 THEN name_hit END AS project_id FROM ctx")
def i06(spark, sf_dir):
    hits = i.resolve_by_name(events(spark, sf_dir), projects(spark, sf_dir))
    return hits.select("message_id", "customer_name", "matches", "project_id")


@query("i07_resolve_context", V, CTX + """ SELECT message_id, found, ambiguous, project_id, candidate_count,
 CASE WHEN ambiguous THEN 'ambiguous (' || CAST(candidate_count AS VARCHAR) || ' candidates)' WHEN found THEN 'project found (id=' || CAST(project_id AS VARCHAR) || ')'
 ELSE 'project not found' END AS context_note FROM ctx""")
def i07(spark, sf_dir):
    return resolved(spark, sf_dir).select("message_id", "found", "ambiguous", "project_id", "candidate_count", "context_note")


@query("i08_match_entity", ("messages", "crm_entity"), EV + """, people AS (SELECT message_id, customer_name AS name, address AS street,
 CASE WHEN (message_id // 1000) % 3 <> 0 THEN ' c' || CAST((message_id // 1000) % 1300 AS VARCHAR) || '@example.test' END AS email FROM ev),
 keyed AS (SELECT *, lower(regexp_extract(trim(name), '^(\\S+)\\s+(\\S.*)$', 1)) AS f, lower(coalesce(nullif(regexp_extract(trim(name), '^(\\S+)\\s+(\\S.*)$', 2), ''), trim(name))) AS l FROM people),
 live AS (SELECT * FROM crm_entity WHERE NOT archived AND object_type_id = 8)
 SELECT message_id, count(e.id) AS entity_matches, CASE WHEN count(e.id) = 1 THEN min(e.id) END AS entity_id FROM keyed k LEFT JOIN live e
 ON CASE WHEN k.email IS NOT NULL THEN lower(e.email) = lower(trim(k.email)) ELSE coalesce(k.name, '') <> '' AND lower(e.last_name) = k.l AND (k.f = '' OR lower(e.first_name) = k.f)
 AND (coalesce(k.street, '') = '' OR lower(e.street1) = lower(trim(k.street))) END GROUP BY message_id""")
def i08(spark, sf_dir):
    conv = F.floor(F.col("message_id") / 1000)
    email = F.when(conv % 3 != 0, F.concat(F.lit(" c"), (conv % 1300).cast("string"), F.lit("@example.test")))
    people = events(spark, sf_dir).select("message_id", F.col("customer_name").alias("name"), F.col("address").alias("street"), email.alias("email"))
    hits = i.match_entity(people, view(spark, sf_dir, "crm_entity"), "message_id")
    return hits.select("message_id", "entity_matches", "entity_id")


@query("i09_lookup_state", ("crm_state",), """asked AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' n' || CAST(c_nationkey AS VARCHAR) WHEN 2 THEN 'zz' END AS state_abbr, lower(n_name) || ' ' AS state_text
 FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, coalesce(a.id, b.id) AS state_id FROM asked LEFT JOIN crm_state a ON upper(trim(state_abbr)) = upper(a.abbreviation)
 LEFT JOIN crm_state b ON lower(trim(state_text)) = lower(b.state_name)""")
def i09(spark, sf_dir):
    abbr = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"))).when(F.col("c_custkey") % 3 == 2, "zz")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    asked = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        "c_custkey", abbr.alias("state_abbr"), F.concat(F.lower("n_name"), F.lit(" ")).alias("state_text")
    )
    return i.lookup_state(asked, view(spark, sf_dir, "crm_state")).select("c_custkey", "state_id")


@query("i10_lookup_unique_name", (), """blocks AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 7 <> 0 AS archived FROM part),
 asked AS (SELECT DISTINCT upper(p_name) || ' ' AS asked_name FROM part),
 hits AS (SELECT lower(name) AS k, count(*) AS n, min(id) AS id FROM blocks WHERE NOT archived GROUP BY 1)
 SELECT asked_name, coalesce(n, 0) AS hits, CASE WHEN n = 1 THEN id END AS id, CASE WHEN coalesce(n, 0) <> 1 THEN 'needs exactly one' END AS error FROM asked LEFT JOIN hits ON lower(trim(asked_name)) = k""")
def i10(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    blocks = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7 != 0).alias("archived"))
    asked = part.select(F.concat(F.upper("p_name"), F.lit(" ")).alias("asked_name")).distinct()
    return i.lookup_unique_name(asked, blocks, "asked_name")


PLAN = LOOKUPS + """, prop AS (SELECT project_id AS proposal_id, 'x' || CAST(project_id % 3000 AS VARCHAR) AS ext_id,
 first(payload->>'$.email' ORDER BY arrival) FILTER (WHERE type = 'custom.homeowner') AS email, first(payload->>'$.last' ORDER BY arrival) FILTER (WHERE type = 'custom.homeowner') AS last_name
 FROM capture_docs GROUP BY project_id HAVING count(*) FILTER (WHERE type IN ('custom.order1', 'custom.homeowner')) > 0),
 ent AS (SELECT lower(email) AS k, count(*) AS n, min(id) AS id FROM crm_entity WHERE NOT archived AND object_type_id = 8 GROUP BY 1),
 links AS (SELECT DISTINCT o_custkey AS entity_id, o_orderkey AS project_id FROM orders WHERE o_orderkey % 10 <> 0),
 base AS (SELECT p.*, coalesce(e.n, 0) AS entity_matches, CASE WHEN e.n = 1 THEN e.id END AS entity_id, coalesce(x.n, 0) AS project_matches, CASE WHEN x.n = 1 THEN x.id END AS project_id
 FROM prop p LEFT JOIN ent e ON lower(p.email) = e.k LEFT JOIN by_ext x ON p.ext_id = x.k),
 st AS (SELECT *, CASE WHEN email IS NULL THEN 'no name or email' WHEN entity_matches > 1 THEN 'review entity' WHEN project_matches > 1 THEN 'review project' ELSE 'ok' END AS status FROM base),
 wants AS (SELECT st.*, status IN ('ok', 'review project') AND entity_matches = 0 AS we, status = 'ok' AND project_matches = 0 AS wp, status = 'ok' AND l.entity_id IS NULL AS wl
 FROM st LEFT JOIN links l ON st.entity_id = l.entity_id AND st.project_id = l.project_id),
 plan AS (SELECT *, we AND row_number() OVER (PARTITION BY we, lower(email) ORDER BY proposal_id) = 1 AS created_entity, wp AND row_number() OVER (PARTITION BY wp, ext_id ORDER BY proposal_id) = 1 AS created_project,
 wl AND row_number() OVER (PARTITION BY wl, coalesce(CAST(entity_id AS VARCHAR), email), coalesce(CAST(project_id AS VARCHAR), ext_id) ORDER BY proposal_id) = 1 AS created_link FROM wants)"""
P = ("capture_docs", "crm_entity", "crm_project")


def fixture_fields():
    base = x.ProposalFields()
    return dataclasses.replace(
        base,
        order={**base.order, "estimated_price": "price", "markup": "markup", "markup_alt": "markup_alt", "sales_rep_ref": "rep"},
        person={**base.person, "person_stage": "stage", "portal_code": "copy", "email": "email", "first_name": "first", "last_name": "last"},
        contract={**base.contract, "contract_status": "status"},
        job={**base.job, "actual_contract_price": "contract_price", "job_status": "status"},
    )


def extracted(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"))
    return x.extract_proposal(view(spark, sf_dir, "capture_docs"), fixture_fields(), asked)


def plan(spark, sf_dir):
    proposals = x.proposals_for_planning(extracted(spark, sf_dir)).withColumn(
        "ext_id", F.concat(F.lit("x"), (F.col("proposal_id") % 3000).cast("string"))
    )
    links = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 10 == 0).alias("archived")
    )
    return i.plan_entities_projects(proposals, view(spark, sf_dir, "crm_entity"), projects(spark, sf_dir), links, cut=materialize)


@query("i11_plan_entities_projects", P, PLAN + """ SELECT proposal_id, status, entity_id, project_id, created_entity, created_project, created_link,
 CASE WHEN created_project THEN 'Ann ' || last_name END AS project_name FROM plan""")
def i11(spark, sf_dir):
    return plan(spark, sf_dir).select(
        "proposal_id", "status", "entity_id", "project_id", "created_entity", "created_project", "created_link", "project_name"
    )


MILES = """blocks AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, CASE WHEN n_regionkey = 1 THEN 'DUP' ELSE n_name END FROM nation),
 uniq AS (SELECT lower(name) AS k, min(id) AS id FROM blocks GROUP BY 1 HAVING count(*) = 1),
 upd AS (SELECT event_id % 4000 AS project_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'HIC Executed' WHEN 'click' THEN 'Install Date' WHEN 'purchase' THEN 'Job Scheduled'
 WHEN 'signup' THEN 'Job Completed' ELSE 'Deposit Invoice Paid' END AS event_type FROM events),
 mapped AS (SELECT *, CASE event_type WHEN 'HIC Executed' THEN 'asia' WHEN 'Install Date' THEN 'EUROPE ' WHEN 'Job Scheduled' THEN 'AFRICA' WHEN 'Deposit Invoice Paid' THEN 'DUP' END AS block,
 CASE event_type WHEN 'HIC Executed' THEN 11 WHEN 'Install Date' THEN 12 WHEN 'Job Scheduled' THEN 13 WHEN 'Deposit Invoice Paid' THEN 14 END AS st FROM upd),
 hit AS (SELECT m.*, u.id AS block_id FROM mapped m LEFT JOIN uniq u ON lower(trim(m.block)) = u.k),
 want AS (SELECT project_id, block_id, last(st ORDER BY ts, seq) AS new_status FROM hit WHERE block_id IS NOT NULL GROUP BY 1, 2),
 target AS (SELECT o_orderkey AS project_id, o_orderkey % 5 AS block_id, 1 AS status_id FROM orders)"""


def milestone_tables(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.when(F.col("n_regionkey") == 1, "DUP").otherwise(F.col("n_name")).alias("name")
    )
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    blocks = region.unionByName(nation).withColumn("archived", F.lit(False))
    kind = F.col("event_type")
    label = (
        F.when(kind == "view", "HIC Executed").when(kind == "click", "Install Date").when(kind == "purchase", "Job Scheduled")
        .when(kind == "signup", "Job Completed").otherwise("Deposit Invoice Paid")
    )
    updates = table(spark, sf_dir, "events").select((F.col("event_id") % 4000).alias("project_id"), "ts", F.col("event_id").alias("seq"), label.alias("event_type"))
    orders = table(spark, sf_dir, "orders")
    target = orders.select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 5).alias("block_id"), F.lit(1).alias("status_id"))
    stages = {"HIC Executed": ("asia", 11), "Install Date": ("EUROPE ", 12), "Job Scheduled": ("AFRICA", 13), "Deposit Invoice Paid": ("DUP", 14)}
    return target, updates, stages, blocks


def milestones(spark, sf_dir):
    return i.upsert_milestone(*milestone_tables(spark, sf_dir))


@query("i12_upsert_milestone", (), MILES + """ SELECT project_id, block_id, coalesce(new_status, status_id) AS status_id,
 CASE WHEN new_status IS NULL THEN 'kept' WHEN status_id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM target FULL JOIN want USING (project_id, block_id)""")
def i12(spark, sf_dir):
    return milestones(spark, sf_dir)[0]


@query("i12_upsert_milestone_table", (), MILES + " SELECT project_id, block_id, coalesce(new_status, status_id) AS status_id FROM target FULL JOIN want USING (project_id, block_id)")
def i12_table(spark, sf_dir):
    """The same on disk: the orders are stored, and the updates rewrite the buckets of the first 4000 projects."""
    target, updates, stages, blocks = milestone_tables(spark, sf_dir)
    stored = i.MilestoneTable(spark, scratch_path(spark, "milestones"))
    stored.write(target)
    stored.upsert(updates, stages, blocks)
    return stored.read()


@query("i12_upsert_milestone_failed", (), MILES + " SELECT project_id, event_type, ts, seq, CASE WHEN block IS NULL THEN 'no mapping' ELSE 'block is not unique' END AS reason FROM hit WHERE block_id IS NULL")
def i12_failed(spark, sf_dir):
    return milestones(spark, sf_dir)[1]


DECIDED = CTX + """, dec AS (SELECT *, CASE WHEN NOT (parse_complete OR ext_id IS NOT NULL OR (coalesce(customer_name, '') <> '' AND coalesce(address, '') <> '')) THEN 'unidentified'
 WHEN ambiguous THEN 'ambiguous' WHEN event_type = 'New Comment' AND NOT found THEN 'comment on unknown project' WHEN event_type = 'New Comment' AND comment_text IS NULL THEN 'comment without text'
 WHEN event_type = 'New Comment' THEN 'comment' WHEN event_type = 'HIC Executed' AND NOT found THEN 'milestone of unknown project' WHEN event_type = 'HIC Executed' THEN 'milestone'
 WHEN event_type = 'Estimate Complete' AND {phase} = 0 THEN 'informational in this phase' WHEN event_type = 'Estimate Complete' AND found THEN 'project exists' WHEN event_type = 'Estimate Complete' AND tracking_url IS NOT NULL THEN 'create by link'
 WHEN event_type = 'Estimate Complete' THEN 'create without link' WHEN event_type = 'New Task' THEN 'prompt for a person' ELSE 'no rule' END AS rule FROM ctx),
 decided AS (SELECT *, CASE rule WHEN 'comment' THEN 'append_note' WHEN 'milestone' THEN 'update_milestone' WHEN 'informational in this phase' THEN 'ignore' WHEN 'project exists' THEN 'noop_project_exists'
 WHEN 'create by link' THEN 'create_project' WHEN 'prompt for a person' THEN 'ignore' WHEN 'no rule' THEN 'ask_model' ELSE 'escalate' END AS action,
 CASE WHEN rule IN ('comment', 'milestone', 'project exists') THEN CAST(project_id AS VARCHAR) WHEN rule = 'create by link' THEN tracking_url END AS target,
 rule IN ('unidentified', 'ambiguous', 'comment on unknown project', 'comment without text', 'milestone of unknown project', 'create without link') AS needs_human,
 CASE WHEN rule = 'no rule' THEN 'model' ELSE 'rule' END AS source, CASE WHEN rule = 'comment' THEN '[Source] ' || comment_text || CASE WHEN len(regexp_extract_all(comment_text, '@([A-Za-z][A-Za-z0-9_]+)', 1)) > 0
 THEN chr(10) || '(Mentions: ' || array_to_string(regexp_extract_all(comment_text, '@([A-Za-z][A-Za-z0-9_]+)', 1), ', ') || ')' ELSE '' END END AS note_text, CASE WHEN rule = 'create by link' THEN tracking_url END AS link FROM dec)"""
DECIDED1 = DECIDED.replace("{phase}", "1")
NOTED = """ SELECT message_id, project_id, '[Source] ' || comment_text || CASE WHEN len(names) > 0 THEN chr(10) || '(Mentions: ' || array_to_string(names, ', ') || ')' ELSE '' END AS content_text
 FROM (SELECT *, regexp_extract_all(comment_text, '@([A-Za-z][A-Za-z0-9_]+)', 1) AS names FROM decided WHERE action = 'append_note') n"""


def decided(spark, sf_dir, phase=1):
    return d.decide(resolved(spark, sf_dir), phase)


@query("i13_append_note", V, DECIDED1 + NOTED)
def i13(spark, sf_dir):
    notes = decided(spark, sf_dir).where(F.col("action") == "append_note")
    return i.append_note(notes, 7, "[Source] ").select("message_id", "project_id", "content_text")


@query("i14_dry_run", V, DECIDED1 + NOTED.replace(" AS content_text", " AS content_text, true AS dry_run, 'planned' AS outcome"))
def i14(spark, sf_dir):
    notes = decided(spark, sf_dir).where(F.col("action") == "append_note")
    return i.dry_run(i.append_note(notes, 7, "[Source] "), 7).select("message_id", "project_id", "content_text", "dry_run", "outcome")


@query("i15_outcome_by_key", P, PLAN + " SELECT status, created_entity, created_project, created_link, count(*) AS proposals FROM plan GROUP BY ALL")
def i15(spark, sf_dir):
    return i.outcome_by_key(plan(spark, sf_dir))


R_COLS = ("message_id", "action", "target", "rule", "needs_human", "source", "note_text", "link")


@query("r01_decide_phase0", V, DECIDED.replace("{phase}", "0") + f" SELECT {', '.join(R_COLS)} FROM decided")
def r01_phase0(spark, sf_dir):
    return decided(spark, sf_dir, phase=0).select(*R_COLS)


@query("r01_decide_phase1", V, DECIDED1 + f" SELECT {', '.join(R_COLS)} FROM decided")
def r01_phase1(spark, sf_dir):
    return decided(spark, sf_dir).select(*R_COLS)


@query("r02_ignore_shortcut", V, CTX + """ SELECT message_id, CASE WHEN event_type = 'New Task' THEN 0 ELSE candidate_count END AS candidate_count,
 CASE WHEN event_type <> 'New Task' THEN project_id END AS project_id, event_type <> 'New Task' AND found AS found FROM ctx""")
def r02(spark, sf_dir):
    rows = d.ignore_shortcut(events(spark, sf_dir), projects(spark, sf_dir))
    return rows.select("message_id", "candidate_count", "project_id", "found")


@query("r03_fetch_gate", V, CTX + """ SELECT message_id, event_type <> 'New Task' AND tracking_url IS NOT NULL AND (NOT found OR ambiguous) AS will_fetch,
 CASE WHEN event_type = 'New Task' THEN 'ignored type' WHEN tracking_url IS NOT NULL AND ambiguous THEN 'fetch: several candidates' WHEN tracking_url IS NOT NULL AND NOT found THEN 'fetch: not found'
 ELSE 'skip: ' || concat_ws('; ', CASE WHEN tracking_url IS NULL THEN 'no link' END, CASE WHEN found AND NOT ambiguous THEN 'already resolved' END) END AS gate FROM ctx""")
def r03(spark, sf_dir):
    return d.fetch_gate(resolved(spark, sf_dir)).select("message_id", "will_fetch", "gate")


@query("r04_merge_fetched", V, EV + ", " + LOOKUPS + """, merged AS (SELECT * REPLACE (CASE WHEN tracking_url IS NOT NULL THEN 'x' || CAST(message_id * 4 % 3000 AS VARCHAR) ELSE ext_id END AS ext_id,
 CASE WHEN tracking_url IS NOT NULL AND message_id % 2 = 0 THEN 'Ann Lee' ELSE customer_name END AS customer_name), coalesce(tracking_url IS NOT NULL AND message_id % 5 < 3, false) AS is_accepted FROM ev),
 """ + context_sql("merged", "ctx") + " SELECT message_id, ext_id, customer_name, is_accepted, candidate_count, project_id FROM ctx")
def r04(spark, sf_dir):
    context = resolved(spark, sf_dir)
    fetched = context.where(F.col("tracking_url").isNotNull()).select(
        "message_id",
        F.concat(F.lit("x"), (F.col("message_id") * 4 % 3000).cast("string")).alias("fetched_ext_id"),
        F.when(F.col("message_id") % 2 == 0, "Ann Lee").alias("full_name"),
        F.lit(None).cast("string").alias("street_address"),
        (F.col("message_id") % 5 < 3).alias("is_accepted"),
    )
    rows = d.merge_fetched(context, fetched, projects(spark, sf_dir))
    return rows.select("message_id", "ext_id", "customer_name", "is_accepted", "candidate_count", "project_id")


ROUTED = DECIDED1 + """, flags AS (SELECT *, message_id % 2 = 0 AS forwarded, message_id % 5 <> 0 AS fetched, message_id % 7 < 4 AS accepted, message_id % 11 <> 0 AS online, message_id % 13 <> 0 AS plan_ok FROM decided),
 routed AS (SELECT *, CASE WHEN action = 'ignore' THEN 'ignored' WHEN action = 'noop_project_exists' THEN 'project exists' WHEN needs_human AND forwarded THEN 'escalated and forwarded'
 WHEN needs_human THEN 'escalated' WHEN NOT online THEN 'offline' WHEN action = 'append_note' THEN 'note appended' WHEN action = 'update_milestone' THEN 'milestone set'
 WHEN action = 'create_project' AND NOT fetched THEN 'nothing fetched' WHEN action = 'create_project' AND NOT accepted THEN 'not accepted' WHEN action = 'create_project' AND plan_ok THEN 'project ensured'
 WHEN action = 'create_project' THEN 'plan failed' ELSE 'unsupported action' END AS detail FROM flags)"""


def routed(spark, sf_dir):
    rows = decided(spark, sf_dir).withColumns(
        {
            "forwarded": F.col("message_id") % 2 == 0,
            "fetched_ext_id": F.when(F.col("message_id") % 5 != 0, "o1"),
            "is_accepted": F.col("message_id") % 7 < 4,
            "crm_online": F.col("message_id") % 11 != 0,
            "plan_ok": F.col("message_id") % 13 != 0,
        }
    )
    return d.route_actions(rows, ("HIC Executed", "Install Date"))


@query("r05_route_actions", V, ROUTED + """, ends AS (SELECT *, CASE WHEN detail IN ('offline', 'note appended', 'milestone set', 'nothing fetched') THEN NULL
 WHEN detail IN ('plan failed', 'unsupported action') THEN 'error' ELSE 'ok' END AS ledger_status FROM routed)
 SELECT message_id, detail, ledger_status, detail NOT IN ('nothing fetched', 'plan failed', 'unsupported action') AS write_ok, CASE ledger_status
 WHEN 'ok' THEN '{"action":"' || action || '","source":"' || source || '","reasoning":"' || rule || '"' || CASE WHEN project_id IS NULL THEN '' ELSE ',"project_id":"' || project_id || '"' END || '}'
 WHEN 'error' THEN '{"source":"' || source || '","reasoning":"' || rule || '","error":"' || detail || ' ' || action || '"}' END AS metadata FROM ends""")
def r05(spark, sf_dir):
    return routed(spark, sf_dir).select("message_id", "detail", "ledger_status", "write_ok", "metadata")


@query("r06_visibility", V, ROUTED + " SELECT message_id, NOT ((action = 'escalate' AND NOT forwarded) OR (action = 'ignore' AND source <> 'rule')) AS cleared FROM routed")
def r06(spark, sf_dir):
    return d.visibility(routed(spark, sf_dir)).select("message_id", "cleared")


@query("r07_decision_tallies", V, DECIDED1 + """ SELECT 'action' AS kind, action AS value, count(*) AS n FROM decided GROUP BY action UNION ALL SELECT 'source', source, count(*) FROM decided GROUP BY source
 UNION ALL SELECT 'all', 'decisions', count(*) FROM decided UNION ALL SELECT 'all', 'escalations', count(*) FROM decided WHERE needs_human OR action = 'escalate'""")
def r07(spark, sf_dir):
    return d.decision_tallies(decided(spark, sf_dir))


@query("r08_parse_model_decision", ("model_replies",), """j AS (SELECT item_id, attempt, reply, CASE WHEN json_valid(reply) THEN json_extract_string(reply, '$.action') END AS act FROM model_replies)
 SELECT item_id, attempt, coalesce(act, 'escalate') AS action, CASE WHEN act IS NOT NULL THEN '' WHEN reply = '' THEN 'empty reply' WHEN NOT json_valid(reply) THEN 'not JSON' ELSE 'no action' END AS reasoning,
 act IS NULL AS needs_human, 'model' AS source FROM j""")
def r08(spark, sf_dir):
    fenced = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("reply"), F.lit("\n```"))).otherwise(F.col("reply"))
    replies = view(spark, sf_dir, "model_replies").withColumn("reply", fenced)
    return d.parse_model_decision(replies).drop("target")


X = ("capture_docs",)
PIVOT = """piv AS (SELECT project_id, first(doc_id ORDER BY arrival) FILTER (WHERE envelope = 'init' AND type = 'custom.order1') AS ext_id, first(payload ORDER BY arrival) FILTER (WHERE envelope = 'init' AND type = 'custom.order1') AS o,
 first(doc_id ORDER BY arrival) FILTER (WHERE type = 'custom.homeowner') AS person_ref, first(payload ORDER BY arrival) FILTER (WHERE type = 'custom.homeowner') AS h,
 first(payload ORDER BY arrival) FILTER (WHERE type = 'custom.hic') AS c, first(payload ORDER BY arrival) FILTER (WHERE type = 'custom.job1') AS j, count(*) AS docs FROM capture_docs GROUP BY project_id
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM orders WHERE o_orderkey NOT IN (SELECT project_id FROM capture_docs)),
 ext AS (SELECT *, CASE WHEN docs = 0 THEN 'no response' WHEN ext_id IS NULL AND h IS NULL THEN 'neither order nor person document' END AS error, TRY_CAST(o->>'$.price' AS DOUBLE) AS estimated_price,
 CASE WHEN TRY_CAST(o->>'$.markup' AS DOUBLE) = 0 OR o->>'$.markup' IS NULL THEN TRY_CAST(o->>'$.markup_alt' AS DOUBLE) ELSE TRY_CAST(o->>'$.markup' AS DOUBLE) END AS markup,
 regexp_replace(o->>'$.rep', '^.*__LOOKUP__', '') AS sales_rep_ref, h->>'$.stage' AS person_stage, h->>'$.copy' AS portal_code, h->>'$.email' AS email, c->>'$.status' AS contract_status,
 TRY_CAST(j->>'$.contract_price' AS DOUBLE) AS actual_contract_price, j->>'$.status' AS job_status FROM piv),
 acc AS (SELECT *, error IS NULL AND (coalesce(contract_status = 'executed', false) OR coalesce(job_status, '') <> '' OR coalesce(person_stage = 'customer', false)) AS is_accepted FROM ext)"""


@query("x01_extract_proposal", X, PIVOT + """ SELECT project_id, error, ext_id, estimated_price, markup, sales_rep_ref, person_ref, person_stage, portal_code, email,
 contract_status, actual_contract_price, job_status, is_accepted FROM acc""")
def x01(spark, sf_dir):
    return extracted(spark, sf_dir).select(
        "project_id", "error", "ext_id", "estimated_price", "markup", "sales_rep_ref", "person_ref", "person_stage", "portal_code",
        "email", "contract_status", "actual_contract_price", "job_status", "is_accepted",
    )


@query("x02_strip_lookup", X, """SELECT doc_id, CASE WHEN contains(rep, '__LOOKUP__') THEN nullif(substr(rep, strpos(rep, '__LOOKUP__') + 10), '') ELSE nullif(rep, '') END AS ref
 FROM (SELECT doc_id, CASE WHEN project_id % 5 = 0 THEN 'a__LOOKUP__' ELSE payload->>'$.rep' END AS rep FROM capture_docs WHERE type = 'custom.order1') t""")
def x02(spark, sf_dir):
    docs = view(spark, sf_dir, "capture_docs").where(F.col("type") == "custom.order1")
    rep = F.when(F.col("project_id") % 5 == 0, "a__LOOKUP__").otherwise(F.get_json_object("payload", "$.rep"))
    return docs.withColumn("rep", rep).select("doc_id", x.strip_lookup(F.col("rep")).alias("ref"))


@query("x03_acceptance", X, PIVOT + """ SELECT project_id, is_accepted, c IS NOT NULL AS contract_present, coalesce(contract_status = 'executed', false) AS contract_executed, false AS signature_present,
 j IS NOT NULL AS job_present, job_status, person_stage, false AS warranty_present FROM acc""")
def x03(spark, sf_dir):
    return extracted(spark, sf_dir).select("project_id", "is_accepted", "acceptance_signals.*")


@query("x04_payload_projection", X, PIVOT + """ SELECT project_id, ext_id, is_accepted, email, contract_status AS hic_status, actual_contract_price AS contract_price, job_status, person_ref, error FROM acc""")
def x04(spark, sf_dir):
    return x.payload_projection(extracted(spark, sf_dir)).select(
        "project_id", "ext_id", "is_accepted", "email", "hic_status", "contract_price", "job_status", "person_ref", "error"
    )
