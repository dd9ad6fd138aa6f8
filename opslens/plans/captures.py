"""Registered capture, source, hygiene and audit queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from opslens.operators import audit as au
from opslens.operators import captures as c
from opslens.operators import hygiene, usage
from opslens.operators.jobs import job_snapshot
from opslens.operators.proposals import ORDER
from opslens.plans.registry import query
from opslens.plans.usage import nested_logs
from opslens.plans.views import table, view
from opslens.session import materialize
from opslens.session import scratch_path as scratch
from opslens.sources import audit_sink, inventory, logs
from opslens.sources.docs import read_docs
from opslens.sources.folders import write_folders

C = ("captures",)
PATTERNS = ("/fr/", "/en/", r"\.org/")
GEN = """gens AS (SELECT *, CAST(sum(CASE WHEN is_load THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY arrival) AS BIGINT) AS gen FROM captures),
dedup AS (SELECT * FROM gens WHERE body IS NOT NULL QUALIFY seq IS NULL OR row_number() OVER (PARTITION BY session_id, gen, seq ORDER BY arrival) = 1),
bucketed AS (SELECT *, CASE WHEN url LIKE '%/fr/%' THEN '/fr/' WHEN url LIKE '%/en/%' THEN '/en/' WHEN url LIKE '%.org/%' THEN '\\.org/' END AS pattern FROM dedup)"""


def captures(spark, sf_dir):
    return view(spark, sf_dir, "captures")


def unique_captures(spark, sf_dir):
    return c.dedup_captures(captures(spark, sf_dir), cut=lambda narrow: materialize(narrow, "narrow-captures"))


@query("c01_doc_generation", C, GEN + " SELECT session_id, arrival, gen FROM gens")
def c01(spark, sf_dir):
    narrow = materialize(captures(spark, sf_dir).select("session_id", "arrival", "is_load"), "narrow-captures")
    return c.doc_generation(narrow).select("session_id", "arrival", "gen")


@query("c02_dedup_captures", C, GEN + " SELECT session_id, gen, arrival, path, seq, url, md5(body) AS body_md5 FROM dedup")
def c02(spark, sf_dir):
    rows = unique_captures(spark, sf_dir)
    return rows.select("session_id", "gen", "arrival", "path", "seq", "url", F.md5("body").alias("body_md5"))


@query("c03_url_filter", C, "SELECT arrival, url FROM captures WHERE url LIKE '%/fr/%' OR url LIKE '%.org/%'")
def c03(spark, sf_dir):
    return c.url_filter(captures(spark, sf_dir), ["/fr/", r"\.org/"]).select("arrival", "url")


@query("c04_bucket_first_match", C, GEN + " SELECT session_id, arrival, pattern FROM bucketed WHERE pattern IS NOT NULL")
def c04(spark, sf_dir):
    return c.bucket_first_match(unique_captures(spark, sf_dir), PATTERNS).select("session_id", "arrival", "pattern")


@query("c05_cap_per_bucket", C, GEN + """ SELECT session_id, arrival, pattern, rn FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pattern ORDER BY arrival) AS rn
 FROM bucketed WHERE pattern IS NOT NULL) b WHERE rn <= 5""")
def c05(spark, sf_dir):
    bucketed = c.bucket_first_match(unique_captures(spark, sf_dir), PATTERNS)
    return c.cap_per_bucket(bucketed, 5).select("session_id", "arrival", "pattern", "rn")


@query("c06_captures_in_window", ("job_events",), """starts AS (SELECT job_id, min(ts) AS start_ts FROM job_events GROUP BY job_id)
 SELECT job_id, seq, ts FROM job_events JOIN starts USING (job_id) WHERE ts >= start_ts AND ts < start_ts + INTERVAL 864000 SECOND""")
def c06(spark, sf_dir):
    events = view(spark, sf_dir, "job_events")
    jobs = job_snapshot(events).select("job_id", F.col("created_at").alias("start_ts"))
    return c.captures_in_window(events, jobs, 864_000).select("job_id", "seq", "ts")


@query("c07_seen_urls", C, GEN + " SELECT session_id, url, count(*) AS hits, min(arrival) AS first_arrival FROM dedup GROUP BY session_id, url")
def c07(spark, sf_dir):
    return c.seen_urls(unique_captures(spark, sf_dir))


@query("c08_login_wall", C, """SELECT arrival, (seq % 9 = 0 AND seq IS NOT NULL) OR (arrival % 10 = 0) OR (arrival % 7 = 1) AS wall, url LIKE '%.org/%' AS on_login_page FROM captures""")
def c08(spark, sf_dir):
    status = F.when(F.col("seq") % 9 == 0, "waiting_login").when(F.col("seq") > 5, "done")
    error = F.when(F.col("arrival") % 10 == 0, "The LOGIN page came up")
    wall = c.login_wall(status, error, F.col("arrival") % 7 == 1)
    return captures(spark, sf_dir).select("arrival", wall.alias("wall"), c.is_login_url(F.col("url"), [r"\.org/"]).alias("on_login_page"))


def init_bodies(spark, sf_dir):
    """Two or three hydration bodies per order; the last one often lacks the order entry."""
    key = F.col("o_orderkey")
    order_body = F.concat(F.lit('[{"type":"user"},{"type":"custom.order1","id":"'), key.cast("string"), F.lit('"}]'))
    bodies = F.array(
        F.struct(F.lit(1).alias("arrival"), F.when(key % 9 != 0, order_body).otherwise('[{"type":"user"}]').alias("body")),
        F.struct(F.lit(2).alias("arrival"), F.when(key % 4 == 0, order_body).otherwise('[{"type":"home"}]').alias("body")),
        F.struct(F.lit(3).alias("arrival"), F.when(key % 3 != 0, F.lit("{}")).alias("body")),
    )
    return table(spark, sf_dir, "orders").select(key.alias("project_id"), F.explode(bodies).alias("b")).select("project_id", "b.*")


@query("c09_pick_init_body", (), """SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 9 <> 0 THEN 1 WHEN o_orderkey % 3 <> 0 THEN 3 ELSE 2 END AS arrival,
 CASE WHEN o_orderkey % 3 <> 0 THEN 3 ELSE 2 END AS bodies FROM orders""")
def c09(spark, sf_dir):
    return c.pick_init_body(init_bodies(spark, sf_dir), ORDER).select("project_id", "arrival", "bodies")


@query("c10_doc_type_counts", ("capture_docs",), "SELECT coalesce(type, '?') AS type, count(*) AS docs FROM capture_docs GROUP BY 1")
def c10(spark, sf_dir):
    return c.doc_type_counts(view(spark, sf_dir, "capture_docs"))


@query("c11_first_doc_by_type", ("capture_docs",), """SELECT project_id, type, arrival, doc_id, payload FROM capture_docs WHERE type IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY project_id, type ORDER BY arrival) = 1""")
def c11(spark, sf_dir):
    return c.first_doc_by_type(view(spark, sf_dir, "capture_docs"))


def nested_bodies(spark, sf_dir):
    """Order payloads wrapped in other objects, one of them a project inside a project."""
    key = F.col("o_orderkey").cast("string")
    inner = F.concat(F.lit('{"Project ID":"'), key, F.lit('","Project Name":"in"}'))
    outer = F.concat(F.lit('{"rows":[1,{"x":['), inner, F.lit(']}],"page":{"Project ID":"o'), key, F.lit('","Project Name":null,"child":'), inner, F.lit("}}"))
    body = F.when(F.col("o_orderkey") % 5 == 0, '{"Project ID":1}').when(F.col("o_orderkey") % 7 == 0, "not json").otherwise(outer)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), body.alias("body"))


@query("c12_find_shapes", (), """hits AS (SELECT o_orderkey AS project_id, CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
 SELECT project_id, 0 AS ord, 4 AS depth, k AS found_id FROM hits UNION ALL SELECT project_id, 1, 1, 'o' || k FROM hits UNION ALL SELECT project_id, 2, 2, k FROM hits""")
def c12(spark, sf_dir):
    shapes = c.find_shapes(nested_bodies(spark, sf_dir), "body", ("Project ID", "Project Name"))
    return shapes.select("project_id", "ord", "depth", F.get_json_object("object", "$['Project ID']").alias("found_id"))


@query("c13_json_only", ("model_replies",), "SELECT item_id, attempt, json_valid(reply) AS is_json FROM model_replies")
def c13(spark, sf_dir):
    return c.json_only(view(spark, sf_dir, "model_replies"), "reply").select("item_id", "attempt", "is_json")


def written_logs(spark, sf_dir, broken=False):
    """The turns as JSON lines in one folder per project, read back by the log reader."""
    path = scratch(spark, "logs")
    line = F.to_json(F.struct("timestamp", "cwd", "message"))
    if broken:
        line = F.when(F.col("turn_id") % 97 == 0, '{"timestamp": broken').when(F.col("turn_id") % 89 == 0, "  ").otherwise(line)
    rows = nested_logs(spark, sf_dir).select("project", "turn_id", line.alias("value"))
    write_folders(rows, path, "turns.txt", "project", "turn_id")
    return logs.read_session_logs(spark, path, "*.txt")


@query("s01_read_session_logs", ("usage_turns",), """SELECT project, ts, cwd, output_tokens FROM usage_turns WHERE output_tokens <> 0""")
def s01(spark, sf_dir):
    return usage.flatten_usage(written_logs(spark, sf_dir)).select("project", "ts", "cwd", "output_tokens")


@query("s02_quarantine_bad_lines", ("usage_turns",), """SELECT 'bad' AS kind, project, count(*) AS lines FROM usage_turns WHERE turn_id % 97 = 0 GROUP BY project
 UNION ALL SELECT 'good', project, count(*) FROM usage_turns WHERE turn_id % 97 <> 0 AND turn_id % 89 <> 0 GROUP BY project""")
def s02(spark, sf_dir):
    good, bad = logs.quarantine_bad_lines(written_logs(spark, sf_dir, broken=True))
    kinds = good.select(F.lit("good").alias("kind"), "project").unionByName(bad.select(F.lit("bad").alias("kind"), "project"))
    return kinds.groupBy("kind", "project").agg(F.count("*").alias("lines"))


@query("s02_stop_at_first_bad", ("usage_turns",), """f AS (SELECT project, min(turn_id) AS b FROM usage_turns WHERE turn_id % 97 = 0 GROUP BY project)
 SELECT project, count(*) AS lines FROM usage_turns LEFT JOIN f USING (project) WHERE (b IS NULL OR turn_id < b) AND turn_id % 89 <> 0 GROUP BY project""")
def s02_strict(spark, sf_dir):
    kept, _ = logs.quarantine_bad_lines(written_logs(spark, sf_dir, broken=True), "stop_at_first_bad")
    return kept.groupBy("project").agg(F.count("*").alias("lines"))


@query("s04_file_inventory", (), """SELECT 'folder=' || CAST(page_id // 16 AS VARCHAR) AS name, CAST(sum(strlen(html) + 1) + CASE WHEN page_id // 16 % 7 < 3 THEN 9 ELSE 0 END AS BIGINT) AS size_bytes, CASE WHEN page_id // 16 % 7 < 3 THEN 2 ELSE 1 END AS filled_files,
 page_id // 16 % 7 < 3 AS marker_present, true AS present FROM pages GROUP BY page_id // 16""")
def s04(spark, sf_dir):
    """The pages as files in folders of sixteen, three of seven of which get a marker file."""
    path = scratch(spark, "files")
    rows = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 16).alias("folder"), F.col("html").alias("value"))
    write_folders(rows, path, "pages.txt", "folder")
    marks = rows.where("folder % 7 < 3").select("folder", F.to_json(F.struct(F.lit(1).alias("ok"))).alias("value")).distinct()
    write_folders(marks, path, "ok.json", "folder")
    return inventory.file_inventory(spark, path, r"^folder=\d+$", marker=r"^[^/]*\.json$")


AU = ("audit",)


def audit(spark, sf_dir):
    return view(spark, sf_dir, "audit")


@query("s05_append_audit", AU, """SELECT date_trunc('second', ts) AS timestamp, stage, action, ok, substr(detail || repeat('x', 600), 1, 500) AS detail, '' AS event_type, project_ref FROM audit""")
def s05(spark, sf_dir):
    path = scratch(spark, "audit")
    rows = audit(spark, sf_dir).select(
        F.col("ts").alias("timestamp"), "stage", "action", "ok", F.concat("detail", F.repeat(F.lit("x"), 600)).alias("detail"), "project_ref"
    )
    audit_sink.append_audit(rows.where("ok"), path)
    audit_sink.append_audit(rows.where("NOT ok"), path)
    return audit_sink.read_audit(spark, path)


@query("s06_read_docs", ("capture_docs",), "SELECT project_id, type, doc_id, payload FROM capture_docs WHERE envelope = 'mget'")
def s06(spark, sf_dir):
    docs = view(spark, sf_dir, "capture_docs")
    kind = F.coalesce(F.concat(F.lit('"'), F.col("type"), F.lit('"')), F.lit("null"))
    body = F.concat(F.lit('{"docs":[{"_id":"'), F.col("doc_id"), F.lit('","_type":'), kind, F.lit(',"_source":'), F.col("payload"), F.lit("}]}"))
    responses = docs.select("project_id", F.concat(F.lit("https://h/"), F.col("envelope")).alias("url"), body.alias("body"))
    return read_docs(responses, "/mget$").select("project_id", "type", "doc_id", "payload")


def host_table(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)
    hosts = table(spark, sf_dir, "pages").select(host.alias("host")).distinct()
    size = F.length("host")
    address = (
        F.when(size % 5 == 0, F.concat(F.lit("10.1.2."), size.cast("string")))
        .when(size % 5 == 1, F.concat(F.lit("172."), (size % 40).cast("string"), F.lit(".0.1")))
        .when(size % 5 < 4, F.concat(F.lit("93.184.0."), size.cast("string")))
    )
    return hosts.withColumn("address", address)


@query("h01_screen_urls", (), """h AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'ftp' ELSE regexp_extract(url, '^([a-z]+)://', 1) END AS scheme, CASE WHEN page_id % 10 = 3 THEN '127.0.0.1' WHEN page_id % 10 = 4 THEN 'fe80::1'
 WHEN page_id % 10 = 5 THEN '2001:db8::5' ELSE regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) END AS host FROM pages),
 a AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') OR contains(host, ':') THEN host WHEN length(host) % 5 = 0 THEN '10.1.2.' || length(host) WHEN length(host) % 5 = 1 THEN '172.' || length(host) % 40 || '.0.1'
 WHEN length(host) % 5 < 4 THEN '93.184.0.' || length(host) END AS address FROM h),
 n AS (SELECT *, CASE WHEN contains(address, '.') THEN CAST(split_part(address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(address, '.', 2) AS BIGINT) * 65536 + CAST(split_part(address, '.', 3) AS BIGINT) * 256 + CAST(split_part(address, '.', 4) AS BIGINT) END AS num FROM a)
 SELECT page_id, host, address, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme not allowed' WHEN address IS NULL THEN 'host not resolved'
 WHEN num BETWEEN 167772160 AND 184549375 OR num BETWEEN 2886729728 AND 2887778303 OR num BETWEEN 2130706432 AND 2147483647 OR address = 'fe80::1' THEN 'blocked network' ELSE 'ok' END AS outcome FROM n""")
def h01(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)
    digit = F.col("page_id") % 10
    url = (
        F.when(digit == 0, F.regexp_replace("url", "^[a-z]+", "FTP"))
        .when(digit == 3, F.concat(F.lit("HTTP://user@127.0.0.1:80"), rest))
        .when(digit == 4, F.concat(F.lit("http://[fe80::1]"), rest))
        .when(digit == 5, F.concat(F.lit("http://[2001:db8::5]:8080"), rest))
        .otherwise(F.col("url"))
    )
    screened = hygiene.screen_urls(pages.select("page_id", url.alias("url")), host_table(spark, sf_dir))
    return screened.select("page_id", "host", "address", "outcome")


@query("h01_screen_urls_block_table", ("net_urls", "net_blocks"), r"""b AS (SELECT network, blocked, split_part(network, '/', 1) AS ip, CAST(split_part(network, '/', 2) AS INTEGER) AS len FROM net_blocks),
 b4 AS (SELECT len, (CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT)) >> (32 - len) AS lead,
 min(network) AS network, bool_or(blocked) AS blocked FROM b WHERE NOT contains(ip, ':') GROUP BY 1, 2),
 b6 AS (SELECT len, ip, min(network) AS network, bool_or(blocked) AS blocked FROM b WHERE contains(ip, ':') GROUP BY 1, 2),
 u AS (SELECT page_id, regexp_extract(url, '^http://\[?([0-9a-f.:]+)', 1) AS address FROM net_urls),
 n AS (SELECT address, CAST(split_part(address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(address, '.', 2) AS BIGINT) * 65536 + CAST(split_part(address, '.', 3) AS BIGINT) * 256 + CAST(split_part(address, '.', 4) AS BIGINT) AS num
 FROM (SELECT DISTINCT address FROM u WHERE NOT contains(address, ':')) d),
 asked AS (SELECT address, len, num >> (32 - len) AS lead FROM n CROSS JOIN (SELECT DISTINCT len FROM b4) l),
 hits AS (SELECT address, network, blocked, len FROM asked JOIN b4 USING (len, lead)
 UNION ALL SELECT address, network, blocked, len FROM u JOIN b6 ON len = 128 AND ip = address UNION ALL SELECT address, network, blocked, len FROM u JOIN b6 ON len = 32 AND contains(address, ':')),
 best AS (SELECT address, arg_max(network, len) AS block, arg_max(blocked, len) AS stops FROM hits GROUP BY 1)
 SELECT page_id, address, block, CASE WHEN stops THEN 'blocked network' ELSE 'ok' END AS outcome FROM u LEFT JOIN best USING (address)""")
def h01_table(spark, sf_dir):
    """Forty networks a page; the longest that holds an address decides."""
    nowhere = spark.createDataFrame([], "host STRING, address STRING")
    screened = hygiene.screen_urls(view(spark, sf_dir, "net_urls"), nowhere, view(spark, sf_dir, "net_blocks"))
    return screened.select("page_id", "address", "block", "outcome")


@query("h02_audit_counts", AU, "SELECT stage, action, ok, count(*) AS rows FROM audit GROUP BY stage, action, ok")
def h02(spark, sf_dir):
    return au.audit_counts(audit(spark, sf_dir))


@query("h03_audit_coverage", AU, """f AS (SELECT project_ref || '-' || CAST(event_id % 7 AS VARCHAR) AS decision, bool_or(stage = 'parser') AS has_parser, bool_or(stage = 'brain') AS has_brain, bool_or(stage = 'orchestrator') AS has_orchestrator
 FROM audit GROUP BY 1) SELECT *, has_parser AND has_brain AND has_orchestrator AS complete FROM f""")
def h03(spark, sf_dir):
    decision = F.concat("project_ref", F.lit("-"), (F.col("event_id") % 7).cast("string"))
    return au.audit_coverage(audit(spark, sf_dir).withColumn("decision", decision), key="decision")


@query("h04_render_logfmt", AU, """SELECT event_id, concat_ws(' ', 'stage=' || stage, 'action=' || action, 'ok=' || CAST(ok AS VARCHAR), CASE WHEN event_id % 3 = 0 THEN 'detail="' || detail || ' tokens"' WHEN event_id % 3 = 1 THEN 'detail=' || detail END,
 'project_ref=' || project_ref) AS line FROM audit""")
def h04(spark, sf_dir):
    detail = F.when(F.col("event_id") % 3 == 0, F.concat("detail", F.lit(" tokens"))).when(F.col("event_id") % 3 == 1, F.col("detail")).otherwise("")
    rows = audit(spark, sf_dir).withColumn("detail", detail)
    line = au.render_logfmt(("stage", "action", "ok", "detail", "project_ref"), dict(rows.dtypes))
    return rows.select("event_id", line.alias("line"))


@query("h05_tail", AU, """SELECT stage, event_id, back FROM (SELECT stage, event_id, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, event_id DESC) AS back FROM audit) t WHERE back <= 200""")
def h05(spark, sf_dir):
    return au.tail(audit(spark, sf_dir), 200).select("stage", "event_id", "back")
