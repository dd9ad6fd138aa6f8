"""Operational tables derived from the given Parquet tables, in SQL that both engines run.

Only a few tokens differ by engine; they are replaced by `spark_sql` and `duck_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_SPARK = {
    "__K__": "CAST(get_json_object(props,'$.k') AS BIGINT)",
    "__AGG__": "listagg(b, ',') WITHIN GROUP (ORDER BY event_id)",
    "__COPIES__": "LATERAL VIEW explode(array(1, 2)) a AS n",
    "__ATTEMPTS__": "LATERAL VIEW explode(array(1, 2, 3)) a AS attempt",
    "__KINDS__": "LATERAL VIEW explode(array('sharpness','exposure','vegetation','sky','water','text','faces','unheard')) k AS kind",
    "__LANES__": "LATERAL VIEW explode(sequence(0, 39)) a AS lane",
    "__RFC__": "date_format(ts, 'd MMM yyyy HH:mm:ss') || ' +0000'",
}
_DUCK = {
    "__K__": "CAST(json_extract_string(props,'$.k') AS BIGINT)",
    "__AGG__": "string_agg(b, ',' ORDER BY event_id)",
    "__COPIES__": "CROSS JOIN (VALUES (1), (2)) a(n)",
    "__ATTEMPTS__": "CROSS JOIN (VALUES (1), (2), (3)) a(attempt)",
    "__KINDS__": "CROSS JOIN (VALUES ('sharpness'),('exposure'),('vegetation'),('sky'),('water'),('text'),('faces'),('unheard')) k(kind)",
    "__LANES__": "CROSS JOIN (SELECT unnest(range(0, 40)) AS lane) a",
    "__RFC__": "strftime(ts, '%-d %b %Y %H:%M:%S') || ' +0000'",
}

_OWN = "(page_id % 1048573) * 104729 * 911 % 4294967296"


def _dotted(number: str) -> str:
    return " || '.' || ".join(f"CAST((({number}) >> {shift}) % 256 AS STRING)" for shift in (24, 16, 8, 0))


VIEWS: dict[str, str] = {
    # every page asks for an address of its own
    "net_urls": f"""
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'http://[2001:db8::' || CAST(page_id % 10000 AS STRING) || ']/p' ELSE 'http://' || {_dotted(_OWN)} || '/p' END AS url FROM pages""",
    # forty networks a page, some around its address, many nested
    "net_blocks": f"""
SELECT {_dotted("(b >> s) << s")} || '/' || CAST(32 - s AS STRING) AS network, lane % 3 <> 0 AS blocked
 FROM (SELECT lane, CAST(24 - (page_id + lane) % 25 AS INT) AS s, CASE WHEN lane < 4 THEN {_OWN} ELSE ((page_id % 1048573) * 40 + lane) * 7919 * 613 % 4294967296 END AS b FROM pages __LANES__) x
 UNION ALL SELECT '2001:db8::' || CAST(page_id % 10000 AS STRING) || '/128', true FROM pages WHERE page_id % 18 = 0
 UNION ALL SELECT '2001:db8::/32', false FROM pages WHERE page_id = 0""",
    "usage_turns": """
SELECT event_id AS turn_id, ts, 'home--proj-' || CAST(user_id AS STRING) AS project,
 CASE WHEN user_id % 5 = 0 THEN '' ELSE '/srv/team' || CAST(user_id % 7 AS STRING) || '/app-' || CAST(user_id AS STRING) || '/' END AS cwd,
 CAST(floor(value * 10) AS BIGINT) AS input_tokens, __K__ AS cache_creation_input_tokens,
 CASE WHEN event_type = 'view' THEN 2 * __K__ END AS cache_read_input_tokens,
 CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) + 1 END AS output_tokens FROM events""",
    # ten neighbouring events make one body, so no body grows with the table
    "api_bodies": """
SELECT g AS body_id, CASE g % 5
 WHEN 0 THEN '{"results":[' || __AGG__ || '],"data":[{"output_tokens":1}]}'
 WHEN 1 THEN '{"results":[{"output_tokens":0}],"items":[' || __AGG__ || ']}'
 WHEN 2 THEN '{"input_tokens":' || CAST(g * 10 AS STRING) || ',"uncached_input_tokens":3,"output_tokens":5}'
 WHEN 3 THEN '{"five_hour":{"utilization":' || CAST(g % 100 AS STRING) || '.5,"resets_at":"2024-01-31T12:00:00Z"},"extra_usage":' || CASE WHEN g % 2 = 0 THEN '7' ELSE '{"on":true}' END || '}'
 ELSE '{"other":1}' END AS body
 FROM (SELECT CAST((event_id - event_id % 10) / 10 AS BIGINT) AS g, event_id, '{"' || CASE WHEN event_id % 4 = 0 THEN 'from' ELSE 'start_time' END || '":"' || CAST(CAST(ts AS DATE) AS STRING) || 'T00:00:00Z","uncached_input_tokens":' || CAST(event_id % 3 AS STRING) || ',"input_tokens":7,"output_tokens":' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || ',"end_time":"' || CAST(CAST(ts AS DATE) AS STRING) || 'T23:59:59Z"}' AS b FROM events) e GROUP BY g""",
    "captures": """
SELECT page_id % 5 AS session_id, page_id * 2 AS arrival, 'push' AS path, CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id % 40 END AS seq,
 page_id % 50 < 5 AS is_load, url, CASE WHEN page_id % 13 = 0 THEN NULL ELSE html END AS body FROM pages WHERE page_id % 7 <> 0
 UNION ALL SELECT page_id % 5, page_id * 2 + 1, 'poll', CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id % 40 END, false, url, CASE WHEN page_id % 13 = 0 THEN NULL ELSE html END FROM pages""",
    "capture_docs": """
SELECT o_orderkey AS project_id, 1 AS arrival, 'init' AS envelope, 'custom.order1' AS type, 'o' || CAST(o_orderkey AS STRING) AS doc_id,
 '{"price":' || CASE WHEN o_orderkey % 10 = 0 THEN '"n/a"' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END || ',"markup":' || CAST(o_orderkey % 3 AS STRING) || ',"markup_alt":9,"rep":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'u1__LOOKUP__r' ELSE 'r' END || CAST(o_orderkey % 40 AS STRING) || '"}' AS payload FROM orders WHERE o_orderkey % 9 <> 0
 UNION ALL SELECT o_orderkey, 1 + a.n, 'mget', CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE 'custom.homeowner' END, 'c' || CAST(o_custkey AS STRING), '{"stage":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'customer' ELSE 'opportunity' END || '","copy":' || CAST(a.n AS STRING) || ',"email":"c' || CAST(o_custkey % 1200 AS STRING) || '@example.test","first":"Ann","last":"Lee ' || CAST(o_custkey AS STRING) || '"}' FROM orders __COPIES__ WHERE o_orderkey % 13 <> 0
 UNION ALL SELECT o_orderkey, 4, 'mget', 'custom.hic', 'h' || CAST(o_orderkey AS STRING), '{"status":"' || CASE WHEN o_orderkey % 8 = 0 THEN 'executed' ELSE 'sent' END || '"}' FROM orders WHERE o_orderkey % 4 = 0
 UNION ALL SELECT o_orderkey, 5, 'mget', 'custom.job1', 'j' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 6 = 0 THEN '{"status":"completed","contract_price":100}' ELSE '{"contract_price":100}' END FROM orders WHERE o_orderkey % 3 = 0""",
    "messages": """
SELECT m.message_id, m.sent_s, m.sender, m.prefix || p.p_name || CASE WHEN m.k % 5 = 0 THEN '  JR' ELSE '' END || ' - ' || CAST(m.k % 14000 AS STRING) || ' ' || p.p_type || ' Road' || CASE WHEN m.conv_id % 6 = 0 THEN ' (Reorder)' ELSE '.' END AS subject, m.body_text, m.body_html
 FROM (SELECT conv_id * 1000 + turn AS message_id, conv_id, conv_id * 60 + turn AS sent_s, conv_id * 137 + turn * 11 AS k, 1 + (conv_id * 137 + turn * 11) % (SELECT max(p_partkey) FROM part) AS part_key,
 CASE turn % 4 WHEN 0 THEN 'RFX | New Comment <no-reply@example.test>' WHEN 1 THEN 'RFX | Estimate Comp. <no-reply@example.test>' WHEN 2 THEN 'no-reply@example.test' ELSE 'RFX | HIC Executed <no-reply@example.test>' END AS sender,
 CASE turn % 4 WHEN 0 THEN 'New Project Comment - ' WHEN 1 THEN '' WHEN 2 THEN 'New Task - ' ELSE 'HIC Executed - ' END AS prefix,
 'Hello!' || chr(10) || CASE WHEN turn % 8 = 4 THEN '' ELSE '"' || text || ' @User_' || CAST(conv_id AS STRING) || '"' END AS body_text,
 CASE WHEN conv_id % 4 = 0 THEN '<a href="http://url12.example.test/ls/click?upn=' || CAST(conv_id AS STRING) || '">go</a>' END AS body_html FROM conversations) m
 JOIN part p ON p.p_partkey = m.part_key""",
    "crm_project": """
SELECT o.o_orderkey AS id, p.p_name || CASE WHEN o.o_orderkey % 5 = 0 THEN ' Jr' ELSE '' END AS project_name,
 CAST(o.o_orderkey % 14000 AS STRING) || ' ' || p.p_type || ' Road' AS street1, CASE WHEN o.o_orderkey % 4 = 0 THEN 'x' || CAST(o.o_orderkey % 3000 AS STRING) END AS ext_id,
 o.o_orderstatus = 'F' AS archived, CASE WHEN o.o_orderkey % 17 = 0 THEN 59 WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE 4 END AS status_id
 FROM (SELECT *, 1 + o_orderkey % (SELECT max(p_partkey) FROM part) AS part_key FROM orders) o JOIN part p ON p.p_partkey = o.part_key""",
    "crm_entity": """
SELECT c.c_custkey AS id, split_part(p.p_name, ' ', 1) AS first_name, split_part(p.p_name, ' ', 2) AS last_name,
 'C' || CAST(c.c_custkey % 1200 AS STRING) || '@example.test' AS email, CAST(c.c_custkey % 300 AS STRING) || ' ' || p.p_type || ' Road' AS street1,
 c.c_custkey % 23 = 0 AS archived, CASE WHEN c.c_custkey % 29 = 0 THEN 9 ELSE 8 END AS object_type_id
 FROM (SELECT *, 1 + c_custkey % (SELECT max(p_partkey) FROM part) AS part_key FROM customer) c JOIN part p ON p.p_partkey = c.part_key""",
    "crm_state": "SELECT n_nationkey AS id, n_name AS state_name, 'N' || CAST(n_nationkey AS STRING) AS abbreviation FROM nation",
    "ledger": """
SELECT 'msg-' || CAST(event_id % 3000 AS STRING) AS key, ts AS processed_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'pending' ELSE 'ok' END AS status, event_id AS seq, props AS metadata FROM events""",
    "job_events": """
SELECT 'job-' || CAST(event_id % 2500 AS STRING) AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS phase,
 CASE WHEN user_id % 2 = 0 THEN 'assess' ELSE 'compare' END AS job_type, value AS amount FROM events""",
    "scores": """
SELECT l_orderkey AS item_id, l_linenumber AS crit_no, CASE l_linenumber WHEN 1 THEN 'shelf labelled' WHEN 2 THEN 'Label Legible ' WHEN 3 THEN CASE WHEN max(l_partkey) % 5 = 0 THEN 'aisle fre' ELSE 'aisle free' END WHEN 4 THEN 'sharpness' WHEN 5 THEN 'proper exposure' WHEN 6 THEN CASE WHEN max(l_partkey) % 5 = 1 THEN 'has skyy' ELSE 'has sky' END ELSE 'unlisted' END AS returned_key,
 CASE WHEN max(l_partkey) % 29 = 0 THEN 'n/a' WHEN max(l_partkey) % 31 = 0 THEN '3.7' ELSE CAST(CAST(max(l_quantity) AS BIGINT) % 14 - 1 AS STRING) END AS raw_score, CAST(max(l_discount) * 1500 AS BIGINT) AS raw_confidence FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "measures": """
SELECT p_partkey AS item_id, k.kind AS kind, CASE k.kind WHEN 'faces' THEN CAST(p_partkey % 3 AS DOUBLE) WHEN 'sharpness' THEN CAST(p_partkey * 37 % 400 AS DOUBLE) WHEN 'exposure' THEN CAST(p_partkey * 13 % 256 AS DOUBLE) ELSE CAST(p_partkey * 7 % 100 AS DOUBLE) / 100 END AS measure, CASE k.kind WHEN 'faces' THEN CAST(p_partkey % 5 AS DOUBLE) END AS measure_low FROM part __KINDS__""",
    "model_replies": """
SELECT doc_id AS item_id, a.attempt AS attempt, CASE (doc_id + a.attempt) % 6 WHEN 0 THEN 'sorry' WHEN 1 THEN '{"assessment":{"overall_score":' || CAST(doc_id % 12 AS STRING) || '}}' WHEN 2 THEN 'Here: {"assessment":{"overall_score":4}} done' WHEN 3 THEN '{"action":"ignore","needs_human":false}' WHEN 4 THEN '' ELSE '{"x":1}' END AS reply FROM documents __ATTEMPTS__""",
    "audit": """
SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'parser' WHEN 'click' THEN 'brain' WHEN 'signup' THEN 'orchestrator' WHEN 'purchase' THEN 'phase2' ELSE 'escalate' END AS stage, event_type AS action, event_type <> 'error' AS ok, 'v=' || CAST(CAST(floor(value) AS BIGINT) AS STRING) AS detail, CAST(user_id AS STRING) AS project_ref FROM events""",
    "rfc_dates": "SELECT event_id, ts, CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE __RFC__ END AS header FROM events",
    "media": "SELECT page_id, page_id * 17 % 2400 AS width, page_id * 29 % 1800 AS height, CASE page_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'JPG' ELSE 'gif' END AS image_type FROM pages",
}


def _render(text: str, tokens: dict[str, str]) -> str:
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text.strip()


def spark_sql(name: str) -> str:
    return _render(VIEWS[name], _SPARK)


def duck_sql(name: str) -> str:
    return _render(VIEWS[name], _DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the Parquet files of `sf_dir`."""
    text = spark_sql(name)
    words = set(text.replace("(", " ").replace(")", " ").split())
    for source in TABLES:
        if source in words:
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(text)
