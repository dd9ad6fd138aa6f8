"""One registered query per operator over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opslens.llm.bpe import encode_decode
from opslens.llm.byte_audit import audit_filters
from opslens.llm.exact_dedup import exact_groups
from opslens.llm.fm_dedup import remove_word_repeats
from opslens.llm.odd_minhash import near_classes
from opslens.llm.packing import pack
from opslens.llm.positional_index import find_contamination
from opslens.llm.quality import classify
from opslens.llm.rules import judge_quality
from opslens.llm.suffix_dedup import remove_repeats
from opslens.llm.term_transducer import audit_sources
from opslens.llm.url_filters import judge_urls
from opslens.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op2_url_filters",
    sql="""
    WITH parts AS (
        SELECT page_id,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    rules(rhost, rpath, verdict) AS (VALUES
        ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    hits AS (
        SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS place
        FROM parts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
    SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND place = 1""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op5_exact_dedup",
    sql="""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_warc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_word_table_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op9_fm_index_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_word_repeats(table(spark, sf_dir, "documents"))


@query("op10_odd_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


@query(
    "op11_filter_audit",
    sql="""
    WITH words AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
        SELECT part, doc_id,
               (len(w) < 200)::INT + 2 * (100 * list_unique(w) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT
               + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS failed
        FROM words),
    rated AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    counts AS (
        SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS t FROM sets LEFT JOIN rated USING (doc_id) GROUP BY part, failed),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
    orders AS (
        SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
        FROM f p, f q, f r, f s, f u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND (p.b | q.b | r.b | s.b | u.b) = 31),
    steps AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, range(1, 6) x(k)),
    done AS (
        SELECT part, filter_order, step, bit, sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN g ELSE 0 END) AS good_lost,
               sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN t ELSE 0 END) AS toxic_lost
        FROM counts, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM done""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_positional_index",
    sql="""
    WITH dw AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    iw AS (
        SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT item, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) x(i)),
    sizes AS (SELECT DISTINCT k FROM windows),
    places AS (
        SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dw, sizes, unnest(range(1, greatest(len(w) - k + 2, 1))) x(i)),
    hits AS (SELECT doc_id, k, i, item FROM places JOIN windows USING (k, win)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, i FROM hits), unnest(range(i, i + k)) x(p) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_term_transducer",
    sql="""
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
        FROM documents),
    kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 30),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    counts AS (
        SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups AS (
        SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0)::HUGEINT AS total
        FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source, v),
    langs AS (SELECT lang, sum(total)::HUGEINT AS total FROM groups GROUP BY lang),
    shares AS (
        SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (g.total + 5 * g.v) AS p,
               1 + (1000000000::HUGEINT * (sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, k.term) + 5)) // (l.total + 5 * g.v) AS q
        FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
            ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
    terms AS (
        SELECT lang, source, term AS item, (p - q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)) AS rank
        FROM shares WHERE n > 0 AND p > q QUALIFY rank <= 50)
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term' AS part, item, value, rank::INT AS rank FROM terms""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))
