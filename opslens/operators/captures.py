"""Captured JSON responses: document generations, deduplication of two delivery paths, routing and caps.

A capture has `session_id, arrival, path, seq, is_load, url, body`; `arrival` orders the rows of a session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.columns import matches_any, one_of
from opslens.functions.scale import HOT_ROWS, first_per_key, running_total, top_per_key
from opslens.functions.text import map_texts


def doc_generation(captures: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds `gen`, the number of page loads of the session so far; sequence numbers restart with each load."""
    return running_total(captures, ["session_id"], [F.col("arrival")], F.col("is_load").cast("int"), "gen", hot_rows)


def dedup_captures(
    captures: DataFrame,
    hot_rows: int = HOT_ROWS,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """First arrival of every (session, generation, seq). Rows without a body go, rows without a seq all stay.

    The winners are found on narrow rows by hash aggregation (a row without a seq is a key of its own); bodies
    are shuffled once, for the join by session and arrival, which is unique and therefore even. The narrow rows are
    read several times, for counts, ranks and winners; `cut` may write them first, so that the captures are read twice.
    """
    narrow = cut(captures.select("session_id", "arrival", "seq", "is_load", F.col("body").isNotNull().alias("_filled")))
    keyed = doc_generation(narrow, hot_rows).where("_filled")
    numbered = F.col("seq").isNotNull()
    winners = keyed.groupBy("session_id", "gen", numbered.alias("_numbered"), F.coalesce("seq", "arrival").alias("_key")).agg(
        F.min("arrival").alias("arrival")
    )
    return captures.join(winners.select("session_id", "gen", "arrival"), ["session_id", "arrival"])


def url_filter(captures: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Keeps URLs in which any of the patterns is found; no patterns keep all."""
    return captures.where(matches_any(F.col("url"), patterns))


def bucket_first_match(captures: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Adds `pattern`, the first of the ordered patterns found in the URL; rows without one are dropped."""
    bucket = one_of([(F.col("url").rlike(p), p) for p in patterns])
    return captures.withColumn("pattern", bucket).where(F.col("pattern").isNotNull())


def cap_per_bucket(bucketed: DataFrame, n: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """First `n` rows of every bucket by arrival; what overflows is not offered to later patterns."""
    return top_per_key(bucketed, [*keys, "pattern"], [F.col("arrival")], n, out="rn")


def captures_in_window(captures: DataFrame, jobs: DataFrame, seconds: int) -> DataFrame:
    """Captures of a job from its start until the window closes (exclusive); jobs have `job_id, start_ts`."""
    window = F.expr(f"INTERVAL {int(seconds)} SECOND")
    return captures.join(jobs.select("job_id", "start_ts"), "job_id").where(
        (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("start_ts") + window)
    )


def seen_urls(captures: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Every URL a job has seen, with its count and first arrival: one row per URL, never one list per job."""
    return captures.groupBy(*keys, "url").agg(F.count("*").alias("hits"), F.min("arrival").alias("first_arrival"))


def login_wall(status: Column, error: Column, flag: Column) -> Column:
    """The capture met a login page: by its status, by its error text or flagged upstream."""
    by_text = F.lower(F.coalesce(error, F.lit(""))).contains("login")
    return F.coalesce(flag, F.lit(False)) | F.coalesce(status == "waiting_login", F.lit(False)) | by_text


def is_login_url(url: Column, patterns: Sequence[str]) -> Column:
    """The tab stands on a login page; an empty list turns the test off."""
    return matches_any(url, patterns) if patterns else F.lit(False)


def pick_init_body(responses: DataFrame, doc_type: str, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Last body with an entry of `doc_type`, else the last body; bodies that are null do not count."""
    entries = F.from_json("body", "ARRAY<STRUCT<type: STRING>>")
    has_type = F.coalesce(F.exists(entries, lambda e: e["type"] == doc_type), F.lit(False))
    filled = responses.where(F.col("body").isNotNull()).withColumn("_rank", F.struct(has_type, F.col("arrival")))
    return filled.groupBy(*keys).agg(
        F.max_by("body", "_rank").alias("body"), F.max_by("arrival", "_rank").alias("arrival"), F.count("*").alias("bodies")
    )


def doc_type_counts(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("?")).alias("type")
    return docs.groupBy(*keys, kind).agg(F.count("*").alias("docs"))


def first_doc_by_type(docs: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """First document per type in arrival order."""
    typed = docs.where(F.col("type").isNotNull() & F.col("payload").isNotNull())
    return first_per_key(typed, [*keys, "type"], ["arrival"], ["arrival", "doc_id", "payload"])


def doc_by_type_and_id(docs: DataFrame, doc_type: str, doc_id: str) -> DataFrame:
    wanted = docs.where((F.col("type") == doc_type) & (F.col("doc_id") == doc_id) & F.col("payload").isNotNull())
    return first_per_key(wanted, ["project_id"], ["arrival"], ["arrival", "doc_id", "payload"])


def json_only(captures: DataFrame, body: str = "body") -> DataFrame:
    """Adds `is_json`: the body parses as JSON, whatever its content type says."""
    return captures.withColumn("is_json", F.try_parse_json(body).isNotNull())


_SHAPE = T.ArrayType(T.StructType().add("ord", "integer").add("depth", "integer").add("object", "string"))


def shapes_of(text: str | None, keys: Sequence[str]) -> list[dict]:
    """The objects in a JSON text that have all keys, in depth-first order; none where it is no JSON."""
    try:
        stack = [(json.loads(text), 0)] if text else []
    except ValueError:
        return []
    found = []
    while stack:
        node, depth = stack.pop()
        if isinstance(node, dict):
            if all(k in node for k in keys):
                found.append({"ord": len(found), "depth": depth, "object": json.dumps(node, ensure_ascii=False)})
            children = list(node.values())
        elif isinstance(node, list):
            children = node
        else:
            continue
        stack.extend((child, depth + 1) for child in reversed(children))
    return found


class FindShapes:
    """Table function over Arrow batches of (id, body): the hits of each body, for keys in a comma-separated list."""

    def eval(self, rows: pa.RecordBatch, required: pa.Array) -> Iterator[pa.Table]:
        keys = required[0].as_py().split(",") if len(required) else []
        hits = [{"id": i, **hit} for i, text in zip(rows.column("id").to_pylist(), rows.column("body").to_pylist(), strict=True) for hit in shapes_of(text, keys)]
        yield pa.Table.from_pylist(hits, schema=pa.schema([("id", pa.int64()), ("ord", pa.int32()), ("depth", pa.int32()), ("object", pa.string())]))


def register_find_shapes(spark: SparkSession, name: str = "find_shapes") -> None:
    """Makes `find_shapes(TABLE(rows), 'key,key')` a table function of SQL: id, ord, depth, object for the rows' id and body.

    The table goes in as an argument and stays in its partitions; Spark takes no Arrow function behind LATERAL.
    """
    spark.udtf.register(name, F.arrow_udtf(FindShapes, returnType="id BIGINT, ord INT, depth INT, object STRING"))


def find_shapes(rows: DataFrame, body: str, required: Sequence[str]) -> DataFrame:
    """Every object at any depth that has all required keys, hits inside hits included, in depth-first order.

    Bodies go to Python in Arrow batches and come back as one array of hits each, which is then unfolded.
    """
    keys = tuple(required)

    @F.pandas_udf(_SHAPE)
    def hits(texts: pd.Series) -> pd.Series:
        return map_texts(texts, lambda text: shapes_of(text, keys))

    return rows.withColumn("_hits", hits(body)).select(*rows.columns, F.inline("_hits"))
