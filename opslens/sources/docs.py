"""Documents inside captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BODY = "STRUCT<docs: ARRAY<STRUCT<`_id`: STRING, `_type`: STRING, `_version`: BIGINT, found: BOOLEAN, `_source`: STRING>>>"


def read_docs(responses: DataFrame, url_pattern: str | None = None) -> DataFrame:
    """One row per entry of `body.docs[]` of the matching responses, in their order; payloads stay JSON text."""
    rows = responses.where(F.col("url").rlike(url_pattern)) if url_pattern else responses
    docs = rows.select(*[c for c in rows.columns if c != "body"], F.posexplode(F.from_json("body", _BODY)["docs"]).alias("pos", "doc"))
    return docs.select("*", F.col("doc._id").alias("doc_id"), F.col("doc._type").alias("type"), F.col("doc._source").alias("payload")).drop("doc")
