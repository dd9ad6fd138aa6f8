"""Text functions: HTML to plain text, entity decoding, base64url, mail dates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ordered clean-up patterns of the plain-text fallback.
SCRIPT_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
LINE_BREAK = r"(?i)<br\s*/?>"
BLOCK_CLOSE = r"(?i)</(p|div|li|tr|h[1-6])>"
TAG = r"<[^>]+>"
INLINE_SPACE = r"[ \t]+"
MANY_LINES = r"\n{3,}"


def map_texts(texts: pd.Series, fn) -> pd.Series:
    """`fn` over the texts of a batch; missing ones stay missing. Plain objects keep Arrow's batches whole."""
    return pd.Series([fn(t) if isinstance(t, str) else None for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return map_texts(texts, html.unescape)


def unescape(text: Column) -> Column:
    """Decode HTML entities. Only texts with an ampersand leave the JVM, the others travel as nulls."""
    return F.coalesce(_decode_entities(F.when(text.contains("&"), text)), text)


def strip(text: Column) -> Column:
    """Without outer white space of any script, no-break spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def html_to_text(source: Column, entities: bool = True) -> Column:
    """Readable text of an HTML body; '' for none."""
    text = F.regexp_replace(F.coalesce(source, F.lit("")), SCRIPT_STYLE, "")
    for pattern, by in ((LINE_BREAK, "\n"), (BLOCK_CLOSE, "\n"), (TAG, "")):
        text = F.regexp_replace(text, pattern, by)
    if entities:
        text = unescape(text)
    text = F.regexp_replace(text, INLINE_SPACE, " ")
    return strip(F.regexp_replace(text, MANY_LINES, "\n\n"))


def base64url_text(data: Column) -> Column:
    """UTF-8 text of base64url data; undecodable bytes become replacement characters."""
    raw = F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64"))
    return F.make_valid_utf8(raw.cast("string"))


def mail_time(header: Column, ingested: Column) -> Column:
    """RFC 2822 date as UTC wall clock, the ingest time where it cannot be read."""
    text = F.regexp_replace(header, r"^\s*[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")
    text = F.regexp_replace(text, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z"))
    )
    return F.coalesce(parsed.cast("timestamp_ntz"), ingested)
