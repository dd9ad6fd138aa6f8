"""Message source with the filter at the source and a bound on rows per fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_messages(inbox: DataFrame, sender_like: str, limit: int | None = None) -> DataFrame:
    """Unread messages of one sender without the processed label, oldest first; at most `limit` of them where it is given.

    The plain predicates reach the Parquet scan; the limit is the size of one fetch, None for all.
    """
    wanted = inbox.where(F.col("sender").contains(sender_like) & ~F.col("labelled") & F.col("unread"))
    return wanted if limit is None else wanted.orderBy("sent_s", "message_id").limit(limit)
