"""Exact deduplication by a 128-bit content hash with a byte comparison inside every group; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.session import materialize


def content_hash(text: Column) -> list[Column]:
    """128 bits of the text as two longs; the second half is seeded by the first."""
    first = F.xxhash64(text)
    return [first.alias("_h1"), F.xxhash64(F.lit(0x5BD1E995), text, first).alias("_h2")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of `docs`: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; null counts as empty. `keep` names which id of a group stays, smallest or largest.

    Copies shrink before the shuffle: partial aggregates keep one smallest and one largest text per hash and map task.
    If both are the same bytes, all texts of the group are. The groups, now without text, are written to the shared
    folder, and the rows are joined to them by hash. A group where the two texts differ holds a hash collision; only
    where such groups exist are their rows grouped again, by the text itself.

    Rows with a null id get the keep_id of their group, are never kept if it has any id, and all of them are kept if it has none.
    Rows that repeat id and text share their fate. An empty table gives an empty result; other columns are not read.
    """
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", "_text", *content_hash(F.col("_text")))
    groups = rows.groupBy("_h1", "_h2").agg(
        best("_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("_text").alias("_low"), F.max("_text").alias("_high")
    )
    same = F.col("_low") == F.col("_high")
    digest = F.sha2(F.col("_low").cast("binary"), 256)
    by_hash = materialize(groups.select(
        "_h1", "_h2", F.when(same, F.col("keep_id")).alias("keep_id"), F.when(same, F.col("group_size")).alias("group_size"),
        F.when(same, digest).alias("text_sha256"), same.alias("_same"),
    ), "exact-groups")
    narrow = rows.select("_id", "_h1", "_h2")
    columns = [
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    ]
    result = narrow.join(by_hash.where("_same"), ["_h1", "_h2"]).select(*columns)

    collided = by_hash.where(~F.col("_same")).select("_h1", "_h2")
    if collided.isEmpty():
        return result
    again = rows.join(collided, ["_h1", "_h2"])
    exact = again.groupBy("_text").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    rest = again.join(exact, "_text").withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    return result.unionByName(rest.select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of `docs` for every text, with all its columns: that with the best id, null counting as empty.

    A text that only rows without an id have is kept once, too. Of rows that repeat both id and text any one stays. An id
    that names several texts keeps those for which it is the best. An empty table stays empty.
    """
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").groupBy(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).agg(F.count("*").alias("_kept_rows"))
    kept = materialize(kept, "exact-kept")
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    same = docs[id_col].eqNullSafe(kept["_kept_id"]) & (digest == kept["_kept_text"])
    once = docs.join(kept.where("_kept_rows = 1"), same, "left_semi")
    often = kept.where("_kept_rows > 1")
    if often.isEmpty():
        return once
    one_each = docs.join(often, same).dropDuplicates(["_kept_id", "_kept_text"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(one_each)
