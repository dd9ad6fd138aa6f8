"""Ordered and ranked operations that never put one whole key group into one task.

A plain window over a key sends all rows of that key to one task. Here hot groups are cut into chunks along
their order; chunk totals are small, so only they are windowed over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.session import materialize


# A key is hot from this share of all rows on, so there are at most HOT_SHARE hot keys and their list is small.
HOT_SHARE = 100_000
# Below this size a key is never hot.
HOT_ROWS = 200_000
# All hot keys together are cut into so many chunks, and one more each, with bounds from so many rows a chunk.
CHUNKS = 10_000
SAMPLES = 32


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than `hot_rows` rows and more than 1/`hot_share` of all rows, with `_n` rows and the `_parts` to cut them into.

    The counts are a narrow partial aggregate. No more than `hot_share` keys can pass the test, and all of them together get at most
    CHUNKS parts besides one each, which bounds the broadcast whatever the data.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") > F.greatest(F.lit(hot_rows), total / hot_share))
    part_rows = F.greatest(F.lit(max(hot_rows, 1)), total / CHUNKS)
    return hot.select(*keys, "_n", (1 + F.ceil(F.col("_n") / part_rows)).cast("int").alias("_parts"))


def splitters(df: DataFrame, keys: Sequence[str], order: Column, hot: DataFrame) -> DataFrame:
    """For each hot key `_bounds`, the rising values of `order` at which it is cut into even parts, from SAMPLES rows a part.

    The sample is drawn by hash of the order itself, so it is the same whenever it is drawn; bounds decide only which task ranks a row.
    """
    share = F.lit(SAMPLES) * F.col("_parts") / F.col("_n")
    drawn = F.pmod(F.xxhash64("_order"), F.lit(1 << 30)) < share * (1 << 30)
    sample = df.select(*keys, order.alias("_order")).join(F.broadcast(hot), list(keys)).where(drawn)
    listed = sample.groupBy(*keys, "_parts").agg(F.array_sort(F.collect_list("_order")).alias("_sample"))
    at = lambda i: F.element_at("_sample", (1 + F.floor(i * F.size("_sample") / F.col("_parts"))).cast("int"))
    return listed.select(*keys, F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), at).alias("_bounds"))


def place_between(bounds: Column, value: Column) -> Column:
    """How many of the rising bounds (fewer than 16,384) are not above the value, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(13, -1, -1)])
    fits = lambda at, step: (at + step <= F.size(bounds)) & (F.try_element_at(bounds, at + step) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def cut_hot(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Adds `_chunk`, null for keys that are not hot, which never falls along `order` and has about `hot_rows` rows of its key; None if no key is hot."""
    hot = materialize(hot_keys(df, keys, hot_rows), "hot-keys")
    if hot.isEmpty():
        return None
    by = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    bounds = materialize(splitters(df, keys, by, hot), "splitters")
    # a key too small to be sampled keeps one chunk
    bounds = hot.select(*keys).join(bounds, list(keys), "left").withColumn("_hot", F.lit(True))
    marked = df.join(F.broadcast(bounds), list(keys), "left")
    chunk = F.when(F.col("_hot"), F.coalesce(place_between(F.col("_bounds"), by), F.lit(0)))
    return marked.withColumn("_chunk", chunk).drop("_bounds", "_hot")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inclusive running sum of `value` within `keys` along the total `order`; keys must not be null.

    The keys are counted first. If some are hot, their rows are cut along the order into even chunks, wherever the rows lie
    thick; chunk totals exist for hot keys only, and the rows themselves are shuffled once, by keys and chunk, for the
    join and the window alike. Without keys all rows are one key. `df` is read up to three times: write it first if it is costly.
    """
    rows = df.withColumn("_value", value)
    keys = list(keys)
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    by = [*keys, "_chunk"]
    cut = cut_hot(rows, keys, order, hot_rows)
    inside = Window.partitionBy(*(keys if cut is None else by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cut is None:
        return rows.withColumn(out, F.sum("_value").over(inside)).drop("_value", "_all")
    totals = cut.where("_chunk is not null").groupBy(*by).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.sum("_total").over(before).alias("_offset"))
    summed = F.coalesce("_offset", F.lit(0)) + F.sum("_value").over(inside)
    return cut.join(offsets, by, "left").withColumn(out, summed).drop("_chunk", "_value", "_offset", "_all")


def row_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact row number within `keys` along a total `order`, built on chunk counts."""
    return running_total(df, keys, order, F.lit(1), out, hot_rows)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 64, out: str | None = None
) -> DataFrame:
    """First `k` rows of every key along a total `order`, exact.

    The rows of a key are first ranked in `salts` parts, so at most `salts * k` of them meet in the last step. Up to
    spark.sql.optimizer.windowGroupLimitThreshold (1000) each map task sends only its own first `k`; for a larger `k`
    a part is shuffled whole. Which part a row is in cannot change the result.
    """
    parts = df.withColumn("_salt", F.spark_partition_id() % salts)
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = parts.withColumn("_rank", F.row_number().over(local)).where(F.col("_rank") <= k).drop("_salt", "_rank")
    final = Window.partitionBy(*keys).orderBy(*order)
    ranked = kept.withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", out) if out else ranked.drop("_rank")


def beside(df: DataFrame) -> DataFrame:
    """`df` for a join in which neither side goes to the driver: for tables that grow with the input.

    Spark estimates a table by the size of its files. Rows that compress well, as lists with the same few names do, can take
    a hundred times that once a broadcast has them in memory.
    """
    return df.hint("merge")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of the first row of every key; a partial aggregate, so a hot key shrinks before the shuffle."""
    picked = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_first")).select(*keys, "_first.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    picked = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_last")).select(*keys, "_last.*")
