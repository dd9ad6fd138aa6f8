"""Chunked and salted helpers against brute force on random rows with one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from opslens.functions.scale import first_per_key, last_per_key, hot_keys, cut_hot, row_rank, running_total, top_per_key


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    keys = ["hot"] * 400 + [rnd.choice("abcdef") for _ in range(600)]
    return [(k, i, rnd.randint(-5, 5)) for i, k in enumerate(rnd.sample(keys, len(keys)))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k STRING, i INT, v INT").repartition(5)


@pytest.mark.parametrize("hot_rows", [0, 200, 10_000])
def test_running_total(df, rows, hot_rows):
    got = {(r.k, r.i): r.t for r in running_total(df, ["k"], [F.col("i")], F.col("v"), "t", hot_rows).collect()}
    sums, want = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[(k, i)] = sums[k]
    assert got == want


@pytest.mark.parametrize("hot_rows", [13, 10_000])
def test_running_total_without_keys(df, rows, hot_rows):
    found = running_total(df, [], [F.col("i")], F.col("v"), "t", hot_rows)
    assert found.columns == [*df.columns, "t"]
    got = [r.t for r in found.orderBy("i").collect()]
    total, want = 0, []
    for _, _, v in rows:
        total += v
        want.append(total)
    assert got == want


def test_row_rank(df, rows):
    got = {(r.k, r.i): r.n for r in row_rank(df, ["k"], [F.col("i")], "n", hot_rows=200).collect()}
    seen, want = {}, {}
    for k, i, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        want[(k, i)] = seen[k]
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 450])
def test_top_per_key(df, rows, k):
    got = sorted((r.k, r.i, r.n) for r in top_per_key(df, ["k"], [F.desc("v"), F.col("i")], k, salts=4, out="n").collect())
    want = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        want += [(key, r[1], n) for n, r in enumerate(group[:k], 1)]
    assert got == sorted(want)


def test_only_hot_keys_are_cut(df):
    assert [(r.k, r._n >= 400, r._parts > 1) for r in hot_keys(df, ["k"], hot_rows=200).collect()] == [("hot", True, True)]
    assert cut_hot(df, ["k"], [F.col("i")], hot_rows=2000) is None


def test_chunks_are_even_where_the_rows_lie_thick(spark):
    """One hour, and one second of it, hold half of all rows of one key."""
    rows = spark.range(40_000).select(
        F.lit("k").alias("key"), "id", F.when(F.col("id") % 2 == 0, 500_000).when(F.col("id") % 8 == 1, 500_000 + F.col("id") % 3600).otherwise(F.col("id") * 100).alias("s")
    )
    rows = rows.unionByName(spark.range(100).select(F.lit("small").alias("key"), "id", F.lit(None).cast("long").alias("s")))
    order = [F.col("s"), F.col("id")]
    sizes = [r["count"] for r in cut_hot(rows, ["key"], order, hot_rows=2000).where("key = 'k'").groupBy("_chunk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * 40_000 / len(sizes)
    got = {(r.key, r.id): r.n for r in row_rank(rows, ["key"], order, "n", hot_rows=2000).collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.key, -1 if r.s is None else r.s, r.id)):
        seen[r.key] = seen.get(r.key, 0) + 1
        want[(r.key, r.id)] = seen[r.key]
    assert got == want


def test_first_and_last(df, rows):
    first = {r.k: r.i for r in first_per_key(df, ["k"], ["v", "i"], ["i"]).collect()}
    last = {r.k: r.i for r in last_per_key(df, ["k"], ["v", "i"], ["i"]).collect()}
    for key in first:
        group = sorted((r[2], r[1]) for r in rows if r[0] == key)
        assert (first[key], last[key]) == (group[0][1], group[-1][1])
