"""The pipeline stage by stage against plain readings, and the registered queries."""

from __future__ import annotations

import collections
import os
import subprocess
import sys

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opslens.llm import quality, rules
from opslens.llm.queries import ORACLES, QUERIES
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "substring_dedup", "packing"]
    model = quality.fit_ordinal(quality.training_sample(docs, quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))))

    def rows(df):
        assert df.columns == columns
        return {r.doc_id: r.text for r in df.collect()}

    now = rows(docs)
    df = stages["quality_classifier"](spark, docs, SF)
    now = {i: t for i, t in now.items() if model.tails(np.array([model.score(quality.features(t))]))[0, -1] >= quality.TAIL}
    assert rows(df) == now
    df = stages["exact_dedup"](spark, df, SF)
    first = {}
    for i in sorted(now):
        first.setdefault(now[i] or "", i)
    now = {i: now[i] for i in first.values()}
    assert rows(df) == now
    df = stages["minhash_near_dedup"](spark, df, SF)
    classes = helpers.near_classes(now.items(), 5, 80)
    now = {i: t for i, t in now.items() if classes[i][1] == i}
    assert rows(df) == now
    df = stages["substring_dedup"](spark, df, SF)
    cut = helpers.word_repeats(now.items())
    now = {i: cut[i][2] if cut[i][1] else t for i, t in now.items() if not cut[i][1] or cut[i][2]}
    assert rows(df) == now
    packed = stages["packing"](spark, df, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = collections.Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in now.items()}


def test_stages_take_awkward_rows(spark):
    docs = helpers.awkward(spark, ("_row", "_kept_id", "_new", "_changed", "_tail", "n_chars"))
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, df, SF).count()


def test_stages_lose_no_text_of_a_repeated_id(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [
        (1, f"first {passage}"), (5, f"alpha beta {passage}"), (5, f"gamma delta {passage}"), (5, f"alpha beta {passage}"), (6, f"six {passage} end"), (None, "nobody's"), (None, "nobody's"),
        (None, f"first {passage}"), (7, None), (8, ""), (9, "same"), (9, "same"), (None, "same"),
    ]
    df = spark.createDataFrame(rows, helpers.SCHEMA).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    exact = sorted(map(str, stages["exact_dedup"](spark, df, SF).collect()))
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t or "", (i, t))
    assert exact == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in first.values())
    cut = sorted((str(r.doc_id), r.text) for r in stages["substring_dedup"](spark, df.dropDuplicates(), SF).collect() if r.doc_id in (1, 5, 6))
    # the two texts of id 5 cannot be told apart by id and keep their words
    assert cut == [("1", rows[0][1]), ("5", rows[1][1]), ("5", rows[2][1]), ("6", "six end")]


def test_samples_take_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], helpers.SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.training_sample(docs, quality.graded(labels)).count() == 3
    assert len(rules.rated_statistics(docs, labels, "doc_id", "text")[1]) == 3


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*names).collect())
    want = sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall())
    assert got == want


PER_GROUP = {"op11_filter_audit", "op13_term_transducer"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PER_GROUP))
def test_queries_return_one_row_per_row(spark, name):
    df = QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if "page_id" in df.columns else ("documents", "doc_id")
    ids = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    found = df.select(F.col(key))
    if "sequence_id" in df.columns:
        found = found.distinct()
    assert collections.Counter(found.toPandas()[key]) == collections.Counter(ids.toPandas()[key])


def test_entry_lists_all():
    code = "import __spark_entry__ as e; q = e.queries(); print(sum(k.startswith('op') for k in q), 'pipeline' in q)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["13", "True"]
