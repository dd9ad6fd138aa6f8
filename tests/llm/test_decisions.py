"""URL rules, exact copies, the quality classifier and the quality rules."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import quality, rules
from opslens.llm.exact_dedup import drop_exact_copies, exact_groups
from opslens.llm.url_filters import judge_urls
from tests.llm.helpers import SCHEMA, awkward, awkward_texts, sha, statistics

SF = "/root/testdata/sf0.01"


def test_url_rules(spark):
    listed = [
        ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "/en/deep/er", "allow"), ("net", "/es/", "block"),
    ]
    rows = [
        (1, "http://example.com/en/1", "example.com/en/", "block"), (2, "https://a.WWW.Example.com/en/x?q#f", "www.example.com/en/", "allow"),
        (3, "http://notexample.com/en/", "com/", "allow"), (4, "http://example.com/en", "com/", "allow"), (5, "http://example.com", None, "block"),
        (6, "http://example.com/en/deep/erie/x", "example.com/en/deep/er", "allow"), (7, "http://example.com/en/deep/e", "example.com/en/", "block"),
        (8, None, None, "block"), (9, "example.com/en/", None, "block"), (10, "", None, "block"), (11, "x://y://net/es/", None, "block"), (12, "http://net/es/", "net/es/", "block"),
        (None, "http://a.net?x", None, "block"), (1, "http://example.com/en/1", "example.com/en/", "block"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit("x"), "_found": F.lit(2)})
    got = judge_urls(df, listed, default="block").collect()
    assert sorted((str(r.page_id), r.rule or "", r.verdict) for r in got) == sorted((str(r[0]), r[2] or "", r[3]) for r in rows)
    assert {r.host for r in got if r.page_id in (2, 11)} == {"a.www.example.com", "y:"}
    assert judge_urls(df.limit(0), listed).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        judge_urls(df, listed, max_rule_bytes=10)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = awkward_texts()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = min if keep == "smallest" else max
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = pick(ids) if ids else None
        want.append((str(i), best, len(groups[t or ""]), i == best, sha(t or "")))
    df = awkward(spark, ("keep_id", "_h1", "_text", "kept", "group_size"))
    got = [(str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(df, keep=keep).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = drop_exact_copies(df, keep=keep)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[1]) for w in {(w[4], w[1]): w for w in want}.values())
    assert exact_groups(df.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    from opslens.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: [(F.length(text) % 2).cast("long").alias("_h1"), F.lit(0).cast("long").alias("_h2")])
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, None), (5, "x"), (6, "x")]
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 2), (6, 5, 2)]


def test_classifier_on_held_out_ratings(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grades = quality.graded(labels)
    model = quality.fit_ordinal(quality.training_sample(docs, grades, modulus=(4, 0)))
    assert (np.diff(model.thresholds) >= 0).all()
    held = docs.join(grades.where(F.pmod(F.xxhash64(F.lit(29), F.col("_rated")), F.lit(4)) == 0), F.col("doc_id") == F.col("_rated")).select("_grade", "text")
    scored = quality.score_documents(held, model).select("_row._grade", "_expected", (F.col("_tail") >= quality.TAIL).alias("kept")).toPandas()
    share = scored.groupby("_grade")["kept"].mean()
    assert share[2] > 0.97 and share[0] < 0.08 and share[1] < 0.1
    mean = scored.groupby("_grade")["_expected"].mean()
    assert mean[0] < mean[1] < mean[2]


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 1), (100, 1, 0), (101, 0, 1), (9999, 1, 0), (102, None, None)], "doc_id long, quality int, toxic int")
    df = awkward(spark, ("_tail", "_row", "_expected", "kept"))
    got = quality.classify(df, labels)
    assert got.count() == df.count() and got.where("tail_probability is null").count() == 0
    kept = quality.drop_rejected(df, labels)
    assert kept.columns == df.columns
    # no ratings: everything is kept; no rows: nothing comes out
    assert quality.drop_rejected(df, labels.limit(0)).count() == df.count()
    assert quality.classify(df.limit(0), labels).count() == 0


def test_rule_statistics(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).withColumn("doc_id", -F.col("doc_id")))
    want = collections.Counter()
    for r in docs.collect():
        counts = statistics(r.text)
        want[(r.doc_id, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0])] += 1
    got = rules.judge_quality(docs.withColumn("kept", F.lit(1)), labels).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.judge_quality(docs.limit(0), labels).count() == 0
    assert rules.judge_quality(awkward(spark), labels.limit(0)).count() == len(awkward_texts())


def test_rules_on_held_out_ratings(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    forest = rules.grow_forest(*rules.rated_statistics(docs, labels, "doc_id", "text", modulus=(4, 0)), list(rules.FEATURES.values()))
    held = labels.where(F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), F.lit(4)) == 0)
    matrix, good = rules.rated_statistics(docs, held, "doc_id", "text")
    kept = forest.score(matrix) >= 0
    assert kept[good == 1].mean() > 0.98 and kept[good == 0].mean() < 0.05


def test_forest_scores_as_a_walk_down_its_trees():
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(400, 4))
    forest = rules.grow_forest(matrix, (matrix[:, 0] + matrix[:, 1] * matrix[:, 2] > 0).astype(float), [1, 0, 0, -1], trees=12)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    assert np.allclose(forest.score(matrix), [walk(row) for row in matrix])


def test_forest_is_monotonic():
    rng = np.random.default_rng(3)
    matrix = rng.random((600, 3))
    target = ((matrix[:, 0] + np.sin(9 * matrix[:, 1]) + rng.normal(0, 0.6, 600)) > 1).astype(float)
    forest = rules.grow_forest(matrix, target, [1, -1, 0])
    for feature, sign in ((0, 1), (1, -1)):
        for row in rng.random((30, 3)):
            line = np.repeat(row[None, :], 60, axis=0)
            line[:, feature] = np.linspace(0, 1, 60)
            assert (np.diff(forest.score(line)) * sign >= -1e-9).all()
    assert ((forest.score(matrix) >= 0) == target).mean() > 0.7
