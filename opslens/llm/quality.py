"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score. P(grade > k) = sigmoid(w.x - t_k). The
model gives the expected grade and the tail probability of the top grade, by which documents are selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1 << 22
SAMPLE_ROWS = 12_000
MIN_DOCS = 6
# a text that shows nothing stands a little under one half, because all grades weigh the same in the fit
TAIL = 0.35

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"\w+(?:['’-]\w+)*")


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: words without case, what follows their last letter, repetition.

    Null and empty texts have the single feature of emptiness.
    """
    words = WORD.findall(text or "")
    if not words:
        return _bins({"empty"})
    distinct = set(words)
    found = set()
    for word in distinct:
        for core in CORE.findall(word):
            found.add(core.lower())
        tail = word[len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):]
        if tail:
            found.add("tail:" + tail)
        if len(word) > 2 and word.isupper():
            found.add("upper")
    # how much of the text repeats, as steps that each add a feature
    for step in range(1, 10):
        if len(distinct) * 10 < len(words) * (10 - step):
            found.add(f"repeats:{step}")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    for step in range(1, 6):
        if same * 20 > len(words) * step:
            found.add(f"doubled:{step}")
    return _bins(found)


def _bins(found: set[str]) -> np.ndarray:
    return np.unique(pd.util.hash_array(np.array(sorted(found), dtype=object), categorize=False) & np.uint64(BINS - 1)).astype(np.int32)


@dataclass
class OrdinalModel:
    """Non-zero weights by bin, and the thresholds in rising order."""

    bins: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.bins, found)
        at[at == len(self.bins)] = 0
        hit = self.bins[at] == found if len(self.bins) else np.zeros(len(found), dtype=bool)
        return float(self.weights[at[hit]].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from the labels: 0 toxic, 1 poor, 2 good. Rows without id or quality have no grade; of several rows of an id the worst counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(id_col).alias("_rated"), grade.alias("_grade")).where("_rated is not null and _grade is not null").groupBy("_rated").agg(F.min("_grade").alias("_grade"))


def training_sample(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, modulus: tuple[int, int] | None = None) -> DataFrame:
    """At most `rows` rated documents, taken evenly from the grades by hash of the id; columns _grade and _found.

    `modulus` (m, r) leaves out the ids whose hash is r modulo m, for held-out tests.
    """
    order = F.xxhash64(F.lit(17), F.col("_rated"))
    if modulus:
        grades = grades.where(F.pmod(F.xxhash64(F.lit(29), F.col("_rated")), F.lit(modulus[0])) != modulus[1])
    kinds = sorted(r[0] for r in grades.select("_grade").distinct().collect())
    each = max(1, rows // max(1, len(kinds)))
    picked = None
    for kind in kinds:
        part = grades.where(F.col("_grade") == kind).orderBy(order, "_rated").limit(each)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = grades
    joined = docs.select(F.col(id_col).alias("_rated"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_rated")
    # an id may have many rows: one text for each, or the sample would have no bound
    joined = joined.groupBy("_rated", "_grade").agg(F.min("_text").alias("_text"))

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return joined.select("_grade", found("_text").alias("_found"))


def fit_ordinal(sample: DataFrame, grades: int = 3, rounds: int = 200, l1: float = 6e-3, l2: float = 1e-4, min_docs: int = MIN_DOCS) -> OrdinalModel:
    """Fits weights and thresholds on a bounded sample (columns _grade, _found).

    Accelerated gradient descent, twice: with an L1 penalty, which leaves the features that tell grades apart, and again
    on these alone with a small L2 penalty, so that they are not shrunk. Every grade weighs the same. Features of fewer
    than `min_docs` documents of the sample get no weight. The sample is the only thing that reaches the driver:
    SAMPLE_ROWS documents and the distinct features of each. With ratings of fewer than two grades the model has no
    weights and gives the top grade to everything.
    """
    data = sample.toPandas()
    if data["_grade"].nunique() < 2:
        return OrdinalModel(np.zeros(0, np.int32), np.zeros(0), np.full(grades - 1, -30.0))
    rows = np.repeat(np.arange(len(data)), data["_found"].map(len))
    bins, columns = np.unique(np.concatenate([np.asarray(x, dtype=np.int32) for x in data["_found"]]), return_inverse=True)
    grade = data["_grade"].to_numpy()

    def narrowed(usable: np.ndarray) -> None:
        nonlocal rows, columns, bins
        keep = usable[columns]
        rows, columns, bins = rows[keep], (np.cumsum(usable) - 1)[columns[keep]], bins[usable]

    narrowed(np.bincount(columns) >= min_docs)
    weights, thresholds = _descend(rows, columns, grade, len(bins), grades, rounds, l1, 0.0)
    narrowed(weights != 0)
    weights, thresholds = _descend(rows, columns, grade, len(bins), grades, rounds, 0.0, l2)
    return OrdinalModel(bins, weights, thresholds)


def _descend(rows, columns, grade, features, grades, rounds, l1, l2) -> tuple[np.ndarray, np.ndarray]:
    n = len(grade)
    per = np.bincount(grade, minlength=grades)
    share = (1.0 / np.maximum(per, 1) / (per > 0).sum())[grade]
    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    w, t = np.zeros(features), np.linspace(-1.0, 1.0, grades - 1)
    w_at, t_at, speed = w, t, 1.0
    # features often stand together, so a step is bounded by their number in a row
    step = 4.0 / ((share * (np.bincount(rows, minlength=n) + 1)).sum() * (grades - 1) + l2)
    for _ in range(rounds):
        score = np.bincount(rows, weights=w_at[columns], minlength=n)
        p = 1.0 / (1.0 + np.exp(np.clip(t_at[None, :] - score[:, None], -60, 60)))
        slope = (p - above) * share[:, None]
        w_new = w_at - step * (np.bincount(columns, weights=slope.sum(1)[rows], minlength=features) + l2 * w_at)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * l1, 0)
        t_new = np.sort(t_at + step * slope.sum(0))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        w_at = w_new + (speed - 1) / faster * (w_new - w)
        t_at = np.sort(t_new + (speed - 1) / faster * (t_new - t))
        w, t, speed = w_new, t_new, faster
    return w, t


def score_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """Every row of `docs` as a struct _row, with _expected (mean grade) and _tail (probability of the top grade) of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for texts in batches:
            tails = fitted.tails(np.array([fitted.score(features(x)) for x in texts]))
            yield pd.DataFrame({"expected": tails.sum(1), "tail": tails[:, -1]})

    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), grade(docs[text_col]).alias("_grades"))
    return scored.select("_row", F.col("_grades.expected").alias("_expected"), F.col("_grades.tail").alias("_tail"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """One row per row of `docs`: id, expected_grade, tail_probability (rounded to 6 places) and kept (tail probability of at least `tail`).

    Fits on the rated documents of `docs` first. Null and empty texts are scored by their own feature; repeated rows get
    equal results; other columns, whatever their names, are not read.
    """
    model = fit_ordinal(training_sample(docs, graded(labels, "doc_id"), id_col, text_col))
    scored = score_documents(docs.select(F.col(id_col), F.col(text_col).alias("_body")), model, "_body")
    return scored.select(
        F.col("_row")[id_col].alias(id_col), F.round("_expected", 6).alias("expected_grade"), F.round("_tail", 6).alias("tail_probability"), (F.col("_tail") >= tail).alias("kept")
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with their columns.

    Every row is judged by its own text, rows without an id and repeated rows too; null and empty texts have their own feature.
    Without ratings of two grades all rows stay; an empty table stays empty.
    """
    model = fit_ordinal(training_sample(docs, graded(labels, "doc_id"), id_col, text_col))
    return score_documents(docs, model, text_col).where(F.col("_tail") >= tail).select("_row.*")
