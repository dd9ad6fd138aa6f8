"""Quality rules: document statistics, base limits, and gradient-boosted trees with monotonic constraints.

The statistics of a whole batch come from a few passes over its bytes. The trees are grown on a bounded sample of rated
documents and flattened into arrays, so that scoring is indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.tokens import SEPARATOR, Words, chunks, coded_spans, column_bytes, exact_grams

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", dtype=np.uint8))
SAMPLE_ROWS = 12_000
KEEP = 0.5

#: name of each feature and the direction in which the score may move with it: -1 never up, 1 never down, 0 free
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "digits": 0, "marks": -1,
    "distinct": 0, "doubled": -1, "line_words": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row, does its (group, keys) stand earlier, and does it stand anywhere else?"""
    order = np.lexsort((*keys, group))
    same = np.zeros(len(group) + 1, dtype=bool)
    if len(group):
        equal = group[order][1:] == group[order][:-1]
        for key in keys:
            equal &= key[order][1:] == key[order][:-1]
        same[1:-1] = equal
    earlier, shared = np.zeros(len(group), dtype=bool), np.zeros(len(group), dtype=bool)
    earlier[order] = same[:-1]
    shared[order] = same[:-1] | same[1:]
    return earlier, shared


def statistics(raw: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the feature matrix of some texts."""
    rows = len(offsets) - 1
    words = Words(raw, offsets)
    n_words = np.diff(words.text_offsets)
    owner = words.text_of_word()
    first, distinct = words.coded()
    chars = _sums(words.inside & ((raw & 0xC0) != 0x80), offsets)
    symbols = _sums(SYMBOLS[raw], offsets)

    window = 5
    covered = np.zeros(len(first) + 1, dtype=np.int64)
    keys = exact_grams(first, len(distinct), window)
    n = len(keys[0])
    starts = np.flatnonzero(owner[:n] == owner[window - 1 :][:n]) if n else np.zeros(0, dtype=np.int64)
    _, shared = _again(owner[starts], *[key[starts] for key in keys])
    np.add.at(covered, starts[shared], 1)
    np.add.at(covered, starts[shared] + window, -1)
    repeat = _sums(np.cumsum(covered[:-1]) > 0, words.text_offsets)

    # lines end at a line feed or at the end of the text
    feed = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feed + 1]))
    line_start = line_start[line_start < len(raw)]
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    next_feed = np.append(feed, len(raw))[np.searchsorted(feed, line_start)]
    line_end = np.minimum(next_feed, offsets[line_owner + 1])
    spoken = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(~SEPARATOR[raw], out=spoken[1:])
    filled = spoken[line_end] > spoken[line_start]
    line_start, line_end, line_owner = line_start[filled], line_end[filled], line_owner[filled]
    earlier, _ = _again(line_owner, coded_spans(raw, line_start, line_end)[0])
    dup_lines = np.bincount(line_owner, weights=earlier, minlength=rows).astype(np.int64)
    n_lines = np.bincount(line_owner, minlength=rows)

    before, _ = _again(owner, first)
    doubled = np.zeros(len(first), dtype=bool)
    doubled[1:] = (first[1:] == first[:-1]) & (owner[1:] == owner[:-1])
    counts = dict(zip(COUNTS, (n_words, chars, symbols, dup_lines, repeat), strict=True))
    per_word, per_char = np.maximum(n_words, 1), np.maximum(chars, 1)
    matrix = np.column_stack([
        np.log1p(n_words), chars / per_word, symbols / per_word, dup_lines / np.maximum(n_lines, 1), repeat / per_word,
        _sums(UPPER[raw], offsets) / per_char, _sums(DIGIT[raw], offsets) / per_char, _sums(MARKS[raw], offsets) / per_word,
        1 - _sums(before, words.text_offsets) / per_word, _sums(doubled, words.text_offsets) / per_word, np.minimum(n_words / np.maximum(n_lines, 1), 1000),
    ])
    return counts, matrix


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points to itself. Scores are log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, matrix: np.ndarray) -> np.ndarray:
        total = np.full(len(matrix), self.start)
        lanes = np.arange(len(matrix))
        for root in self.roots:
            node = np.full(len(matrix), root)
            for _ in range(self.depth):
                go = matrix[lanes, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            total += self.value[node]
        return total


def grow_forest(matrix: np.ndarray, target: np.ndarray, directions: list[int], trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 4.0) -> Forest:
    """Boosted trees for the logistic loss on binned features.

    A split on a constrained feature is refused if its sides would lie the wrong way round, and the middle of its two
    values bounds all leaves below it on either side; so the score is monotonic in the feature as a whole.
    """
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in matrix.T] if len(matrix) else []
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, matrix.T, strict=True)]) if len(matrix) else None
    positives = float(target.sum())
    start = np.log((positives + 1) / (len(target) - positives + 1))
    nodes: list[list[float]] = []
    roots = []
    score = np.full(len(target), start)
    for _ in range(trees if 0 < positives < len(target) else 0):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - target, p * (1 - p)

        def leaf(rows, low, high, gradient=gradient, hessian=hessian):
            return float(np.clip(-gradient[rows].sum() / (hessian[rows].sum() + 1.0), low, high))

        def grow(rows, level, low, high, gradient=gradient, hessian=hessian, leaf=leaf):
            place = len(nodes)
            nodes.append([0, np.inf, place, place, rate * leaf(rows, low, high)])
            if level == depth or len(rows) < 2 * least:
                score[rows] += nodes[place][4]
                return place
            best = (1e-6, None)
            g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
            for f, direction in enumerate(directions):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                g = np.cumsum(np.bincount(binned[rows, f], weights=gradient[rows], minlength=width))[:-1]
                h = np.cumsum(np.bincount(binned[rows, f], weights=hessian[rows], minlength=width))[:-1]
                n = np.cumsum(np.bincount(binned[rows, f], minlength=width))[:-1]
                lv = np.clip(-g / (h + 1), low, high)
                rv = np.clip(-(g_all - g) / (h_all - h + 1), low, high)
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                fits = (n >= least) & (len(rows) - n >= least) & ((rv - lv) * direction >= 0)
                gain = np.where(fits, gain, -1)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (f, at, lv[at], rv[at], direction))
            if best[1] is None:
                score[rows] += nodes[place][4]
                return place
            f, at, lv, rv, direction = best[1]
            middle = (lv + rv) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[direction]
            go = binned[rows, f] <= at
            nodes[place][0], nodes[place][1] = f, edges[f][at]
            nodes[place][2] = grow(rows[go], level + 1, *bounds[0])
            nodes[place][3] = grow(rows[~go], level + 1, *bounds[1])
            return place

        roots.append(grow(np.arange(len(target)), 0, -np.inf, np.inf))
    table = np.array(nodes) if nodes else np.zeros((0, 5))
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, dtype=int), depth, start)


def rated_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS, modulus: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of at most `rows` rated documents, picked by hash of the id, half from either rating.

    `modulus` (m, r) leaves out ids whose hash is r modulo m. Of several ratings of an id the lower counts.
    """
    rated = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_rated")).agg(F.min("quality").alias("_quality"))
    if modulus:
        rated = rated.where(F.pmod(F.xxhash64(F.lit(29), F.col("_rated")), F.lit(modulus[0])) != modulus[1])
    order = F.xxhash64(F.lit(23), F.col("_rated"))
    halves = [rated.where(c).orderBy(order, "_rated").limit(rows // 2) for c in (F.col("_quality") == 0, F.col("_quality") != 0)]
    picked = halves[0].unionByName(halves[1])
    joined = docs.select(F.col(id_col).alias("_rated"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_rated")
    # an id may have many rows: one text for each, or the sample would have no bound
    joined = joined.groupBy("_rated", "_quality").agg(F.min("_text").alias("_text")).select("_text", "_quality")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column(0))
            for a, b in chunks(offsets):
                _, matrix = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [pa.array(matrix[:, i]) for i in range(matrix.shape[1])]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(1).slice(a, b - a).cast(pa.int32())], [*FEATURES, "quality"])

    found = joined.mapInArrow(work, ", ".join(f"{f} double" for f in FEATURES) + ", quality int").toPandas()
    found = found.sort_values([*FEATURES, "quality"])  # the same rows in the same order, whatever the tasks did
    return found[list(FEATURES)].to_numpy(float), (found["quality"].to_numpy() > 0).astype(float)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per row of `docs`: id, n_words, the four counts, base_failed and kept.

    A text fails the base rules with fewer than 10 words or more than a fifth of its words in repeated 5-word windows;
    otherwise the forest decides: kept if the probability of good quality is at least `keep`. Null and empty texts have no words
    and fail. Without ratings of both kinds the forest is empty and its verdict is the share of good ratings, one
    half if there are none. Repeated rows get equal results; other columns are not read.
    """
    matrix, quality = rated_statistics(docs, labels, id_col, text_col)
    forest = grow_forest(matrix, quality, list(FEATURES.values()))
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    cut = float(np.log(keep / (1 - keep)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for a, b in chunks(offsets):
                counts, found = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                kept = ~failed & (trees.score(found) >= cut)
                arrays = [batch.column(0).slice(a, b - a), *[pa.array(counts[c]) for c in COUNTS], pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, *COUNTS, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(work, schema)
