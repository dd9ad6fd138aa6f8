"""Filter interaction audit: what every filter removes, wherever it stands in a chain of filters.

1. A table-driven transducer reads the bytes of all texts once. Its state after a byte depends on that byte's class alone,
   so all bytes take their step at the same time; the table gives, for each state and class, the next state and what is
   counted: a word that begins, a code point, a capital, a symbol.
2. The word spans it finds go into a hash table of spans, where a span meets an equal one only after their bytes were compared.
3. A document becomes one number, the set of filters that it fails. All orders of the filters follow from the counts of
   these sets, at most 2 ** filters for each part, however many documents there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opslens.llm.tokens import BYTE_VALUES, Slices, chunks, column_bytes, mix
from opslens.session import materialize

SPACE, CAPITAL, SYMBOL, OTHER, TAIL = range(5)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
CLASS[0x41:0x5B] = CAPITAL
CLASS[np.frombuffer(b"#$%&*|", dtype=np.uint8)] = SYMBOL
CLASS[0x80:0xC0] = TAIL  # the second and later bytes of a code point

OUT, IN = 0, 1
NEXT = np.array([[OUT, IN, IN, IN, IN], [OUT, IN, IN, IN, IN]], dtype=np.uint8)
WORD, POINT, UPPER, MARK = 1, 2, 4, 8
EMIT = np.array([[POINT, WORD | POINT | UPPER, WORD | POINT | MARK, WORD | POINT, WORD], [POINT, POINT | UPPER, POINT | MARK, POINT, 0]], dtype=np.uint8)
assert (NEXT[OUT] == NEXT[IN]).all()  # what lets all bytes step at once

LONG_WORD = 64
COUNTS = ("n_words", "n_distinct", "n_points", "n_upper", "n_symbols")


class Scan:
    """One pass of the transducer over some texts: what it counts, and the word spans of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        classes = CLASS[raw]
        state = NEXT[OUT][classes]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(raw), dtype=np.uint8)
        before[1:] = state[:-1]
        before[edge[:-1]] = OUT
        out = EMIT.ravel()[before * np.uint8(5) + classes]
        self.raw, self.offsets = raw, offsets
        self.starts = np.flatnonzero(out & WORD)
        after = np.zeros(len(raw), dtype=np.uint8)
        after[:-1] = state[1:]
        after[edge[1:]] = OUT
        self.ends = np.flatnonzero((state == IN) & (after == OUT)) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.points, self.upper, self.symbols = (self._each(out & bit) for bit in (POINT, UPPER, MARK))

    def _each(self, hits: np.ndarray) -> np.ndarray:
        """Number of hits in every text."""
        return np.diff(np.searchsorted(np.flatnonzero(hits), self.offsets))

    def distinct(self) -> np.ndarray:
        """Number of different words of every text."""
        owner = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))
        first = first_spans(self.raw, self.starts, self.ends, owner)
        return np.bincount(owner[first == np.arange(len(first))], minlength=len(self.offsets) - 1)


def equal_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Do the `size` bytes at `a` and at `b` agree?"""
    padded = np.append(raw, np.zeros(8, dtype=np.uint8))
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    todo = np.flatnonzero(size <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        todo = todo[same[todo] & (size[todo] > step)]
        if not len(todo):
            break
        unused = np.uint64(8) * np.maximum(step + 8 - size[todo], 0).astype(np.uint64)
        same[todo] = ((eight[a[todo] + step] ^ eight[b[todo] + step]) << unused) == 0
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        same[i] = np.array_equal(raw[a[i] : a[i] + size[i]], raw[b[i] : b[i] + size[i]])
    return same


def first_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every span the first span of the same owner with the same bytes, from an open hash table of spans.

    All spans are inserted together. A span that meets another in its place shares it if owner, length and bytes agree, and
    else goes on to the next place, so a clash of hashes costs a step and never joins two words.
    """
    n = len(starts)
    size = ends - starts
    hashes = mix(Slices(BYTE_VALUES[0][raw]).hash(starts, ends) ^ mix(owner.astype(np.uint64)))
    places = 1 << max(4, int(2 * n).bit_length())
    place = (hashes & np.uint64(places - 1)).astype(np.int64)
    table = np.full(places, -1, dtype=np.int64)
    first = np.full(n, -1, dtype=np.int64)
    todo = np.arange(n)
    while len(todo):
        free = todo[table[place[todo]] < 0]
        table[place[free][::-1]] = free[::-1]  # of those that want a free place the first gets it
        head = table[place[todo]]
        own = head == todo
        same = own | ((hashes[head] == hashes[todo]) & (owner[head] == owner[todo]) & (size[head] == size[todo]))
        check = np.flatnonzero(same & ~own)
        same[check] = equal_spans(raw, starts[head[check]], starts[todo[check]], size[todo[check]])
        first[todo[same]] = head[same]
        todo = todo[~same]
        place[todo] = (place[todo] + 1) & (places - 1)
    return first


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of `docs`: _id, _part (null: empty), COUNTS and _digest, the SHA-256 of the text.

    Null and empty texts count nothing and share a digest. A task holds 1 MB of texts at a time, or one longer text.
    """
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column(2))
            for a, b in chunks(offsets):
                some = raw[offsets[a] : offsets[b]]
                bounds = offsets[a : b + 1] - offsets[a]
                scan = Scan(some, bounds)
                whole = some.tobytes()
                digests = [hashlib.sha256(whole[i:j]).digest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                numbers = (np.diff(scan.bounds), scan.distinct(), scan.points, scan.upper, scan.symbols)
                columns = [batch.column(0).slice(a, b - a).cast(arrow_kind), batch.column(1).slice(a, b - a), *[pa.array(x, pa.int64()) for x in numbers], pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_part", *COUNTS, "_digest"])

    return rows.mapInArrow(work, f"_id {kind.simpleString()}, _part string, {', '.join(f'{c} long' for c in COUNTS)}, _digest binary")


def mark_repeats(rows: DataFrame) -> DataFrame:
    """Adds _again: does a smaller _id have the same _digest? Rows without an id neither repeat nor are repeated."""
    shared = rows.where("_id is not null").groupBy("_digest").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    joined = rows.join(shared.where("_n > 1").drop("_n"), "_digest", "left")
    return joined.withColumn("_again", F.coalesce(F.col("_id") > F.col("_least"), F.lit(False))).drop("_least")


def interactions(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """What each filter does at each step of every order of the filters, for every part of `rows`.

    `filters` gives for each letter the condition under which a row fails. One row per part, order and step: part,
    filter_order, step, and the numbers kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley. Zero
    counts are rows too; without rows there are no parts and the result is empty.
    """
    letters = sorted(filters)
    failed = sum((F.when(filters[x], 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    sets = rows.select(part.alias("part"), failed.alias("_set"), good.cast("long").alias("_good"), toxic.cast("long").alias("_toxic"))
    counts = sets.groupBy("part", "_set").agg(F.count("*").alias("_n"), F.sum("_good").alias("_g"), F.sum("_toxic").alias("_t"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("_set", "_n", "_g", "_t")).alias("_sets"))

    every = np.arange(1 << len(letters))
    steps = [(order, k + 1, 1 << i, sum(1 << j for j in order[:k])) for order in permutations(range(len(letters))) for k, i in enumerate(order)]
    names = ["".join(letters[i] for i in order) for order, *_ in steps]
    bit, before = (np.array([s[i] for s in steps])[:, None] for i in (2, 3))
    fails, gone = (every & bit) > 0, (every & before) > 0
    removes, keeps, late, alone = fails & ~gone, ~fails & ~gone, fails & gone, every[None, :] == bit
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(x, pa.int64()) for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, g, t = (np.zeros(len(every), dtype=np.int64) for _ in range(3))
                for s in row["_sets"]:
                    n[s["_set"]], g[s["_set"]], t[s["_set"]] = s["_n"], s["_g"], s["_t"]
                removed = removes @ n
                shapley = sum(np.where(bit[:, 0] == b, removed[bit[:, 0] == b].sum(), 0) for b in np.unique(bit))
                numbers = (keeps @ n, removed, late @ n, alone @ n, removes @ g, removes @ t, shapley)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(steps)), pa.array(names), pa.array([s[1] for s in steps], pa.int32()), *[pa.array(x, pa.int64()) for x in numbers]], schema=schema)

    return parts.mapInArrow(work, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of five filters over whole texts, for every value of `part_col` (null: the empty string).

    A: under 200 words; B: under half of the words differ; C: over 2 % of the code points are capitals; D: one of `#$%&*|`;
    E: a smaller id has the identical text (told by SHA-256), whether that row is removed or not. Null texts are empty. Rows
    without an id fail no E and have no labels; an id with several rows in `labels` is good or toxic if one of them says so.
    Repeated rows all count. Only the named columns are read. An empty table gives an empty result.
    """
    rows = materialize(text_counts(docs, id_col, text_col, part_col), "counts")
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    marked = mark_repeats(rows)
    # rows without an id would all meet in one place of the join
    known = marked.where("_id is not null").join(rated, "_id", "left")
    unknown = marked.where("_id is null").withColumns({"_good": F.lit(False), "_toxic": F.lit(False)})
    filters = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 2 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("_again"),
    }
    return interactions(known.unionByName(unknown), filters, F.col("_part"), F.coalesce("_good", F.lit(False)), F.coalesce("_toxic", F.lit(False)))
