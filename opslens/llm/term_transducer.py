"""Source divergence audit over a vocabulary held as minimal acyclic transducers.

1. Terms are counted by document, and each language keeps those of enough documents.
2. The kept terms are sorted; every sorted piece becomes a minimal acyclic automaton whose transitions carry how many terms
   stand before them, so that a walk along a term adds up its ordinal, its place among the language's terms in byte order.
3. Texts are streamed through the automata a second time and counted by ordinal. Only numbers travel from here on.
4. Smoothed shares of each source and language are compared in blocks of ordinals. Ordinals break ties, and a walk down the
   counts of an automaton spells the term of an ordinal.

Vocabularies larger than VOCABULARY_BYTES are used in several passes over the texts, each with a part that fits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.scale import top_per_key
from opslens.llm.tokens import Words, chunks, column_bytes
from opslens.session import materialize

#: bytes outside `[A-Za-z]` and the bytes of code points from 128 on
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[0x41:0x5B] = NO_LETTER[0x61:0x7B] = NO_LETTER[0x80:] = False

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
TEXT_BYTES = 4 << 20
PIECE_TERMS = 50_000
VOCABULARY_BYTES = 64 << 20
#: terms of a block, and numbers of a block's table of sources and terms, at most
BLOCK_TERMS = 1024
BLOCK_CELLS = 1 << 20


@dataclass
class Transducer:
    """Transitions in order of state and byte: `keys` are state * 256 + byte, with the next state and the number of accepted
    words that leave the state before the transition. `final` says whether a state ends a word.
    """

    keys: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    root: int
    size: int

    @classmethod
    def build(cls, words: Iterator[bytes]) -> "Transducer":
        """The minimal automaton of rising, distinct words. States that accept the same endings are one, found when a branch is complete."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        numbers: list[int] = []
        path: list[list] = [[False, []]]  # of the last word: is a word, finished transitions
        last = b""
        size = 0

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                ended = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(ended)))

        def freeze(state: list) -> int:
            shape = (state[0], tuple(state[1]))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
                numbers.append(state[0] + sum(numbers[to] for _, to in state[1]))
            return known[shape]

        for word in words:
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            if size and (word <= last):
                raise ValueError("words must be distinct and rise")
            close(common)
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
            size += 1
        close(0)
        root = freeze(path[0])
        keys, target, output = [], [], []
        for number, (is_word, steps) in enumerate(states):
            before = int(is_word)
            for byte, to in steps:
                keys.append(number * 256 + byte)
                target.append(to)
                output.append(before)
                before += numbers[to]
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(output, np.int64), np.array([s[0] for s in states], bool), root, size)

    def dump(self) -> bytes:
        return pickle.dumps((self.keys, self.target, self.output, self.final, self.root, self.size))

    @classmethod
    def load(cls, data: bytes) -> "Transducer":
        return cls(*pickle.loads(data))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ordinal of each word (bytes of `data`), -1 if it is not accepted. All words advance together, a byte a step."""
        out = np.full(len(starts), -1, dtype=np.int64)
        state = np.full(len(starts), self.root, dtype=np.int64)
        total = np.zeros(len(starts), dtype=np.int64)
        alive, depth = np.arange(len(starts)), 0
        while len(alive):
            ended = sizes[alive] == depth
            done = alive[ended]
            good = done[self.final[state[done]]]
            out[good] = total[good]
            alive = alive[~ended]
            if not len(self.keys):
                break
            key = state[alive] * 256 + data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            state[alive] = self.target[at]
            total[alive] += self.output[at]
            depth += 1
        return out

    def word(self, ordinal: int) -> bytes:
        """The word with this ordinal."""
        if not 0 <= ordinal < self.size:
            raise IndexError(ordinal)
        state, out = self.root, bytearray()
        while True:
            first, behind = np.searchsorted(self.keys, [state * 256, state * 256 + 256])
            if self.final[state] and ordinal == 0:
                return bytes(out)
            at = first + int(np.searchsorted(self.output[first:behind], ordinal, side="right")) - 1
            out.append(int(self.keys[at]) & 255)
            ordinal -= int(self.output[at])
            state = int(self.target[at])


@dataclass(frozen=True)
class Piece:
    """A sorted piece of a language's kept terms: its number in the table of pieces and the ordinal of its first term."""

    number: int
    lang: str
    first: int
    terms: int
    size: int


class Vocabulary:
    """Kept terms (lang, term) as a written table of transducers, and the list of its pieces, one for up to PIECE_TERMS terms."""

    def __init__(self, kept: DataFrame, piece_terms: int = PIECE_TERMS, most: int = VOCABULARY_BYTES):
        self.spark, self.most = kept.sparkSession, most
        parts = max(1, -(-kept.count() // piece_terms))
        ordered = kept.select("lang", "term").repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = ((lang, term.encode()) for batch in batches for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            held = next(rows, None)
            while held is not None:
                lang, first, taken = *held, 0

                def some(lang=lang):
                    nonlocal held, taken
                    while held is not None and held[0] == lang and taken < piece_terms:
                        yield held[1]
                        taken += 1
                        held = next(rows, None)

                made = Transducer.build(some())
                data = made.dump()
                row = [lang, TaskContext.get().partitionId(), first, made.size, len(data), data]
                types = (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["lang", "part", "first", "terms", "size", "data"])

        self.table = materialize(ordered.mapInArrow(work, "lang string, part int, first binary, terms long, size long, data binary"), "transducers")
        self.pieces, ordinal, before = [], 0, None
        # one row for 50,000 terms
        for number, row in enumerate(self.table.select("lang", "terms", "size").orderBy("lang", "first").toLocalIterator()):
            ordinal = ordinal if row["lang"] == before else 0
            self.pieces.append(Piece(number, row["lang"], ordinal, row["terms"], row["size"]))
            ordinal, before = ordinal + row["terms"], row["lang"]

    def passes(self) -> Iterator[dict[str, list[tuple[int, Transducer]]]]:
        """The transducers by language with their first ordinals, as many at a time as fit into `most` bytes; at least one pass."""
        part, held, size = {}, 0, 0
        rows = self.table.select("lang", "data").orderBy("lang", "first").toLocalIterator()
        for piece, row in zip(self.pieces, rows, strict=True):
            if held and size + piece.size > self.most:
                yield part
                part, held, size = {}, 0, 0
            part.setdefault(piece.lang, []).append((piece.first, Transducer.load(row["data"])))
            held, size = held + 1, size + piece.size
        yield part

    def in_passes(self, make: Callable[[object], DataFrame], name: str) -> DataFrame:
        """The rows of `make(shared transducers)` for every pass, each written before the next is sent."""
        out = None
        for part in self.passes():
            shared = self.spark.sparkContext.broadcast(part)
            some = materialize(make(shared), name)
            shared.unpersist()
            out = some if out is None else out.unionByName(some)
        return out

    def spell(self, rows: DataFrame) -> DataFrame:
        """`rows` (lang, source, ordinal, value, rank) with the term of each ordinal as `item`."""
        schema = "lang string, source string, item string, value long, rank int"

        def make(shared) -> DataFrame:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = []
                    for lang, source, ordinal, value, rank in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        for first, made in shared.value.get(lang, ()):
                            if first <= ordinal < first + made.size:
                                out.append((lang, source, made.word(ordinal - first).decode(), value, rank))
                    columns = list(zip(*out, strict=True)) or [()] * 5
                    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "source", "item", "value", "rank"])

            return rows.select("lang", "source", "ordinal", "value", "rank").mapInArrow(work, schema)

        return self.in_passes(make, "spelled")


def letter_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(raw, offsets, lower=True, separator=NO_LETTER)


def prepared(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("_lang", lang_col), ("_source", source_col), ("_text", text_col))])


def document_counts(rows: DataFrame) -> DataFrame:
    """lang, term and the number of its documents, summed by batch; add them up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()
            raw, offsets = column_bytes(batch.column(1))
            found = []
            for a, b in chunks(offsets, TEXT_BYTES):
                words = letter_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                codes, terms = words.coded()
                if not len(terms):
                    continue
                pairs = np.unique(words.text_of_word() * len(terms) + codes)
                pairs, times = np.unique(lang[a + pairs // len(terms)].astype(np.int64) * len(terms) + pairs % len(terms), return_counts=True)
                found.append(pa.table({"lang": pairs // len(terms), "term": terms.take(pa.array(pairs % len(terms))), "docs": times}))
            if found:
                summed = pa.concat_tables(found).group_by(["lang", "term"]).aggregate([("docs", "sum")]).combine_chunks()
                names = langs.dictionary.take(summed.column("lang").combine_chunks())
                yield from pa.table({"lang": names, "term": summed.column("term").cast(pa.large_string()).cast(pa.string()), "docs": summed.column("docs_sum")}).to_batches(max_chunksize=100_000)

    return rows.select("_lang", "_text").mapInArrow(work, "lang string, term string, docs long")


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang and term of every term in at least `min_docs` documents of the language."""
    return document_counts(rows).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def recount(rows: DataFrame, shared) -> DataFrame:
    """lang, source, ordinal and count of the kept terms, summed by batch; add them up. Words that stand often are walked once for each piece of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            groups = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            raw, offsets = column_bytes(batch.column(2))
            held = []
            for a, b in chunks(offsets, TEXT_BYTES):
                words = letter_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                codes, terms = words.coded()
                if not len(terms):
                    continue
                pairs, times = np.unique(np.repeat(groups[a:b], np.diff(words.text_offsets)) * len(terms) + codes, return_counts=True)
                group, code = pairs // len(terms), pairs % len(terms)
                data, bounds = column_bytes(terms)
                for number, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = group // len(sources.dictionary) == number
                    asked = np.unique(code[mine])
                    for first, made in shared.value.get(lang, ()) if len(asked) else ():
                        place = np.full(len(terms), -1, dtype=np.int64)
                        place[asked] = made.ordinals(data, bounds[asked], bounds[asked + 1] - bounds[asked])
                        hit = mine & (place[code] >= 0)
                        held.append((group[hit], first + place[code[hit]], times[hit]))
            if held:
                group, ordinal, times = (np.concatenate([h[i] for h in held]) for i in range(3))
                summed = pa.table({"group": group, "ordinal": ordinal, "n": times}).group_by(["group", "ordinal"]).aggregate([("n", "sum")]).combine_chunks()
                group = summed.column("group").to_numpy()
                names = [d.dictionary.take(pa.array(i)) for d, i in ((langs, group // len(sources.dictionary)), (sources, group % len(sources.dictionary)))]
                yield from pa.table({"lang": names[0], "source": names[1], "ordinal": summed.column("ordinal"), "count": summed.column("n_sum")}).to_batches(max_chunksize=100_000)

    return rows.select("_lang", "_source", "_text").mapInArrow(work, "lang string, source string, ordinal long, count long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR)
    return F.lit(1) + F.call_function("div", above, wide(total + PRIOR * terms))


def pair_sums(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and the sum of abs(p - q) over all kept terms of the language, in blocks of ordinals.

    `counted` has lang, source, ordinal, p of the terms that occur; `groups` has lang, source, zero (the p of a term that does not
    occur), terms, sources. A block is a table of all sources of a language and so many terms that it has BLOCK_CELLS numbers at most.
    """
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TERMS), F.floor(F.lit(BLOCK_CELLS) / F.col("sources")))).cast("long")
    sized = groups.withColumn("_width", width)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("terms") / F.col("_width")).cast("long") - 1)))
    frames = sized.select("lang", "source", "zero", blocks.alias("_block"), F.least(F.col("_width"), F.col("terms")).alias("_wide"), "terms", "_width")
    cells = counted.join(sized.select("lang", "source", "_width"), ["lang", "source"]).select("lang", "source", "p", F.floor(F.col("ordinal") / F.col("_width")).alias("_block"), (F.col("ordinal") % F.col("_width")).alias("_at"))

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = sorted(right.column("source").to_pylist())
        number = {name: i for i, name in enumerate(names)}
        zero = np.zeros(len(names), dtype=np.int64)
        zero[[number[s] for s in right.column("source").to_pylist()]] = right.column("zero").to_numpy()
        wide = int(min(right.column("_width")[0].as_py(), right.column("terms")[0].as_py() - right.column("_block")[0].as_py() * right.column("_width")[0].as_py()))
        table = np.repeat(zero[:, None], wide, axis=1)
        table[[number[s] for s in left.column("source").to_pylist()], left.column("_at").to_numpy()] = left.column("p").to_numpy()
        sums = np.array([np.abs(table - row).sum(axis=1) for row in table], dtype=np.int64).reshape(len(names), len(names))
        one, other = np.nonzero(~np.eye(len(names), dtype=bool))
        listed = pa.array(names, pa.string())
        return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()), "source": listed.take(pa.array(one)), "item": listed.take(pa.array(other)), "value": sums[one, other]})

    pairs = cells.groupBy("lang", "_block").cogroup(frames.groupBy("lang", "_block"))
    parts = pairs.applyInArrow(work, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, **sizes: int) -> DataFrame:
    """How far the sources of each language are apart: rows lang, source, part, item, value, rank.

    Terms are runs of letters A-Z without case and code points from 128 on. A language keeps the terms of at least `min_docs` of its
    documents; p is the smoothed share of a kept term in a source. Part `pair`: every other source of the language with the
    sum of abs(p - q) over all kept terms, 0 if there are none. Part `term`: the first `top` terms that occur in the source and have a
    larger share there than in the language, by the difference. Ranks go by value, then by the bytes of the item. Null text,
    lang and source are empty strings; repeated rows count again; only the named columns are read; an empty table gives an empty result.
    `sizes` are piece_terms and most of `Vocabulary`.
    """
    rows = prepared(docs, text_col, lang_col, source_col)
    words = Vocabulary(materialize(kept_terms(rows, min_docs), "kept"), **sizes)
    found = words.in_passes(lambda shared: recount(rows, shared), "recount")
    counted = materialize(found.groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count")), "counts")

    spark = docs.sparkSession
    kept: dict[str, int] = {}
    for piece in words.pieces:
        kept[piece.lang] = kept.get(piece.lang, 0) + piece.terms
    terms = spark.createDataFrame(sorted(kept.items()), "lang string, terms long")
    seen = rows.groupBy(F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(F.count("*").alias("_rows")).drop("_rows")
    totals = counted.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    none = F.lit(0).cast("long")
    groups = seen.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").withColumns({"total": F.coalesce("total", none), "terms": F.coalesce("terms", none)})
    by_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total"))
    zero = F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).otherwise(none)
    groups = materialize(groups.join(by_lang, "lang").withColumn("zero", zero), "groups")

    in_lang = F.sum("count").over(Window.partitionBy("lang", "ordinal"))
    shares = counted.withColumn("lang_count", in_lang).join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    shares = shares.select("lang", "source", "ordinal", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("q"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(shares.select("lang", "source", "ordinal", "p"), groups).withColumn("rank", F.row_number().over(by_value))
    above = shares.where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    first = top_per_key(above, ["lang", "source"], [F.desc("value"), F.col("ordinal")], top, out="rank")
    spelled = words.spell(materialize(first.select("lang", "source", "ordinal", "value", "rank"), "first"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(spelled.withColumn("part", F.lit("term")).select(*columns))
