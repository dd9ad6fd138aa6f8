"""Repeated word passages by backward search in a compressed FM-index per shard.

Each shard indexes its distinct passages: the Burrows-Wheeler transform of their words lies in a wavelet matrix of bit
rows with popcount ranks. Passages are streamed through the index from their last word to the first; backward search,
with a step to the parent interval where a word does not fit, gives the matching statistics of every place. Places
whose statistic reaches a window are reported with the smallest document of their interval.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.repeats import WORDS_50, Entries, Unit, apply_covers, find_covers
from opslens.llm.suffix_dedup import spread, untouched
from opslens.llm.tokens import Words, column_bytes
from opslens.session import materialize


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit row per bit of the symbols: packed bits and their counts per 64."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.rows = []
        current = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, dtype=np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.rows.append((words, counts, len(bit) - int(counts[-1])))
            current = np.concatenate([current[~bit], current[bit]])
        # where each symbol's block begins after the last level
        self.first = np.searchsorted(self._reversed(current), self._reversed(np.arange(symbols)))

    def _reversed(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for level in range(self.levels):
            out |= ((values >> level) & 1) << (self.levels - 1 - level)
        return out

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = place
        for level, (words, counts, zeros) in zip(range(self.levels - 1, -1, -1), self.rows, strict=True):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << inside) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; `text` must end in a symbol of its own."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while step < 2 * n:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class FMIndex:
    """Index over sequences of symbols 0, 1, 2, ...; matches never cross from one sequence to the next.

    `limit` bounds match lengths: a longer match is shortened to it, with the interval of its first `limit` symbols.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, limit: int):
        count = len(offsets) - 1
        self.limit, self.sequences = limit, count
        size = np.diff(offsets)
        n = len(symbols) + count
        # an own separator after each sequence, smaller than all symbols
        text = np.empty(n, dtype=np.int64)
        stops = offsets[1:] + np.arange(count)
        is_stop = np.zeros(n, dtype=bool)
        is_stop[stops] = True
        text[is_stop] = np.arange(count)
        text[~is_stop] = symbols + count
        self.n = n
        self.order = suffix_order(text)
        self.owner = np.repeat(np.arange(count), size + 1)[self.order]
        last = text[self.order - 1]  # before the first symbol stands the last separator
        self.alphabet = int(symbols.max(initial=-1)) + 1
        # all separators are one symbol in the matrix: nobody searches for them
        self.matrix = WaveletMatrix(np.maximum(last - count + 1, 0), self.alphabet + 1)
        counts = np.bincount(symbols, minlength=self.alphabet)
        self.below = count + np.cumsum(counts) - counts

        # common prefixes of neighbours, up to limit
        self.lcp = np.zeros(n + 1, dtype=np.int64)
        active = np.arange(1, n)
        a, b = self.order[:-1], self.order[1:]
        for depth in range(limit):
            pos = a[active - 1] + depth
            same = (pos < n) & (b[active - 1] + depth < n)
            pos = np.minimum(pos, n - 1)
            other = np.minimum(b[active - 1] + depth, n - 1)
            active = active[same & (text[pos] == text[other])]
            if not len(active):
                break
            self.lcp[active] = depth + 1
        edges = np.flatnonzero(self.lcp[:n] < limit)
        self.block = np.searchsorted(edges, np.arange(n), side="right") - 1
        self.block_start = edges
        self.block_end = np.append(edges[1:], n)
        self._parents: tuple[np.ndarray, np.ndarray] | None = None

    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place, the nearest places before and after it with a smaller common prefix."""
        if self._parents is None:
            places = np.arange(self.n + 1)
            before, after = np.zeros(self.n + 1, np.int64), np.full(self.n + 1, self.n, np.int64)
            lcp = self.lcp.copy()
            lcp[self.n] = -1
            lcp[0] = -1
            for value in range(int(self.lcp.max()) + 1):
                mine = np.flatnonzero(lcp == value)
                if not len(mine):
                    continue
                smaller = np.where(lcp < value, places, -1)
                before[mine] = np.maximum.accumulate(smaller)[mine]
                larger = np.where(lcp < value, places, self.n)
                after[mine] = np.minimum.accumulate(larger[::-1])[::-1][mine]
            self._parents = before, after
        return self._parents

    def matching_statistics(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the streamed sequences the longest match that starts there (limit at most) and the first place
        of its interval. Unknown symbols are negative. All sequences advance together, one word a step.
        """
        length, found = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        by_size = np.argsort(-np.diff(offsets), kind="stable")
        ends = offsets[1:][by_size]
        size = np.diff(offsets)[by_size]
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        have = np.zeros(len(ends), np.int64)
        for step in range(int(size.max(initial=0))):
            lanes = int(np.searchsorted(-size, -step, side="left"))  # sequences longer than step
            place = ends[:lanes] - 1 - step
            symbol = symbols[place]
            todo = np.arange(lanes)
            known = (symbol >= 0) & (symbol < self.alphabet)
            lost = todo[~known]
            low[lost], high[lost], have[lost] = 0, self.n, 0
            todo = todo[known]
            while len(todo):
                wanted = symbol[todo]
                both = self.matrix.rank(np.tile(wanted + 1, 2), np.concatenate([low[todo], high[todo]]))
                new_low, new_high = self.below[wanted] + both[: len(todo)], self.below[wanted] + both[len(todo) :]
                fits = new_high > new_low
                good = todo[fits]
                low[good], high[good] = new_low[fits], new_high[fits]
                have[good] += 1
                todo = todo[~fits]
                todo = todo[have[todo] > 0]
                if len(todo):
                    before, after = self.parents()
                    left, right = self.lcp[low[todo]], self.lcp[np.minimum(high[todo], self.n)]
                    left = np.where(low[todo] == 0, 0, left)
                    right = np.where(high[todo] == self.n, 0, right)
                    at = np.where(left >= right, low[todo], high[todo])
                    depth = np.maximum(left, right)
                    low[todo] = np.where(depth > 0, before[at], 0)
                    high[todo] = np.where(depth > 0, after[at], self.n)
                    have[todo] = depth
            over = np.flatnonzero(have[:lanes] > self.limit)
            if len(over):
                block = self.block[low[over]]
                low[over], high[over], have[over] = self.block_start[block], self.block_end[block], self.limit
            at_limit = np.flatnonzero(have[:lanes] == self.limit)
            if len(at_limit):
                block = self.block[low[at_limit]]
                low[at_limit], high[at_limit] = self.block_start[block], self.block_end[block]
            length[place], found[place] = have[:lanes], low[:lanes]
        return length, found


def fm_covers(entries: Entries, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (document, start, words) whose words also start in a smaller document."""
    raw = np.frombuffer(entries.data, dtype=np.uint8)
    offsets = np.append(0, np.cumsum(entries.size))
    words = Words(raw, offsets)
    codes = words.coded()[0].astype(np.int32)
    bounds = words.text_offsets
    # passages are equal when their words are, whatever stands between these; words and passages are told apart by all their bytes
    ends = bounds[1:]
    whole, known = codes.tobytes(), {}
    which = np.array([known.setdefault(whole[4 * a : 4 * b], len(known)) for a, b in zip(bounds[:-1].tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    lead = np.unique(which, return_index=True)[1]
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, which, entries.doc)
    later = entries.doc > least[which]
    doc, start = [entries.doc[later]], [entries.start[later]]
    size = [entries.count[later] + unit.window - 1]

    length = (ends - bounds[:-1])[lead]
    _, at = spread(bounds[:-1][lead], length)
    _, symbols = np.unique(codes[at], return_inverse=True)
    inner = np.append(0, np.cumsum(length))
    index = FMIndex(symbols.astype(np.int64), inner, unit.window)
    matched, low = index.matching_statistics(symbols.astype(np.int64), inner)
    smallest = np.minimum.reduceat(least[index.owner], index.block_start)
    owner = np.repeat(np.arange(len(lead)), length)
    place = np.arange(len(symbols)) - inner[:-1][owner]
    hit = np.flatnonzero((matched == unit.window) & (smallest[index.block[low]] < least[owner]))
    if len(hit):
        leads = np.flatnonzero(~later)
        leads = leads[np.argsort(which[leads], kind="stable")]
        from_, to = np.searchsorted(which[leads], owner[hit], side="left"), np.searchsorted(which[leads], owner[hit], side="right")
        again, chosen = spread(from_, to - from_)
        entry = leads[chosen]
        doc.append(entries.doc[entry])
        start.append(entries.start[entry] + place[hit][again])
        size.append(np.full(len(entry), unit.window))
    return np.concatenate(doc), np.concatenate(start), np.concatenate(size)


def kept_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every text joined by single spaces: bytes and offsets."""
    raw, offsets = words.raw, words.offsets
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(inside, words.starts[keep], 1)
    np.add.at(inside, words.ends[keep], -1)
    chosen = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    # the byte before a kept word becomes its space, unless the word is the first that its text keeps
    owner = words.text_of_word()[keep]
    later = np.append(False, owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
    space = words.starts[keep][later] - 1
    out = raw.copy()
    out[space] = 0x20
    chosen[space] = True
    total = np.append(0, np.cumsum(chosen))
    return out[chosen], total[offsets]


RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]


def covered_words(words: Words, spans: list) -> np.ndarray:
    edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
    for base, (starts, ends) in zip(words.text_offsets[:-1].tolist(), spans, strict=True):
        if len(starts):
            edge[base + starts] += 1
            edge[base + ends] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_word_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = WORDS_50) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    A word goes if it lies in a window of `unit.window` words that also starts in a document with a smaller id, judged on
    the texts as they come in. Null, empty and shorter texts lose nothing. Rows with a null id lose nothing and
    cover nothing. An id names one text: rows that repeat both share their result. Other columns are not read.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    dealt, covers = find_covers(named, unit, fm_covers)

    def summarise(texts: pa.Table, spans: list) -> pa.Table:
        raw, offsets = column_bytes(texts.column("_text"))
        words = Words(raw, offsets)
        gone = covered_words(words, spans)
        data, ends = kept_words(words, ~gone)
        whole = data.tobytes()
        total = np.append(0, np.cumsum(gone))[words.text_offsets]
        digests = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        arrays = [texts.column("_id"), pa.array(np.diff(words.text_offsets), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(arrays, names=["_id", *[n for n, _ in RESULT]])

    schema = "_id long, n_words long, n_removed long, kept_sha256 string"
    whole = apply_covers(dealt, covers, summarise, schema).unionByName(untouched(named, summarise, schema))
    return whole.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("_id", id_col)


def strip_word_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = WORDS_50) -> DataFrame:
    """`docs` with repeated passages taken out of the text; all columns stay.

    A text that loses words becomes its other words joined by single spaces; it goes altogether if none are left. Every
    other text stays as it is, null and empty ones too. If there is a column n_chars, it is set to the new length. Rows without an id, and
    rows whose id also names another text, are matched with nothing and keep their text; rows that repeat id and text share their result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    digest = F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256)
    two_texts = materialize(named.where("_id is not null").groupBy("_id").agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b").select("_id"), "two-texts")
    if not two_texts.isEmpty():
        named = named.join(two_texts, "_id", "left_anti")
    dealt, covers = find_covers(named, unit, fm_covers)

    def rewrite(texts: pa.Table, spans: list) -> pa.Table:
        hit = [i for i, (starts, _) in enumerate(spans) if len(starts)]
        some = texts.take(pa.array(hit, pa.int64()))
        raw, offsets = column_bytes(some.column("_text"))
        words = Words(raw, offsets)
        data, ends = kept_words(words, ~covered_words(words, [spans[i] for i in hit]))
        whole = data.tobytes()
        new = [whole[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([some.column("_id"), pa.array(new, pa.string())], names=["_changed", "_new"])

    changed = apply_covers(dealt, covers, rewrite, "_changed long, _new string").dropDuplicates(["_changed"])
    new, hit = changed["_new"], changed["_changed"].isNotNull()
    joined = docs.join(changed, docs[id_col].cast("long") == changed["_changed"], "left").where(new.isNull() | (new != ""))
    text = F.when(hit, new).otherwise(docs[text_col]).alias(text_col)
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(text)
        elif name == "n_chars" and text_col == "text":
            columns.append(F.when(hit, F.char_length(new).cast(docs.schema[name].dataType)).otherwise(docs[name]).alias(name))
        else:
            columns.append(docs[name])
    return joined.select(*columns)
