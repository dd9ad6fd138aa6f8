"""Candidate passages for the two repeat finders: windows of a fixed length that may also stand in another document.

A window of `window` symbols contains window - gram + 1 grams; the smallest gram hash is its anchor. Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so a text falls into few runs of windows with one anchor.

1. `repeated_anchors`: the distinct anchors of the documents meet by hash; those of at least two documents are repeated.
   Windows of all other anchors are unique and need no more work.
2. `Candidates.passages`: for each run with a repeated anchor, the passage of text under its windows. Passages go to
   shards by anchor, so equal windows always meet in one shard whatever surrounds them.
3. a finder builds its index over the passages of a shard and says which windows also start in a smaller document.
4. `apply_covers`: the covered stretches return to their documents.

Hot passages: a task sends an anchor or a passage once for all its documents, so what meets in one place grows with the
number of tasks, not of documents. Anchors that very many documents share with different surroundings are cut into
single windows, which are dealt by the hash of the whole window and shrink to the distinct ones in every task. Rows are
packed: one row carries the entries of one task for one bucket as columns of bytes, the planes of each number together.
There are as many buckets, blocks and shards as shuffle partitions, and each is one partition, so all are alike in size.
A shard is cut again by hash, and a finder gets as many of these cuts at a time as make up INDEX_BYTES of passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.tokens import BYTE_VALUES, CHUNK_BYTES, Slices, Words, chunks, column_bytes, give_back, grams, mix, window_min
from opslens.session import materialize

# anchors are told apart by 48 bits; a clash only adds a candidate
ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF)
HOT_DOCS = 1000
CUTS = 64
INDEX_BYTES = 2 << 20
# and at least one in so many of all pairs of anchor and document, which bounds the list of hot anchors that every task gets
HOT_SHARE = 1_000_000
# a task hands on packed rows in batches of so many bytes, and makes Python numbers of so many values at a time
BATCH_BYTES = 4 << 20
PIECE = 1 << 16


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes, then all second bytes: equal high bytes then compress to nothing."""
    return np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


@dataclass
class Unit:
    """What a window counts: bytes or words."""

    words: bool
    window: int
    gram: int

    @property
    def most(self) -> int:
        """Windows of a run at most, unless the text is periodic."""
        return self.window - self.gram + 1

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words | None]:
        """Symbol hashes, where each text's symbols begin, and the words if symbols are words."""
        if not self.words:
            return BYTE_VALUES[0][raw], offsets, None
        words = Words(raw, offsets)
        return words.hashes(), words.text_offsets, words


BYTES_50 = Unit(words=False, window=50, gram=24)
WORDS_50 = Unit(words=True, window=50, gram=12)


@dataclass
class Runs:
    """Runs of windows with one anchor: text, first window (symbol place in the chunk), number of windows, anchor, and how many
    windows of the run follow those of a piece that was cut off.
    """

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    after: np.ndarray

    def times(self, symbols: np.ndarray, unit: Unit) -> np.ndarray:
        """How often a run's anchor stands below its windows. Equal windows of a run have their anchors at different places."""
        found = grams(symbols, unit.gram) & ANCHOR_BITS
        out = np.zeros(len(self.first), dtype=np.int64)
        reach = self.count + unit.window - unit.gram
        for step in range(int(reach.max(initial=0))):
            inside = np.flatnonzero(reach > step)
            out[inside] += found[self.first[inside] + step] == self.anchor[inside]
        return out


def window_runs(symbols: np.ndarray, offsets: np.ndarray, unit: Unit) -> Runs:
    width = unit.most
    anchors = window_min(grams(symbols, unit.gram), width) & ANCHOR_BITS
    n = len(anchors)
    valid = np.zeros(n + 1, dtype=np.int8)
    ends = offsets[1:] - unit.window + 1
    has = ends > offsets[:-1]
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, ends[has], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    change = np.ones(n, dtype=bool)
    if n:
        change[1:] = anchors[1:] != anchors[:-1]
        starts_text = offsets[:-1][has]
        change[starts_text] = True
        change[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    good = valid[first] if n else np.zeros(0, dtype=bool)
    first, count = first[good], count[good]
    # runs over periodic text are long: cut them
    most = width
    after = np.zeros(len(count), dtype=np.int64)
    if len(count) and count.max() > most:
        pieces = -(-count // most)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + inner * most
        rest = np.repeat(count, pieces) - inner * most
        count = np.minimum(rest, most)
        after = rest - count
    text = np.searchsorted(offsets, first, side="right") - 1
    return Runs(text, first, count, anchors[first], after)


def text_chunks(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, offsets = column_bytes(batch_column)
    for a, b in chunks(offsets, CHUNK_BYTES):
        yield a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeated_anchors(docs: DataFrame, unit: Unit, blocks: int, within: bool = False) -> DataFrame:
    """Packed rows (block, docs, anchors): which documents have which repeated anchors. Rows with block -1 name the hot
    anchors and row -2 holds the number of all pairs of anchor and document. `docs` has _id (long, not null) and _text. With `within`, anchors that stand
    twice in one document are repeated too, and places count instead of documents.
    """
    buckets = parts_of(docs)
    schema = "bucket int, anchors binary, docs binary, counts binary"
    sent_schema = pa.schema([("bucket", pa.int32()), *[(x, pa.binary()) for x in ("anchors", "docs", "counts")]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found, owners, times = [], [], []
            for row, raw, offsets in text_chunks(batch.column(1)):
                symbols, places, _ = unit.symbols(raw, offsets)
                runs = window_runs(symbols, places, unit)
                found.append(runs.anchor)
                owners.append(ids[row + runs.text])
                times.append(runs.times(symbols, unit) if within else np.zeros(0, np.int64))
            if not found:
                continue
            anchor, owner = np.concatenate(found), np.concatenate(owners)
            del found, owners, symbols, runs
            order = np.lexsort((owner, anchor))
            anchor, owner = anchor[order], owner[order]
            places = np.concatenate(times)[order] if within else None
            if within and len(anchor):
                places = np.add.reduceat(places, np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])))
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            anchor, owner = anchor[new], owner[new]
            del order, new, times
            first = np.ones(len(anchor), dtype=bool)
            first[1:] = anchor[1:] != anchor[:-1]
            starts = np.flatnonzero(first)
            count = places if within else np.diff(np.append(starts, len(anchor)))
            # one entry per anchor asks for the others; the documents behind it already know that it is repeated
            later = ~first
            out = Rows(sent_schema)
            if later.any():
                # these only pass through, anywhere
                out.add((int(batch.num_rows + later.sum()) % buckets, planes(anchor[later]), planes(owner[later]), None))
            anchor, owner = anchor[starts], owner[starts]
            del first, later, starts
            bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((anchor, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    out.add((int(bucket[part[0]]), planes(anchor[part]), planes(owner[part]), planes(count[part].astype(np.uint32))))
                    yield from out.full()
            del anchor, owner, count, places, bucket, order, cuts, part
            yield from out.taken()
            give_back()

    result = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("anchors", pa.binary()), ("total", pa.int64())])

    def packed(owner: np.ndarray, anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = block_of(owner, blocks)
        order = np.lexsort((anchor, owner, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        out = Rows(result)
        for p in np.split(order, cuts):
            if len(p):
                out.add((int(block[p[0]]), planes(owner[p]), planes(anchor[p]), None))
                yield from out.full()
        yield from out.taken()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, owners, counts, extra = [], [], [], []
        for batch in batches:
            for row in packed_rows(batch):
                a, o = unplanes(row["anchors"], "<u8"), unplanes(row["docs"], "<i8")
                if row["counts"] is None:
                    extra.append((o, a))
                    continue
                anchors.append(a)
                owners.append(o)
                counts.append(unplanes(row["counts"], "<u4"))
        batch = row = None
        known_o, known_a = (np.concatenate([x[i] for x in extra]) if extra else np.zeros(0, np.int64) for i in (0, 1))
        if not anchors:
            if len(known_o):
                yield from packed(known_o, known_a.astype(np.uint64))
            return
        anchor, owner, count = map(np.concatenate, (anchors, owners, counts))
        del anchors, owners, counts, extra
        order = np.argsort(anchor, kind="stable")
        anchor, owner, count = anchor[order], owner[order], count[order]
        del order
        starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        total = np.add.reduceat(count.astype(np.int64), starts)
        size = np.diff(np.append(starts, len(anchor)))
        shared = np.repeat(total > 1, size)
        del count, size
        yield from packed(np.concatenate([owner[shared], known_o]), np.concatenate([anchor[shared], known_a.astype(np.uint64)]))
        hot = total >= HOT_DOCS
        rows = [(-2, None, None, int(total.sum()))]
        if hot.any():
            rows.append((-1, planes(total[hot].astype(np.int64)), planes(anchor[starts][hot]), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), result.types, strict=True)], schema=result)
        del anchor, owner, known_o, known_a, shared
        give_back()

    sent = docs.select("_id", "_text").mapInArrow(gather, schema).repartitionById(buckets, "bucket")
    return sent.mapInArrow(meet, "block int, docs binary, anchors binary, total long")


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def hot_anchors(found: DataFrame) -> np.ndarray:
    """Sorted anchors of at least HOT_DOCS documents that also have one in HOT_SHARE of all pairs: at most HOT_SHARE."""
    total = found.where("block = -2").agg(F.sum("total")).first()[0] or 0
    least = max(HOT_DOCS, -(-total // HOT_SHARE))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [unplanes(a, "<u8")[unplanes(n, "<i8") >= least] for n, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in some], pa.binary())], ["anchors"])

    rows = found.where("block = -1").select("docs", "anchors").mapInArrow(pick, "anchors binary").collect()
    return np.sort(np.frombuffer(b"".join(r["anchors"] for r in rows), "<u8").astype(np.uint64))


@dataclass
class Entries:
    """Passages of one shard: document, first symbol in it, number of windows, and the passages' bytes one after another."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    size: np.ndarray
    data: bytes
    times: np.ndarray | None = None

    def contents(self) -> list[bytes]:
        ends = np.cumsum(self.size).tolist()
        return [self.data[b - n : b] for b, n in zip(ends, self.size.tolist(), strict=True)]


PASSAGE = pa.schema([("shard", pa.int32()), ("cover", pa.bool_()), ("cut", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("count", pa.binary()), ("size", pa.binary()), ("data", pa.binary())])
PASSAGE_SQL = "shard int, cover boolean, cut binary, doc binary, start binary, count binary, size binary, data binary"
#: and how often a passage stands in its block, or the passage (document, first symbol) that stands for a cover
PLACED = pa.schema([*PASSAGE, ("times", pa.binary()), ("lead", pa.binary()), ("lead_start", pa.binary())])
PLACED_SQL = f"{PASSAGE_SQL}, times binary, lead binary, lead_start binary"


def passages(key, texts: pa.Table, found: pa.Table, unit: Unit, hot: np.ndarray, shards: int, placed: bool = False) -> pa.Table:
    """Passages of one block of documents under windows with a repeated anchor, packed by shard; and covers, as rows with
    `cover`, of later documents whose passage also stands in an earlier document of the same block.

    With `placed`, an equal passage of the same document is a cover too, every cover names the passage that stands for it,
    and a piece of a periodic run shows what follows it, so that it has every stretch of `unit.most` windows that starts in it.
    """
    schema = PLACED if placed else PASSAGE
    ids = texts.column("_id").to_numpy().astype(np.int64)
    want_doc, want_anchor = (np.concatenate([unplanes(x.as_buffer(), k) for x in found.column(c)] or [np.zeros(0, k)]) for c, k in (("docs", "<i8"), ("anchors", "<u8")))
    wanted = np.unique(_pair(want_doc, want_anchor))
    del want_doc, want_anchor
    # narrow numbers: there may be a run for every few bytes of text
    kinds = (np.int64, np.int32, np.int32, np.int32, np.int32, np.uint8, np.uint64, np.int64)
    rows: list[tuple] = []
    spaced: list[np.ndarray] = []
    column = texts.column("_text").combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    base = 0
    for at, raw, offsets in text_chunks(column):
        symbols, places, words = unit.symbols(raw, offsets)
        runs = window_runs(symbols, places, unit)
        doc = ids[at + runs.text]
        asked = _among(_pair(doc, runs.anchor), wanted)
        doc, text, first, count, anchor = doc[asked], runs.text[asked], runs.first[asked], runs.count[asked], runs.anchor[asked]
        after = np.minimum(runs.after[asked], unit.most - 1) if placed else np.zeros(len(doc), np.int64)
        del runs
        if not len(doc):
            base += 0 if words else len(raw)
            continue
        slices = Slices(symbols)
        deal = anchor.copy()
        if len(hot):
            place = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
            is_hot = hot[place] == anchor
            if is_hot.any():
                single = np.repeat(first[is_hot], count[is_hot])
                single += np.arange(len(single)) - np.repeat(np.cumsum(count[is_hot]) - count[is_hot], count[is_hot])
                times = count[is_hot]
                doc = np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], times)])
                text = np.concatenate([text[~is_hot], np.repeat(text[is_hot], times)])
                deal = np.concatenate([deal[~is_hot], slices.hash(single, single + unit.window)])
                first = np.concatenate([first[~is_hot], single])
                count = np.concatenate([count[~is_hot], np.ones(len(single), count.dtype)])
                after = np.concatenate([after[~is_hot], np.zeros(len(single), after.dtype)])
        end = first + count + after + unit.window - 1
        a, b = first, end
        if words:
            # what stands between words is no part of a passage
            raw, begins = words.spaced()
            a, b = begins[first], begins[end] - 1
            spaced.append(raw)
        dealt = mix(deal)
        shard, cut = dealt % np.uint64(shards), dealt // np.uint64(shards) % np.uint64(CUTS)
        rows.append(tuple(x.astype(k) for x, k in zip((doc, first - places[text], count, b - a, shard, cut, slices.hash(first, end), base + a), kinds, strict=True)))
        base += len(raw)
    if not rows:
        return schema.empty_table()
    pool = memoryview(np.concatenate(spaced) if unit.words else column_bytes(column)[0])
    del spaced, wanted
    doc, start, count, size, shard, cut, one, a = map(np.concatenate, zip(*rows, strict=True))
    del rows
    # equal passages of the block: the smallest document asks for all, the others are covered by it. Neighbours in the order of hashes are
    # compared byte by byte; what a clash keeps apart here meets again in its shard
    order = np.lexsort((start, doc, size, one))
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (one[order][1:] == one[order][:-1]) & (size[order][1:] == size[order][:-1])
    for part in in_pieces(np.flatnonzero(same)):
        mine = order[part]
        for i, f, g, n in zip(part.tolist(), a[order[part - 1]].tolist(), a[mine].tolist(), size[mine].tolist(), strict=True):
            same[i] = pool[f : f + n] == pool[g : g + n]
    if placed:
        # rows that repeat an id and its text show a passage more than once
        again = np.append(False, same[1:] & (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1]))
        order, same = order[~again], same[~again]
    lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(order))))
    is_cover = same if placed else doc[order] > doc[order][lead]
    times = np.bincount(lead, minlength=len(order))[~is_cover]
    out, batches = Rows(schema), []
    covered = order[is_cover]
    if len(covered):
        named = (planes(doc[order[lead[is_cover]]]), planes(start[order[lead[is_cover]]])) if placed else ()
        out.add((int(key[0].as_py()) % shards, True, None, planes(doc[covered]), planes(start[covered]), planes(count[covered]), None, None, *((None, *named) if placed else ())))
    asking = order[~is_cover]
    del order, same, lead, is_cover, covered
    by = np.lexsort((one[asking], cut[asking], shard[asking]))
    asking, times = asking[by], times[by]
    del one, by
    bounds = np.flatnonzero(np.diff(shard[asking])) + 1
    for f, t in zip([0, *bounds.tolist()], [*bounds.tolist(), len(asking)], strict=True):
        if f < t:
            some = asking[f:t]
            data = b"".join([pool[x : x + n] for x, n in zip(a[some].tolist(), size[some].tolist(), strict=True)])
            numbers = [planes(x[some]) for x in (start, count, size)]
            out.add((int(shard[some[0]]), False, cut[some].tobytes(), planes(doc[some]), *numbers, data, *((planes(times[f:t].astype(np.int32)), None, None) if placed else ())))
            batches += out.full()
    return pa.Table.from_batches([*batches, *out.taken()], schema=schema)


class Rows:
    """Rows of packed bytes, made Arrow batches of a few MB as they come, so that they are held once."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.held += sum(len(x) for x in row if isinstance(x, bytes))

    def full(self) -> list[pa.RecordBatch]:
        """What was added, if it is enough for a batch."""
        return self.taken() if self.held >= BATCH_BYTES else []

    def taken(self) -> list[pa.RecordBatch]:
        """What was added since the last batch, as a batch."""
        rows, self.rows, self.held = self.rows, [], 0
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.schema.types, strict=True)], schema=self.schema)] if rows else []


def in_pieces(values: np.ndarray) -> Iterator[np.ndarray]:
    """Some values at a time, for loops over Python numbers."""
    for at in range(0, len(values), PIECE):
        yield values[at : at + PIECE]


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Which values are in a rising list, without sorting the two together."""
    if not len(rising):
        return np.zeros(len(values), dtype=bool)
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values


def _pair(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ anchor)


#: from the entries of a shard to covers (document, first symbol, symbols)
Finder = Callable[[Entries, Unit], tuple[np.ndarray, np.ndarray, np.ndarray]]


def passage_frame(docs: DataFrame, unit: Unit, dealt: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """Packed passages, dealt by shard. `docs` has _id (long, not null) and _text. With `placed`, repeats within a document count too."""
    parts = blocks = shards = parts_of(docs)
    found = materialize(repeated_anchors(docs, unit, blocks, placed), "anchors")
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(found))
    dealt = in_blocks(docs, blocks) if dealt is None else dealt
    asked = found.where("block >= 0").select(F.col("block").alias("_block"), "docs", "anchors")

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return (PLACED if placed else PASSAGE).empty_table()
        out = passages(key, left, right, unit, hot.value, shards, placed)
        give_back()
        return out

    pairs = dealt.groupBy("_block").cogroup(asked.repartitionById(parts, "_block").groupBy("_block"))
    return pairs.applyInArrow(cut, PLACED_SQL if placed else PASSAGE_SQL).repartitionById(parts, "shard")


def find_covers(docs: DataFrame, unit: Unit, finder: Finder) -> tuple[DataFrame, DataFrame]:
    """The documents dealt into blocks (_id, _text, _block), and packed covers (_block, docs, starts, ends) that a finder saw."""
    blocks = parts_of(docs)
    docs = docs.where("_id is not null")
    dealt = in_blocks(docs, blocks)
    sent = passage_frame(docs, unit, dealt)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for entries in shard_entries(batches, unit, covers):
            doc, start, size = finder(entries, unit)
            doc, start, end = merge_stretches(doc, start, start + size)
            for held, new in zip(covers, (doc, start, end - start), strict=True):
                held.append(new)
            give_back()
        doc, start, size = map(np.concatenate, covers)
        give_back()
        yield from pack_covers(doc, start, start + size, blocks)

    covers = sent.mapInArrow(work, "_block int, docs binary, starts binary, ends binary")
    return dealt, covers


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    @F.pandas_udf("int")
    def block(ids):
        import pandas as pd

        return pd.Series(block_of(ids.to_numpy(), blocks).astype(np.int32))

    return docs.select("_id", F.coalesce("_text", F.lit("")).alias("_text"), block("_id").alias("_block")).repartitionById(blocks, "_block")


def packed_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, binary values as views of it."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        yield {k: None if not v.is_valid else v.as_buffer() if isinstance(v, pa.BinaryScalar) else v.as_py() for k, v in row.items()}


def shard_entries(batches: Iterator[pa.RecordBatch], unit: Unit, covers: list[list[np.ndarray]]) -> Iterator[Entries]:
    """The entries of a shard, some cuts at a time; covers that pass through are added to `covers`."""
    held: list[tuple] = []
    for batch in batches:
        for row in packed_rows(batch):
            doc, start, count = unplanes(row["doc"], "<i8"), unplanes(row["start"], "<i4").astype(np.int64), unplanes(row["count"], "<i4").astype(np.int64)
            if row["cover"]:
                for to, new in zip(covers, (doc, start, count + unit.window - 1), strict=True):
                    to.append(new)
            else:
                size = unplanes(row["size"], "<i4").astype(np.int64)
                # entries stand in order of their cuts
                bounds = np.searchsorted(np.frombuffer(row["cut"], np.uint8), np.arange(CUTS + 1))
                times = unplanes(row["times"], "<i4").astype(np.int64) if row.get("times") else np.ones(len(doc), np.int64)
                held.append((bounds, doc, start, count, size, times, row["data"], np.append(0, np.cumsum(size))[bounds]))
    total = np.zeros(CUTS, np.int64)
    for row in held:
        total += np.diff(row[-1])
    first = 0
    while held and first < CUTS:
        last = first + 1
        while last < CUTS and total[first : last + 1].sum() <= INDEX_BYTES:
            last += 1
        if total[first:last].sum():
            some = [slice(b[first], b[last]) for b, *_ in held]
            *numbers, times = (np.concatenate([row[i][s] for row, s in zip(held, some, strict=True)]) for i in range(1, 6))
            yield Entries(*numbers, b"".join([memoryview(row[6])[row[7][first] : row[7][last]] for row in held]), times)
        first = last


def merge_stretches(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching stretches of a document become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # running maximum of the ends within a document: shift documents apart
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * span)
    new = np.append(True, (start + rank * span)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def pack_covers(doc: np.ndarray, start: np.ndarray, end: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    doc, start, end = merge_stretches(doc, start, end)
    if not len(doc):
        return
    block = block_of(doc, blocks)
    order = np.argsort(block, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        out.append((int(block[part[0]]), planes(doc[part]), planes(start[part].astype(np.int32)), planes(end[part].astype(np.int32))))
    kinds = [("_block", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def apply_covers(dealt: DataFrame, covers: DataFrame, summarise: Callable, schema: str) -> DataFrame:
    """`summarise(texts, spans)` for every block of documents, `spans` a list of (starts, ends) arrays per row."""
    parts = parts_of(dealt)

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        doc, start, end = (np.concatenate([unplanes(x, k) for x in right.column(c).to_pylist()] or [np.zeros(0, k)]).astype(np.int64) for c, k in (("docs", "<i8"), ("starts", "<i4"), ("ends", "<i4")))
        doc, start, end = merge_stretches(doc, start, end)
        ids = left.column("_id").to_numpy()
        a, b = np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")
        spans = [(start[x:y], end[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        out = summarise(left, spans)
        give_back()
        return out

    return dealt.groupBy("_block").cogroup(covers.repartitionById(parts, "_block").groupBy("_block")).applyInArrow(work, schema)
