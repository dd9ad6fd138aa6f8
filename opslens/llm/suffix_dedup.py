"""Repeated byte passages by the interval tree of common prefixes over an enhanced suffix array.

Every shard sorts the suffixes of its passages that start a window, computes common prefixes, and scans them with a
stack: each interval of suffixes with a common prefix of at least a window is a node of the tree. A node whose suffixes
follow different bytes is left-diverse, and so a maximal repeat; it is reported with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.repeats import BYTES_50, PIECE, Entries, Unit, apply_covers, block_of, find_covers, merge_stretches, parts_of, passage_frame, planes, shard_entries, unplanes
from opslens.llm.tokens import column_bytes

NO_BYTE = 256
# suffixes of intervals that are looked at together
MEMBERS = 1 << 18


class SuffixArray:
    """Suffixes of some passages that start a window, in order. `depth[i]` is the common prefix of suffixes i and i + 1, `most` bytes
    at most.
    """

    def __init__(self, contents: list[bytes], windows: np.ndarray, most: int | None = None):
        size = np.array([len(c) for c in contents], dtype=np.int64)
        base = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(contents), dtype=np.uint8)
        owner = np.repeat(np.arange(len(contents)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at, rest = base[owner] + place, size[owner] - place
        if most is not None:
            rest = np.minimum(rest, most)
        width = int(rest.max(initial=8) + 7) // 8 * 8
        padded = np.concatenate([pool, np.zeros(width, np.uint8)])
        # the suffixes side by side take many times their text, so only they and their order are held whole
        shown = np.lib.stride_tricks.sliding_window_view(padded, width)
        rows = np.empty((len(at), width), np.uint8)
        for a in range(0, len(at), PIECE):
            some = shown[at[a : a + PIECE]]
            some[np.arange(width) >= rest[a : a + PIECE, None]] = 0
            rows[a : a + PIECE] = some
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        lcp = np.full(max(len(at) - 1, 0), width)
        for a in range(0, len(lcp), PIECE):
            some = rows[order[a : a + PIECE + 1]]
            differ = some[1:] != some[:-1]
            lcp[a : a + PIECE] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        del rows
        rest = rest[order]
        self.owner, self.place = owner[order], place[order]
        self.depth = np.minimum(lcp, np.minimum(rest[1:], rest[:-1])) if len(order) > 1 else np.zeros(0, np.int64)
        before = pool[np.maximum(at[order] - 1, 0)].astype(np.int64) if len(pool) else np.zeros(0, np.int64)
        # what stands before a passage is not known, so its first window counts as diverse
        self.before = np.where(self.place > 0, before, NO_BYTE)


def prefix_intervals(depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All intervals (first suffix, last suffix, common prefix) of at least `least`, by one stack scan.

    Neighbourhoods with one depth throughout are a single interval and skip the stack.
    """
    deep = np.append(np.append(0, (depth >= least).astype(np.int8)), 0)
    edge = np.diff(deep)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    cuts = np.column_stack([starts, ends]).ravel()
    padded = np.append(depth, 0)
    low, high = np.minimum.reduceat(padded, cuts)[::2], np.maximum.reduceat(padded, cuts)[::2]
    flat = low == high
    first, last, value = [starts[flat]], [ends[flat]], [low[flat]]
    out: list[tuple[int, int, int]] = []
    for a, b in zip(starts[~flat].tolist(), ends[~flat].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for i, d in enumerate(depth[a:b].tolist(), a):
            left = i
            while stack and stack[-1][0] > d:
                top, left = stack.pop()
                out.append((left, i, top))
            if not stack or stack[-1][0] < d:
                stack.append((d, left))
        while stack:
            top, left = stack.pop()
            out.append((left, b, top))
    mixed = np.array(out, dtype=np.int64).reshape(-1, 3)
    return tuple(np.concatenate([*x, mixed[:, i]]) for i, x in enumerate((first, last, value)))


def maximal_groups(array: SuffixArray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left-diverse intervals: maximal repeats of at least `least` bytes."""
    first, last, value = prefix_intervals(array.depth, least)
    unlike = np.ones(len(array.before), dtype=np.int64)
    unlike[1:] = (array.before[1:] != array.before[:-1]) | (array.before[1:] == NO_BYTE)
    seen = np.cumsum(unlike)
    diverse = (seen[last] > seen[first]) | (array.before[first] == NO_BYTE)
    return first[diverse], last[diverse], value[diverse]


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and member of every element of the ranges first..first+count."""
    group = np.repeat(np.arange(len(first)), count)
    return group, np.repeat(first, count) + np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def distinct_passages(entries: Entries) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct passages, which one each entry has, the smallest document of each and its number of windows."""
    index: dict[bytes, int] = {}
    which = np.array([index.setdefault(c, len(index)) for c in entries.contents()], dtype=np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, which, entries.doc)
    windows = np.zeros(len(index), np.int64)
    windows[which] = entries.count
    return list(index), which, least, windows


def interval_covers(entries: Entries, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (document, start, bytes) of repeats that also stand in a smaller document."""
    contents, which, least, windows = distinct_passages(entries)
    later = entries.doc > least[which]
    doc = [entries.doc[later]]
    start = [entries.start[later]]
    size = [entries.count[later] + unit.window - 1]
    array = SuffixArray(contents, windows)
    first, last, value = maximal_groups(array, unit.window)
    leads = np.flatnonzero(~later)
    leads = leads[np.argsort(which[leads], kind="stable")]
    members = np.cumsum(last - first + 1)
    # intervals lie within each other, so they may have many more members than there are suffixes
    steps = np.searchsorted(members, np.arange(0, int(members.max(initial=0)) + MEMBERS, MEMBERS), side="right")
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        if a == b:
            continue
        count = last[a:b] - first[a:b] + 1
        group, member = spread(first[a:b], count)
        holder = least[array.owner[member]]
        smallest = np.minimum.reduceat(holder, np.cumsum(count) - count)
        hit = holder > smallest[group]
        owner, place, length = array.owner[member[hit]], array.place[member[hit]], value[a:b][group[hit]]
        from_, to = np.searchsorted(which[leads], owner, side="left"), np.searchsorted(which[leads], owner, side="right")
        again, at = spread(from_, to - from_)
        entry = leads[at]
        begin = entries.start[entry] + place[again]
        some, begin, end = merge_stretches(entries.doc[entry], begin, begin + length[again])
        doc.append(some)
        start.append(begin)
        size.append(end - begin)
    return np.concatenate(doc), np.concatenate(start), np.concatenate(size)


RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = BYTES_50) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if it lies in a `unit.window`-byte string that also starts in a document with a smaller id, judged on
    the texts as they come in. Null and shorter texts lose nothing. Rows with a null id lose nothing and cover nothing.
    An id names one text: rows that repeat both share their result. Other columns are not read.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    dealt, covers = find_covers(named, unit, interval_covers)

    def summarise(texts: pa.Table, spans: list) -> pa.Table:
        raw, offsets = column_bytes(texts.column("_text"))
        whole = raw.tobytes()
        out = []
        for a, b, (starts, ends) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans, strict=True):
            kept, at = hashlib.sha256(), a
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.update(whole[at : a + s])
                at = a + e
            kept.update(whole[at:b])
            out.append((b - a, int((ends - starts).sum()), len(starts), kept.hexdigest()))
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), RESULT, strict=True)] if out else [pa.array([], t) for _, t in RESULT]
        return pa.Table.from_arrays([texts.column("_id"), *columns], names=["_id", *[n for n, _ in RESULT]])

    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = apply_covers(dealt, covers, summarise, schema).unionByName(untouched(named, summarise, schema))
    return whole.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("_id", id_col)


def untouched(named: DataFrame, summarise, schema: str) -> DataFrame:
    """The rows without an id, which have no covers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            yield from summarise(pa.Table.from_batches([batch]), [(none, none)] * batch.num_rows).to_batches()

    return named.where("_id is null").select("_id", F.coalesce("_text", F.lit("")).alias("_text")).mapInArrow(work, schema)


GROUPS = pa.schema([("_block", pa.int32()), ("doc", pa.binary()), ("start", pa.binary()), ("place", pa.binary()), ("length", pa.binary()), ("repeat", pa.binary()), ("lead", pa.binary()), ("lead_start", pa.binary())])
ROWS = 100_000


def passage_groups(entries: Entries, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, place in it, length and digest (16 bytes) of every occurrence of the maximal repeats of some passages."""
    contents, which, _, windows = distinct_passages(entries)
    times = np.bincount(which, entries.times)
    # a passage that stands in two places is there twice, so that its own suffixes are intervals
    twice = np.flatnonzero(times > 1)
    array = SuffixArray(contents + [contents[i] for i in twice.tolist()], np.append(windows, windows[twice]), unit.window + unit.most - 1)
    first, last, value = maximal_groups(array, unit.window)
    group, member = spread(first, last - first + 1)
    once = array.owner[member] < len(contents)
    group, member = group[once], member[once]
    owner = np.where(array.owner < len(contents), array.owner, np.append(twice, 0)[np.maximum(array.owner - len(contents), 0)])
    names = b"".join(hashlib.md5(contents[owner[a]][array.place[a] : array.place[a] + n]).digest() for a, n in zip(first.tolist(), value.tolist(), strict=True))
    digest = np.frombuffer(names, "V16")
    order = np.argsort(which, kind="stable")
    from_, to = np.searchsorted(which[order], owner[member], side="left"), np.searchsorted(which[order], owner[member], side="right")
    again, at = spread(from_, to - from_)
    group = group[again]
    return order[at], array.place[member][again], value[group], digest[group]


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = BYTES_50) -> DataFrame:
    """The general output: repeat groups with all their occurrences (repeat, length, id, start), within a document and between documents.

    Every window that stands in two places or more lies in a group that has exactly its occurrences, and every group has
    all places of its bytes. A group is maximal within a run of windows with one anchor: longer repeats come as several
    groups, one for each run, of `unit.window` to `unit.window + unit.most - 1` bytes; and where an anchor is hot, one for
    each window. `repeat` is a hash of the repeated bytes. Rows without an id take no part; an id names one text.

    The suffix array of a shard sees a passage once for each block. Groups then go to the blocks of their documents, where the
    other places of the passages are, so no task gathers all occurrences of a group.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    blocks = parts_of(docs)
    sent = passage_frame(named, unit, placed=True)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = []
        for batch in batches:
            cover = batch.column("cover").to_numpy(zero_copy_only=False).astype(bool)
            asking.append(batch.filter(pa.array(~cover)))
            some = batch.filter(pa.array(cover))
            if some.num_rows:
                doc = some.column("doc")
                # all covers of a row are of one block
                block = [int(block_of(unplanes(x.as_py(), "<i8")[:1], blocks)[0]) for x in doc]
                none = pa.nulls(some.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), doc, some.column("start"), none, none, none, some.column("lead"), some.column("lead_start")], schema=GROUPS)
        for entries in shard_entries(iter(asking), unit, [[], [], []]):
            entry, place, length, digest = passage_groups(entries, unit)
            doc, start = entries.doc[entry], entries.start[entry]
            block = block_of(doc, blocks)
            order = np.argsort(block, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(part):
                    numbers = [planes(x[part].astype(np.int32)) for x in (start, place, length)]
                    out.append((int(block[part[0]]), planes(doc[part]), *numbers, digest[part].tobytes(), None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), GROUPS.types, strict=True)], schema=GROUPS)

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        covers: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                doc, start = unplanes(row["doc"], "<i8"), unplanes(row["start"], "<i4").astype(np.int64)
                if row["lead"] is not None:
                    covers.append((doc, start, unplanes(row["lead"], "<i8"), unplanes(row["lead_start"], "<i4").astype(np.int64)))
                else:
                    found.append((doc, start, *(unplanes(row[c], "<i4").astype(np.int64) for c in ("place", "length")), np.frombuffer(row["repeat"], "V16")))
        if not found:
            return
        doc, start, place, length, digest = map(np.concatenate, zip(*found, strict=True))
        none = (np.zeros(0, np.int64),) * 4
        # every passage is its own lead
        other, other_start, lead, lead_start = map(np.concatenate, zip(none, *covers, strict=True))
        order = np.lexsort((start, doc))
        doc, start, place, length, digest = doc[order], start[order], place[order], length[order], digest[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(doc)))
        other, other_start = np.append(doc[begin], other), np.append(start[begin], other_start)
        lead, lead_start = np.append(doc[begin], lead), np.append(start[begin], lead_start)
        # rank of (document, start) among the passages that have groups
        at = np.lexsort((np.append(np.zeros(len(begin), np.int8), np.ones(len(lead), np.int8)), np.append(start[begin], lead_start), np.append(doc[begin], lead)))
        is_passage = at < len(begin)
        rank = np.empty(len(at), np.int64)
        rank[at] = np.cumsum(is_passage) - 1
        rank = rank[len(begin) :]
        good = (rank >= 0) & (doc[begin][rank] == lead) & (start[begin][rank] == lead_start)
        other, other_start, rank = other[good], other_start[good], rank[good]
        steps = np.searchsorted(np.cumsum(size[rank]), np.arange(0, int(size[rank].sum()) + ROWS, ROWS), side="right")
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            which, row = spread(begin[rank[a:b]], size[rank[a:b]])
            names = [x.hex() for x in digest[row].tolist()]
            arrays = [pa.array(names, pa.string()), pa.array(length[row]), pa.array(other[a:b][which]), pa.array(other_start[a:b][which] + place[row])]
            yield pa.RecordBatch.from_arrays(arrays, ["repeat", "length", "_id", "start"])

    sql = "_block int, doc binary, start binary, place binary, length binary, repeat binary, lead binary, lead_start binary"
    placed = sent.mapInArrow(find, sql).repartitionById(blocks, "_block")
    return placed.mapInArrow(place_all, "repeat string, length long, _id long, start long").withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("_id", id_col)
