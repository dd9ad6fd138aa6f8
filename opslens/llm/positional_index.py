"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds some whole documents: its terms, and for each term the places where it
stands, in rising order. Places count through all documents of the segment with one place left free between two, so a run
of neighbouring places never crosses documents. A frequent term has its places spread over all segments, as the documents
are, and no list of places is ever gathered.

A search sends a bounded block of queries to the segments. In a segment the places of a window's rarest term, moved back by
the term's offset in the window, are the possible beginnings; the lists of its other terms, rarest first, are intersected
with them. All windows of a block go through this together, one term a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opslens.llm.repeats import merge_stretches, planes, unplanes
from opslens.llm.suffix_dedup import spread
from opslens.llm.tokens import Words, chunks, column_bytes
from opslens.session import materialize

#: bytes outside `[0-9A-Za-z]` and the bytes of code points from 128 on
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[0x30:0x3A] = NO_TERM[0x41:0x5B] = NO_TERM[0x61:0x7B] = NO_TERM[0x80:] = False

SEGMENT_BYTES = 2 << 20
#: texts of the queries that are sent to all segments at a time
QUERY_BYTES = 4 << 20
#: beginnings that are followed at a time
FOLLOWED = 1 << 20
WINDOW = 10


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def term_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(raw, offsets, lower=True, separator=NO_TERM)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of SEGMENT_BYTES of text, or one longer text: _segment, _ids, _counts (words of each document), _terms, _sizes, _places.

    Every row of `docs` is indexed, repeated rows and rows without an id too. Null and empty texts have no terms.
    """
    kind = docs.schema[id_col].dataType
    list_kind = pa.list_(to_arrow_type(kind))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for a, b in chunks(offsets, SEGMENT_BYTES):
                words = term_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                codes, terms = words.coded()
                place = np.arange(len(codes)) + words.text_of_word()
                # a sort of short numbers is a radix sort
                order = np.argsort(codes.astype(np.uint16) if len(terms) <= 1 << 16 else codes, kind="stable")
                sizes = np.bincount(codes, minlength=len(terms))
                step = np.diff(place[order], prepend=0)
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                step[first] = place[order][first]
                listed = b" ".join(terms.to_pylist())
                row = [[f"{task}-{number}"], [batch.column(0).slice(a, b - a).to_pylist()], [np.diff(words.text_offsets)], [_pack(listed)], [_pack(planes(sizes.astype(np.uint32)))], [_pack(planes(step.astype(np.uint32)))]]
                types = (pa.string(), list_kind, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["_segment", "_ids", "_counts", "_terms", "_sizes", "_places"])

    return rows.mapInArrow(work, f"_segment string, _ids array<{kind.simpleString()}>, _counts array<int>, _terms binary, _sizes binary, _places binary")


class Segment:
    """A segment as arrays. `keys` are term * 2**32 + place in rising order."""

    def __init__(self, counts: list[int], terms: bytes, sizes: bytes, places: bytes):
        listed = _unpack(terms)
        self.terms = pa.array(listed.split(b" ") if listed else [], pa.large_binary())
        self.sizes = unplanes(_unpack(sizes), "<u4").astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        steps = np.cumsum(unplanes(_unpack(places), "<u4").astype(np.int64))
        before = np.append(0, steps)[self.first]
        self.places = steps - np.repeat(before, self.sizes)
        self.keys = (np.repeat(np.arange(len(self.sizes)), self.sizes) << 32) + self.places
        self.bases = np.cumsum(np.append(0, np.array(counts, np.int64) + 1))

    def codes(self, terms: pa.Array) -> np.ndarray:
        """The segment's number of each term, -1 for terms that do not occur."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, place, side="right") - 1


@dataclass
class Queries:
    """A block of query items. Row i of `windows` has the terms of a distinct window, -1 behind its last; `items` are the
    items of the windows, from `item_bounds`; `sets` the distinct terms of each item.
    """

    ids: list
    terms: pa.Array
    windows: np.ndarray
    items: np.ndarray
    item_bounds: np.ndarray
    sets: list[np.ndarray]


def read_queries(rows: list[tuple], width: int) -> Queries:
    """Windows of `width` consecutive words of each item (id, text); an item of fewer words, but not none, is one window."""
    raw, offsets = column_bytes(pa.array([r[1] for r in rows], pa.large_string()))
    words = term_words(raw, offsets)
    codes, terms = words.coded()
    count = np.diff(words.text_offsets)
    owner, first = spread(np.zeros(len(count), np.int64), np.where(count == 0, 0, np.maximum(count - width + 1, 1)))
    size = np.minimum(count[owner], width)
    at = words.text_offsets[:-1][owner] + first
    inside = np.arange(width)[None, :] < size[:, None]
    windows = np.where(inside, np.append(codes, -1)[np.minimum(at[:, None] + np.arange(width)[None, :], len(codes))], -1)
    windows, which = np.unique(windows, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([which.ravel(), owner]), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
    sets = [np.unique(codes[a:b]) for a, b in zip(words.text_offsets[:-1].tolist(), words.text_offsets[1:].tolist(), strict=True)]
    return Queries([r[0] for r in rows], terms, windows, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), sets)


def query_blocks(items: DataFrame, id_col: str, text_col: str, most: int = QUERY_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of at most `most` bytes of text, or one longer item; the driver holds one block at a time."""
    block, held = [], 0
    for row in items.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).toLocalIterator():
        size = len(row["_text"].encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((row["_id"], row["_text"]))
        held += size
    if block:
        yield block


def find_windows(segment: Segment, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the queries and the places where they begin in the segment, some windows at a time."""
    codes = np.append(segment.codes(queries.terms), -1)
    empty = queries.windows < 0
    local = codes[queries.windows]
    size = np.where(empty, np.iinfo(np.int64).max, np.append(segment.sizes, 0)[local])
    asked = np.flatnonzero((size.min(axis=1, initial=np.iinfo(np.int64).max) > 0) & ~empty[:, 0])
    rarest = np.argsort(size[asked], axis=1, kind="stable")
    local, length = np.take_along_axis(local[asked], rarest, 1), (~empty[asked]).sum(1)
    work = np.cumsum(segment.sizes[local[:, 0]]) if len(asked) else np.zeros(0, np.int64)
    at = 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + FOLLOWED, side="right")))
        head = local[at:to, 0]
        of, index = spread(segment.first[head], segment.sizes[head])
        of += at
        start = segment.places[index] - rarest[of, 0]
        for rank in range(1, local.shape[1]):
            more = length[of] > rank
            if not more.any():
                break
            key = (local[of, rank] << 32) + start + rarest[of, rank]
            found = segment.keys[np.minimum(np.searchsorted(segment.keys, key), len(segment.keys) - 1)] == key
            keep = ~more | (found & (start >= 0))
            of, start = of[keep], start[keep]
        if len(of):
            yield asked[of], start
        at = to


def phrase_hits(segment: Segment, queries: Queries) -> tuple[np.ndarray, ...]:
    """Document, item, first place and place behind the last of every stretch of an item's words in a document, merged per document and item."""
    none = np.zeros(0, np.int64)
    found = []
    for window, start in find_windows(segment, queries):
        size = (queries.windows[window] >= 0).sum(1)
        times = np.diff(queries.item_bounds)[window]
        of, index = spread(queries.item_bounds[window], times)
        found.append((segment.document(start[of]), queries.items[index], start[of], (start + size)[of]))
    if not found:
        return none, none, none, none
    document, item, start, end = (np.concatenate([x[i] for x in found]) for i in range(4))
    pair, start, end = merge_stretches(document * len(queries.ids) + item, start, end)
    return pair // len(queries.ids), pair % len(queries.ids), start, end


def near_hits(segment: Segment, queries: Queries, within: int) -> tuple[np.ndarray, ...]:
    """Document, item, first place and place behind the last of the shortest stretches of at most `within` words that have all
    different words of an item, in any order. From the rarest word outwards: only places less than `within` away from it are looked at.
    """
    codes = segment.codes(queries.terms)
    found = [(np.zeros(0, np.int64),) * 4]
    for item, terms in enumerate(queries.sets):
        local = codes[terms]
        if not len(local) or (local < 0).any():
            continue
        local = local[np.argsort(segment.sizes[local], kind="stable")]
        lists = [segment.places[segment.first[c] : segment.first[c] + segment.sizes[c]] for c in local]
        head, close = lists[0], []
        for places in lists:
            after = np.minimum(np.searchsorted(head, places), len(head) - 1)
            before = np.maximum(after - 1, 0)
            close.append(places[np.minimum(np.abs(head[after] - places), np.abs(head[before] - places)) < within])
        place = np.concatenate(close)
        which = np.repeat(np.arange(len(close)), [len(x) for x in close])
        order = np.argsort(place, kind="stable")
        place, which = place[order], which[order]
        # the latest place of every term up to here; the earliest of these begins the stretch that ends here
        start = np.full(len(place), np.iinfo(np.int64).max)
        for term in range(len(close)):
            start = np.minimum(start, np.maximum.accumulate(np.where(which == term, place, -1)))
        good = (start >= 0) & (place - start < within)
        start, end = start[good], place[good] + 1
        first = np.append(True, start[1:] != start[:-1]) if len(start) else np.zeros(0, bool)
        start, end = start[first], end[first]
        same = segment.document(start) == segment.document(end - 1)
        start, end = start[same], end[same]
        found.append((segment.document(start), np.full(len(start), item), start, end))
    return tuple(np.concatenate([x[i] for x in found]) for i in range(4))


def search(index: DataFrame, items: DataFrame, hits: Callable[[Segment, Queries], tuple[np.ndarray, ...]], width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (_segment, _document, _item, _spans) of every document and item with hits; a span has its first word and its number of words.

    The items are sent to all segments in blocks of at most QUERY_BYTES of text; the answers to a block are written before the next is sent.
    """
    spark = index.sparkSession
    kind = items.schema[id_col].dataType
    schema = f"_segment string, _document int, _item {kind.simpleString()}, _spans array<struct<start:int,length:int>>"
    span = pa.struct([("start", pa.int32()), ("length", pa.int32())])
    types = (pa.string(), pa.int32(), to_arrow_type(kind))
    answers = None
    for block in query_blocks(items, id_col, text_col):
        shared = spark.sparkContext.broadcast(read_queries(block, width))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row["_counts"], row["_terms"], row["_sizes"], row["_places"])
                    document, item, start, end = hits(segment, queries)
                    if not len(document):
                        continue
                    order = np.lexsort((start, item, document))
                    document, item, start, end = document[order], item[order], start[order], end[order]
                    first = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (item[1:] != item[:-1])))
                    spans = pa.StructArray.from_arrays([pa.array(start - segment.bases[document], pa.int32()), pa.array(end - start, pa.int32())], fields=list(span))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)), pa.int32()), spans)
                    names = [[row["_segment"]] * len(first), document[first], [queries.ids[i] for i in item[first].tolist()]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(names, types, strict=True)], lists], ["_segment", "_document", "_item", "_spans"])

        some = materialize(index.select("_segment", "_counts", "_terms", "_sizes", "_places").mapInArrow(work, schema), "hits")
        shared.unpersist()
        answers = some if answers is None else answers.unionByName(some)
    return spark.createDataFrame([], schema) if answers is None else answers


def indexed_documents(index: DataFrame) -> DataFrame:
    """_segment, _document, _id and _words of every indexed document."""
    listed = index.select("_segment", F.posexplode(F.arrays_zip("_ids", "_counts")).alias("_document", "_of"))
    return listed.select("_segment", "_document", F.col("_of._ids").alias("_id"), F.col("_of._counts").cast("long").alias("_words"))


def phrase_matches(index: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """_id, _item and _spans: where a document has `width` consecutive words of an item; overlapping windows make one span."""
    found = search(index, items, phrase_hits, width, id_col, text_col)
    return found.join(indexed_documents(index), ["_segment", "_document"]).select("_id", "_item", "_spans")


def near_matches(index: DataFrame, items: DataFrame, within: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """_id, _item and _spans: the shortest stretches of at most `within` words with all different words of an item, in any order."""

    def hits(segment: Segment, queries: Queries) -> tuple[np.ndarray, ...]:
        return near_hits(segment, queries, within)

    found = search(index, items, hits, WINDOW, id_col, text_col)
    return found.join(indexed_documents(index), ["_segment", "_document"]).select("_id", "_item", "_spans")


def covered_words(spans: Column) -> Column:
    """Number of words in at least one of the spans."""
    end = lambda x: x["start"] + x["length"]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(x["start"], a["reach"]))).cast("long").alias("n"), F.greatest(a["reach"], end(x)).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit (words inside an occurrence of a window of the benchmark), n_items (items
    with occurring windows), items_sha256 (their ids, sorted as strings, joined by commas) and contaminated.

    Words are runs of digits, letters A-Z without case and code points from 128 on. A window is `width` consecutive words of an item, or all
    of a shorter one. `benchmark` has item_id and text; rows without an id hit words but are not named, rows that repeat an id
    count once. Null and empty texts have no words on either side. Repeated documents each get their row. Only the named columns
    are read; an empty benchmark hits nothing, an empty table gives an empty result.
    """
    index = materialize(build_index(docs, id_col, text_col), "index")
    found = search(index, benchmark, phrase_hits, width)
    by_document = found.groupBy("_segment", "_document").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    joined = indexed_documents(index).join(by_document, ["_segment", "_document"], "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    hit = F.coalesce(covered_words(F.col("_spans")), F.lit(0).cast("long"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
