"""Sequence packing: shortest-pack-first over the histogram of lengths, patterns joined back to documents by rank.

Documents become token ids plus an end id, cut into pieces of at most one sequence. Only the histogram of piece lengths
reaches the driver (one number per length, so its size is bounded by the sequence length). There, lengths are placed
longest first; a placement updates the counts of packing patterns, never single documents. Each length then owns a run
of slots over the patterns, and the pieces of that length take the slots by their rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.session import materialize

SEQUENCE = 2048
END_ID = 1


# Fixed value: how the public byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# white space is split by looking back from its end, which runs out of stack on very long stretches
LONG_SPACE = re.compile(r"\s{1000}")


def byte_of_symbol() -> dict[str, int]:
    """The byte behind each symbol of a byte-level vocabulary: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class ByteEncoder:
    """Ids of whole texts as little-endian bytes.

    The merges of the tokenizer file run as ranks: a token of a trained byte-level vocabulary is always made by its own merge,
    so merging the pair with the smallest id gives the tokenizer's ids. Texts that hold an added token or a very long
    stretch of white space go to the tokenizer itself, as do all texts if the file is of another kind.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        split, model = kind["pre_tokenizer"] or {}, kind["model"]
        plain = kind["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
        known = model.get("vocab", {})
        ordered = all(known.get(a + b) == i for i, (a, b) in enumerate(pairs, len(known) - len(pairs) - sum(x in known for x in self.added)))
        self.ranks = None
        if plain and ordered and not model.get("end_of_word_suffix") and not model.get("ignore_merges"):
            symbol = byte_of_symbol()
            ranks = {bytes(symbol[c] for c in token): i for token, i in known.items() if token not in self.added}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(x in text for x in self.added) or LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), dtype="<u4").tobytes()


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, and _row, which numbers repeated rows apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = codes.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for a in range(0, n, sequence):
                    piece = ids[4 * a : 4 * (a + sequence)]
                    at.append(row)
                    start.append(a)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            arrays = [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with their counts.

    Lengths go longest first. Those of one length are spread over the open patterns with the least filled room that
    still fits, splitting a pattern's count where only a part of it takes the length; what fits nowhere opens packs.
    A pattern may take several pieces of the length at once.
    """
    open_packs: dict[int, dict[tuple, int]] = defaultdict(dict)  # room left -> pattern -> count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            # shortest pack first: the most room
            room = max((r for r, packs in open_packs.items() if r >= length and packs), default=None)
            if room is None:
                times = sequence // length
                full, rest = divmod(left, times)
                if full:
                    _put(open_packs, sequence - times * length, ((length, times),), full)
                if rest:
                    _put(open_packs, sequence - rest * length, ((length, rest),), 1)
                break
            pattern, count = min(open_packs[room].items())
            times = min(room // length, left)
            take = min(count, left // times)
            if count == take:
                del open_packs[room][pattern]
            else:
                open_packs[room][pattern] = count - take
            grown = (*pattern, (length, times))
            _put(open_packs, room - times * length, grown, take)
            left -= take * times
    return sorted((p, c) for packs in open_packs.values() for p, c in packs.items())


def _put(open_packs, room, pattern, count) -> None:
    open_packs[room][pattern] = open_packs[room].get(pattern, 0) + count


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of slots, one row each: first rank, times per pack, first sequence id, first offset."""
    runs: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence_id = 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            runs[length].append((used[length], times, sequence_id, offset))
            used[length] += times * count
            offset += times * length
        sequence_id += count
    return {length: np.array(rows, dtype=np.int64) for length, rows in runs.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, salts: int = 1024) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; null and empty texts are the end id alone. Rows that repeat an id
    are packed one by one, null ids too. Pieces of one length are ranked within `salts` parts by hash of what they hold, on
    top of the counts of the parts before, so a length that many pieces share is never in one task. Pieces alike in all
    columns share a part and a window, where they are told apart by their order only; any order gives the same result.
    """
    part = F.pmod(F.xxhash64("_id", "start", "ids_crc32"), F.lit(salts))
    pieces = materialize(token_pieces(docs, tokenizer, id_col, text_col, sequence, end_id).withColumn("_part", part), "pieces")
    counts = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, sequence)))

    inside = Window.partitionBy("length", "_part").orderBy("_id", "start", "ids_crc32")
    ranked = pieces.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        out = np.zeros((2, len(size)), dtype=np.int64)
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            runs = places.value[int(length)]
            run = runs[np.searchsorted(runs[:, 0], rank[rows], side="right") - 1]
            inner = rank[rows] - run[:, 0]
            out[0, rows] = run[:, 2] + inner // run[:, 1]
            out[1, rows] = run[:, 3] + inner % run[:, 1] * length
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "_place.sequence_id", "_place.offset")
