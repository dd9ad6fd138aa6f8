"""BPE encoding and decoding through a distinct-word table.

Texts are split into words once, an Arrow batch at a time, and written: a batch keeps its texts as places in its own list of
words, and that list. The words of all batches meet in buckets by hash, where every distinct word is encoded once. The ids
go back to the batches, are looked up among the pieces there, and take the places of the words. No text is shuffled, only
places and words, and no table of all words is gathered anywhere. Words are told apart by their bytes at every step.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from opslens.llm.repeats import parts_of, planes, unplanes
from opslens.llm.tokens import Words, chunks, column_bytes, give_back
from opslens.session import materialize

#: words of a written row, or one text with more
ROW_WORDS = 1 << 20
#: words that are encoded at a time
ENCODED = 4_000


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def read_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of an Arrow batch (id, text) the number of words of each text, their codes, and the distinct words in the order of the codes.

    Code 0 is the commonest word; words as frequent as each other are in order. Texts are read in pieces of 1 MB, or one longer text.
    """
    raw, offsets = column_bytes(batch.column(1))
    counts, codes, lists, known = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [pa.array([], pa.large_binary())], 0
    for a, b in chunks(offsets):
        words = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found, distinct = words.coded()
        counts.append(np.diff(words.text_offsets).astype(np.int32))
        codes.append(found.astype(np.int32) + np.int32(known))
        lists.append(distinct)
        known += len(distinct)
    # the lists of the pieces become one
    joined = pa.concat_arrays(lists).dictionary_encode()
    place = joined.indices.to_numpy()[np.concatenate(codes)]
    # by frequency, so that codes are short, and by their bytes, so that most lists compress well
    order = pc.sort_indices(joined.dictionary).to_numpy().astype(np.int64)
    order = order[np.argsort(-np.bincount(place, minlength=len(joined.dictionary))[order], kind="stable")]
    code = np.empty(len(order), dtype=np.uint32)
    code[order] = np.arange(len(order), dtype=np.uint32)
    return np.concatenate(counts), code[place], joined.dictionary.take(pa.array(order)).to_pylist()


def write_words(texts: DataFrame, kind: str) -> DataFrame:
    """For every batch rows of some of its texts: the batch's name, their ids, their numbers of words and the codes of these; the first has the batch's words."""
    schema = f"batch string, ids array<{kind}>, counts array<int>, payload binary, words binary"
    shape = [pa.string(), pa.list_(to_arrow_type(texts.schema["_id"].dataType)), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            counts, codes, words = read_words(batch)
            listed = _pack(b" ".join(words))
            ends = np.append(0, np.cumsum(counts, dtype=np.int64))
            for a, b in chunks(ends, ROW_WORDS):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                row = [[f"{task}-{number}"], [ids], [counts[a:b]], [_pack(planes(codes[ends[a] : ends[b]]))], [listed if a == 0 else None]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, shape, strict=True)], ["batch", "ids", "counts", "payload", "words"])
            del counts, codes, words, listed, ends
            give_back()

    return materialize(texts.mapInArrow(work, schema), "words")


def bucket_words(coded: DataFrame, buckets: int) -> DataFrame:
    """For every batch and bucket the batch's words of the bucket and their codes, as steps from one to the next."""
    shape = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("codes", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _unpack(packed)
                words = data.split(b" ") if data else []
                bucket = np.array([xxh3_64_intdigest(word) % buckets for word in words], dtype=np.int64)
                order = np.argsort(bucket, kind="stable")
                out = []
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(part):
                        some = b" ".join(words[i] for i in part.tolist())
                        out.append({"batch": name, "bucket": int(bucket[part[0]]), "words": _pack(some), "codes": _pack(planes(np.diff(part, prepend=0).astype(np.uint32)))})
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    return coded.where("words is not null").select("batch", "words").mapInArrow(work, "batch string, bucket int, words binary, codes binary")


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """For every batch and bucket the codes with the numbers of ids and the ids of their words. Each distinct word of a bucket is encoded once."""
    shape = pa.schema([("batch", pa.string()), ("codes", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        ids: dict[str, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                listed = _unpack(row["words"]).decode().split(" ")
                new = [word for word in listed if word not in ids]
                for a in range(0, len(new), ENCODED):
                    some = new[a : a + ENCODED]
                    for word, found in zip(some, model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                        ids[word] = np.array(found.ids, dtype="<u4").tobytes()
                parts = [ids[word] for word in listed]
                counts = np.array([len(x) // 4 for x in parts], dtype=np.uint32)
                answer = {"counts": _pack(planes(counts)), "ids": _pack(planes(np.frombuffer(b"".join(parts), "<u4")))}
                yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "codes": row["codes"], **answer}], schema=shape)

        del model, ids
        give_back()

    return words.mapInArrow(work, "batch string, codes binary, counts binary, ids binary")


_pieces: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def piece_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """For every id its decimal text and its piece; as long as the vocabulary."""
    if tokenizer not in _pieces:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
        pieces = np.full(max(vocabulary.values()) + 1, "", dtype=object)
        for piece, i in vocabulary.items():
            pieces[i] = piece
        _pieces[tokenizer] = np.array([str(i) for i in range(len(pieces))], dtype=object), pieces
    return _pieces[tokenizer]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256.

    The tokenizer drops white space and never joins words over it, so the ids of a text are those of its words in order;
    its decoding joins pieces by spaces. Null and empty texts have no ids. Repeated rows and null ids are encoded row
    by row; other columns are not read. Blocks hold BLOCK_BYTES of text, or one longer text.
    """
    parts = parts_of(docs)
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    coded = write_words(texts, kind.simpleString())
    answers = encode_words(bucket_words(coded, parts).repartitionById(parts, "bucket"), tokenizer)
    arrow_kind = to_arrow_type(kind)

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, pieces = piece_table(tokenizer)
        found = []
        for row in right.to_pylist():
            codes = np.cumsum(unplanes(_unpack(row["codes"]), "<u4").astype(np.int64))
            found.append((codes, unplanes(_unpack(row["counts"]), "<u4").astype(np.int64), unplanes(_unpack(row["ids"]), "<u4")))
        size = sum(len(c) for c, _, _ in found)
        lengths = np.zeros(size, np.int64)
        id_texts, piece_texts = np.full(size, "", dtype=object), np.full(size, "", dtype=object)
        for codes, counts, ids in found:
            lengths[codes] = counts
            ends = np.cumsum(counts)
            for table, out in ((numbers, id_texts), (pieces, piece_texts)):
                joined = table[ids].tolist()
                out[codes] = [" ".join(joined[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        out = []
        for row in left.to_pylist():
            codes = unplanes(_unpack(row["payload"]), "<u4")
            at = 0
            for doc, n in zip(row["ids"], row["counts"], strict=True):
                some = codes[at : at + n]
                at += n
                digests = [hashlib.sha256(" ".join(filter(None, table[some])).encode()).hexdigest() for table in (id_texts, piece_texts)]
                out.append((doc, int(lengths[some].sum()) if n else 0, *digests))
        del found, id_texts, piece_texts
        give_back()
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = (arrow_kind, pa.int64(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    places = coded.select("batch", "ids", "counts", "payload").repartition(parts, "batch")
    joined = places.groupBy("batch").cogroup(answers.repartition(parts, "batch").groupBy("batch"))
    return joined.applyInArrow(work, f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
