"""Archives, packing and encoding: exact round trips."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opslens.llm import bpe
from opslens.llm.bpe import encode_decode
from opslens.llm.packing import ByteEncoder, pack, shortest_pack_first, slots
from opslens.llm.warc import CAPTURE, LoserTree, archive_pages, capture_history, parse_archive, run_starts, url_key
from tests.llm.helpers import SCHEMA, awkward, awkward_texts, sha, thue_morse

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def test_loser_tree_merges_any_runs():
    rnd = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rnd.randrange(30), i) for _ in range(rnd.randrange(12))) for i in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_run_starts_where_the_run_changes_or_places_go_back():
    run, place = np.array([2, 2, 0, 0, 0, 0]), np.array([20, 21, 3, 4, 1, 2])
    assert run_starts(run, place).tolist() == [0, 2, 4]


def test_capture_history_in_many_ranges_with_a_hot_url_and_equal_rows(spark):
    rnd = random.Random(3)
    rows = [("com,a)/" if rnd.random() < 0.4 else f"com,{rnd.choice('bcdé')})/", f"2024-01-0{rnd.randrange(1, 6)}", rnd.choice([None, 1, 2, 3]), None, "response", str(i), 0, None, "f", i, True) for i in range(400)]
    rows += [("com,a)/", "2024-01-03", 7, None, "response", "same", 0, None, "f", 0, True)] * 300
    captures = spark.createDataFrame(rows, CAPTURE).repartition(5)
    history = capture_history(captures, range_rows=40).select("*", F.spark_partition_id().alias("part"))
    got = history.collect()
    assert sorted(tuple(r)[:-1][5:6] + (r.offset,) for r in got) == sorted((x[5], x[9]) for x in rows)
    keys = [(r.url_key.encode(), r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    # 300 equal rows do not meet in one part
    sizes = collections.Counter(r.part for r in got)
    assert len(sizes) > 8 and max(sizes.values()) < 150


def test_archive_parser():
    block = b"a\r\n\r\nWARC/1.1\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    found = list(parse_archive(record * 2))
    assert len(found) == 2 and all((record * 2)[a:b] == block for _, a, b in found)
    with pytest.raises(ValueError, match="does not end"):
        list(parse_archive(record.replace(b"Content-Length: 1", b"Content-Length: 0")))
    assert url_key("HTTP://B.a.com/X?y") == "com,a,b)/x?y" and url_key(None) == ""


def pages(spark):
    base = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [
        (-1, None, None), (-2, "x\r\ny%41", ""), (-3, "http://a.b", "z\r\n\r\nWARC/1.1"), (-4, "http://a.b", "z" * 100), (-9, "http://a.b", "z" * 100), (-5, "http://A.b", "z" * 99),
        (-6, "http://a.b", "z" * 99), (None, "http://a.b", "z" * 100), (None, None, None), (-20, "http://long", "é" * 300_000),
    ]
    again = base.limit(30).withColumn("page_id", F.col("page_id") + 100_000)
    return base.unionByName(again).unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))


def test_archive_round_trip(spark):
    df = pages(spark).withColumns({"_payload": F.lit(1), "_first": F.lit("x"), "file": F.lit(0), "captured": F.lit(None)})
    rows, smallest = df.collect(), {}
    for r in rows:
        if len((r.html or "").encode()) >= 100 and r.page_id is not None:
            smallest[r.html] = min(smallest.get(r.html, r.page_id), r.page_id)
    want = collections.Counter()
    for r in rows:
        body, first = r.html or "", smallest.get(r.html)
        again = first is not None and first != r.page_id
        want[(r.page_id, r.url, len(body.encode()), sha(body), "revisit" if again else "response", first if again else None)] += 1
    got = archive_pages(df).collect()
    assert collections.Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key.encode(), r.captured, -1 << 63 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    assert archive_pages(df.limit(0)).count() == 0


HARD = [
    "", "  a  b\n\n c ", "x<|endoftext|>y", "it's I'll 've 'S", "½ ¼² ٣ 漢字 かな　　x", "é 👩‍👩‍👧 \U000e0041", "\x1c\x1d a\x85\x85b\xa0\xa0c", "tab\t\ttab \t x", "ªº_ __ a_b", "a͸b",
    " ", "\n\n\n", "﻿abc", "İ ſ ẞ ΑΣ", "a<|startoftext|>B", "é 가", "​ z",
]


def test_byte_encoder_equals_the_tokenizer():
    model = Tokenizer.from_file(BYTE)
    want = [np.array(model.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in HARD]
    codes = ByteEncoder(BYTE)
    assert codes.ranks is not None
    assert [codes.encode(x) for x in HARD] == want
    for long in ("a" + " " * 300_000 + "b", "\n \t" * 100_000, "ab" * 200_000, "7" * 100_000, "é" * 100_000, "?!" * 100_000):
        assert np.frombuffer(codes.encode(long), "<u4").tolist() == model.encode(long, add_special_tokens=False).ids
    # another kind of file goes to the tokenizer whole
    other, model = ByteEncoder(WORDS), Tokenizer.from_file(WORDS)
    assert other.ranks is None
    assert np.frombuffer(other.encode("Aé b"), "<u4").tolist() == model.encode("Aé b", add_special_tokens=False).ids


def test_pack(spark):
    texts = awkward_texts() + [(500 + i, t) for i, t in enumerate(HARD)] + [(4, "one")]
    df = spark.createDataFrame(texts, SCHEMA).withColumns({"length": F.lit("x"), "start": F.lit(1), "_id": F.lit(2), "_part": F.lit(None)})
    model = Tokenizer.from_file(BYTE)
    rows = pack(df, BYTE).collect()
    ids = [(i, [*model.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]
    want = collections.Counter()
    for i, all_ids in ids:
        for a in range(0, len(all_ids), 2048):
            piece = all_ids[a : a + 2048]
            want[(i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(all_ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    packs = collections.defaultdict(list)
    for r in rows:
        packs[r.sequence_id].append((r.offset, r.length))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(packs) == list(range(len(packs)))
    assert len(packs) <= sum(r.length for r in rows) / 2048 * 1.02 + 1
    assert pack(df.limit(0), BYTE).count() == 0


def test_patterns_place_everything_once():
    rnd = random.Random(7)
    for _ in range(40):
        histogram = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(rnd.randint(0, 30))}
        patterns = shortest_pack_first(histogram, 64)
        placed = collections.Counter()
        for pattern, count in patterns:
            assert sum(n * t for n, t in pattern) <= 64
            for length, times in pattern:
                placed[length] += times * count
        assert dict(placed) == histogram
        for length, runs in slots(patterns).items():
            assert runs[0, 0] == 0 and (np.diff(runs[:, 0]) > 0).all() and runs[-1, 0] < histogram[length]


def test_codes_of_every_text():
    texts = ["b a a", None, "", "c  d\nb", "a", "é é a", "a b c d e f g h i j k l m n o p", *thue_morse(1024)]
    for some in (texts, texts[1:3], []):
        batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(len(some)), pa.int64()), "_text": pa.array(some, pa.string())})
        counts, codes, words = bpe.read_words(batch)
        ends = np.cumsum(counts)
        assert [[words[c].decode() for c in codes[e - n : e]] for e, n in zip(ends, counts)] == [(t or "").split() for t in some]
        assert len(set(words)) == len(words)


def test_encode_decode(spark):
    texts = awkward_texts() + [(500 + i, t) for i, t in enumerate(HARD)] + [(4, "one")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    # behind a shuffle the rows come in another order each time they are read
    df = docs.unionByName(spark.createDataFrame(texts, SCHEMA)).repartition(5).withColumns({"block": F.lit("x"), "codes": F.lit(1), "payload": F.lit(None)})
    model = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for r in df.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False)))] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(df, WORDS).collect())
    assert got == want
    assert encode_decode(awkward(spark).limit(0), WORDS).count() == 0
