"""Filter interactions, the positional index, and the divergence of sources, against plain readings."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens.llm import positional_index as index_module
from opslens.llm.byte_audit import Scan, audit_filters, first_spans
from opslens.llm.positional_index import build_index, find_contamination, near_matches, phrase_matches
from opslens.llm.term_transducer import Transducer, audit_sources
from opslens.llm.tokens import column_bytes
from tests.llm.helpers import LOWER, WORD, awkward_texts

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def documents():
    rows = awkward_texts()
    rows += [(501, "SHOUTED Words # and $ signs | é漢"), (502, "x" * 200 + " " + "x" * 199 + "y " + "x" * 200), (-3, "one"), (-3, "one"), (503, "one")]
    return [(i, t, ["en", "de", None, ""][k % 4], [None, "", "s1", "s2", "s3"][k % 5]) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3).withColumns({"_id": F.lit("x"), "part": F.lit(3), "_segment": F.lit(None).cast("int"), "count": F.lit(0)})


def test_scan_counts_and_spans():
    texts = [t for _, t, *_ in documents()]
    scan = Scan(*column_bytes(pa.array(texts, pa.string())))
    distinct = scan.distinct()
    for k, text in enumerate(t or "" for t in texts):
        words = WORD.findall(text)
        got = [scan.raw[s:e].tobytes().decode() for s, e in zip(scan.starts[scan.bounds[k] : scan.bounds[k + 1]], scan.ends[scan.bounds[k] : scan.bounds[k + 1]])]
        assert got == words
        assert (distinct[k], scan.points[k], scan.upper[k], scan.symbols[k]) == (len(set(words)), len(text), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)))


def test_spans_with_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr("opslens.llm.byte_audit.mix", lambda x: np.zeros(len(x), np.uint64))
    words = ["a", "b", "a", "abcdefghi", "abcdefghj", "abcdefghi", "z" * 70, "z" * 69 + "y", "z" * 70, "b"]
    raw, offsets = column_bytes(pa.array(words))
    owner = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    assert first_spans(raw, offsets[:-1], offsets[1:], owner).tolist() == [0, 1, 0, 3, 4, 3, 6, 7, 6, 9]


def test_filter_interactions(spark):
    rows, labels = documents(), [(7, 1, 0), (8, 0, 1), (8, 1, 0), (100, 1, 1), (4, None, 1), (None, 1, 1), (99999, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, _, source in rows:
        t = t or ""
        words = WORD.findall(t)
        no = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        failed.append((source or "", {k for k, v in no.items() if v}, i in good, i in toxic))
    want, shapley = {}, collections.Counter()
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = [f for f in mine if x in f[1] and not f[1] & set(order[:k])]
                shapley[part, x] += len(gone)
                want[part, order, k + 1] = (sum(not f[1] & set(order[: k + 1]) for f in mine), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit_filters(frame(spark), table).collect()}
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert audit_filters(frame(spark).limit(0), table).count() == 0
    assert {r.good_lost for r in audit_filters(frame(spark), table.limit(0)).collect()} == {0}


ITEMS = [
    (1, "One"), (2, " ".join(f"shared{i}" for i in range(5, 25))), (3, "start3 shared0 shared1"), (4, None), (5, ""), (6, "no such words at all"), (None, "own7y3 own7y4"), (20, "xyz " * 12),
    (2, "漢字"), (30, " ".join(f"w{i}x0" for i in range(11))), (30, "own3y1 OWN3Y2"), (31, "xyz xyz"), (40, "base5 base6"),
]


def phrase_reading(rows, items, width):
    """Per row: words, words hit, ids of the items, and (item, places) of all windows."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = TERM.findall((text or "").translate(LOWER))
        for a in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[a : a + width])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, text, *_ in rows:
        words = TERM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in lengths:
            for a in range(len(words) - k + 1):
                for item in windows.get(tuple(words[a : a + k]), ()):
                    hit.update(range(a, a + k))
                    found.add((item, a))
        out.append((i, len(words), len(hit), {x for x, _ in found if x is not None}, found))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_contamination(spark, monkeypatch, small):
    if small:  # segments of a text or two, queries in many blocks, few beginnings at a time
        monkeypatch.setattr(index_module, "SEGMENT_BYTES", 500)
        monkeypatch.setattr(index_module, "QUERY_BYTES", 60)
        monkeypatch.setattr(index_module, "FOLLOWED", 3)
    monkeypatch.setattr(index_module.query_blocks, "__defaults__", (index_module.QUERY_BYTES,))
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("_id", F.lit("y"))
    want = sorted(map(str, ((i, n, hit, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), hit > 0) for i, n, hit, ids, _ in phrase_reading(rows, ITEMS, 10))))
    got = find_contamination(frame(spark), items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    if small:
        return
    assert find_contamination(frame(spark).limit(0), items).count() == 0
    none = find_contamination(frame(spark), items.limit(0))
    assert none.where("n_hit > 0 or n_items > 0 or contaminated").count() == 0 and none.count() == len(rows)


def test_phrases_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(index_module, "SEGMENT_BYTES", 2000)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 40)), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02])), "en", "s") for i in range(300)]
    items = [(1, "a b c"), (2, "h g"), (3, "e"), (4, "a a b"), (5, "f a b d h"), (6, ""), (7, "zz a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    index = build_index(frame(spark, rows)).persist()
    phrases = {(r._id, r._item, s.start + k) for r in phrase_matches(index, table, 2).collect() for s in r._spans for k in range(s.length)}
    want = set()
    for i, _, _, _, found in phrase_reading(rows, items, 2):
        size = {item: min(2, len(text.split())) for item, text in items}
        want |= {(i, item, a + k) for item, a in found for k in range(size[item])}
    assert phrases == want
    near = {(r._id, r._item, s.start, s.length) for r in near_matches(index, table, 6).collect() for s in r._spans}
    want = set()
    for i, text, *_ in rows:
        words = text.split()
        for item, query in items:
            asked = set(query.split())
            for a in range(len(words)):
                ends = [b for b in range(a + 1, min(a + 6, len(words)) + 1) if asked and asked <= set(words[a:b])]
                if ends and words[a] in asked and words[a] not in words[a + 1 : ends[0]]:
                    want.add((i, item, a, ends[0] - a))
    assert near == want
    index.unpersist()


def test_transducer_is_minimal_and_ordered():
    rng = np.random.default_rng(3)
    for _ in range(50):
        words = sorted({bytes(rng.integers(97, 100, int(rng.integers(0, 6))).astype(np.uint8)) for _ in range(int(rng.integers(0, 60)))})
        made = Transducer.load(Transducer.build(iter(words)).dump())
        asked = sorted({bytes(w) for w in words} | {b"a", b"abcabcab", b"zz", b""})
        raw, offsets = column_bytes(pa.array(asked, pa.binary()))
        assert made.ordinals(raw, offsets[:-1], np.diff(offsets)).tolist() == [words.index(w) if w in words else -1 for w in asked]
        assert [made.word(i) for i in range(len(words))] == words
        # as many states as different sets of endings
        endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} | {b""}}
        assert len(made.final) == len(endings)
    with pytest.raises(ValueError, match="rise"):
        Transducer.build(iter([b"b", b"a"]))


def divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", LETTERS.findall((t or "").translate(LOWER))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in seen.items() if n >= min_docs]
        sources = {d[1] for d in mine}
        counts = {s: collections.Counter(w for d in mine if s in (d[1], None) for w in d[2]) for s in sources}
        counts[None] = sum(counts.values(), collections.Counter())

        def p(s, w):
            return 1 + 10**9 * (counts[s][w] + 5) // (sum(counts[s][x] for x in kept) + 5 * len(kept))

        for s in sources:
            pairs = sorted(((-sum(abs(p(s, w) - p(o, w)) for w in kept), o.encode()) for o in sources - {s}))
            terms = sorted((p(None, w) - p(s, w), w.encode()) for w in kept if counts[s][w] and p(s, w) > p(None, w))[:top]
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)} | {(lang, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(terms)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"piece_terms": 7, "most": 4000}])
def test_source_divergence(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr("opslens.llm.term_transducer.BLOCK_TERMS", 8)
    rows = documents()
    got = audit_sources(frame(spark), min_docs=3, top=9, **sizes).collect()
    assert {tuple(r) for r in got} == divergence(rows, 3, 9) and len(got) == len(divergence(rows, 3, 9))
    if not sizes:
        bare = [(i, None if i % 2 else "1 2", lang, source) for i, _, lang, source in rows if i]
        assert {tuple(r) for r in audit_sources(frame(spark, bare), min_docs=1).collect()} == divergence(bare, 1, 50)
        assert audit_sources(frame(spark).limit(0)).count() == 0
