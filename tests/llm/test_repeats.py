"""Repeated passages and near copies against plain readings."""

from __future__ import annotations

import collections
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens.llm import odd_minhash, repeats
from opslens.llm.fm_dedup import FMIndex, remove_word_repeats, strip_word_repeats
from opslens.llm.odd_minhash import Likeness, components, drop_near_copies, exact_links, near_classes
from opslens.llm.suffix_dedup import SuffixArray, maximal_groups, maximal_repeats, prefix_intervals, remove_repeats
from tests.llm import helpers
from tests.llm.helpers import awkward, awkward_texts, sha

CLASH = ("_id", "_text", "_block", "_changed", "_new", "n_removed", "_n", "_rep", "_kept_id", "_h1")


def some_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    return docs.unionByName(awkward(spark)).withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})


@pytest.mark.parametrize("hot", [1000, 2])
def test_byte_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_DOCS", hot)
    df = some_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = helpers.byte_repeats(rows)
    got = remove_repeats(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert sum(w[1] for w in want.values()) > 5000
    assert remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_word_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_DOCS", hot)
    df = some_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = helpers.word_repeats(rows)
    got = remove_word_repeats(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == {i: (n, k, sha(t)) for i, (n, k, t) in want.items()}
    left = strip_word_repeats(df.withColumn("n_chars", F.length("text")))
    assert left.columns == [*df.columns, "n_chars"]
    texts = dict(r for r in rows if r[0] is not None)
    expected = {i: t if k else texts[i] for i, (_, k, t) in want.items() if not k or t}
    kept = [r for r in left.collect() if r.doc_id is not None]
    assert {r.doc_id: r.text for r in kept} == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    assert remove_word_repeats(df.limit(0)).count() == 0 and strip_word_repeats(df.limit(0)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(60):
        limit, letters = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        texts = [rng.integers(0, letters, int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 6)))]
        if not sum(map(len, texts)):
            continue
        index = FMIndex(np.concatenate(texts).astype(np.int64), np.append(0, np.cumsum([len(t) for t in texts])), limit)
        parts = collections.Counter(tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, min(len(t), a + limit) + 1))
        asked = [rng.integers(-1, letters + 1, int(rng.integers(0, 40))) for _ in range(3)]
        bounds = np.append(0, np.cumsum([len(s) for s in asked]))
        length, low = index.matching_statistics(np.concatenate(asked).astype(np.int64), bounds)
        for j, s in enumerate(asked):
            for a in range(len(s)):
                m = 0
                while m < limit and a + m < len(s) and tuple(s[a : a + m + 1]) in parts:
                    m += 1
                assert length[bounds[j] + a] == m
                if m == limit:
                    block = index.block[low[bounds[j] + a]]
                    assert index.block_end[block] - index.block_start[block] == parts[tuple(s[a : a + m])]


def test_intervals_are_maximal_repeats():
    rng = np.random.default_rng(2)
    for _ in range(40):
        texts = [bytes(rng.integers(97, 100, int(rng.integers(6, 30))).astype(np.uint8)) for _ in range(4)]
        array = SuffixArray(texts, np.array([len(t) - 3 for t in texts]))
        first, last, depth = prefix_intervals(array.depth, 4)
        for a, b, d in zip(first, last, depth):
            inside = array.depth[a:b]
            assert inside.min() == d and (a == 0 or array.depth[a - 1] < d) and (b == len(array.depth) or array.depth[b] < d)
        whole = collections.defaultdict(list)
        for i, t in enumerate(texts):
            for p in range(len(t) - 3):
                for n in range(4, len(t) - p + 1):
                    whole[t[p : p + n]].append((i, p))
        maximal = {s for s, at in whole.items() if len(at) > 1 and len({texts[i][p + len(s) : p + len(s) + 1] or (i,) for i, p in at}) > 1 and len({texts[i][p - 1 : p] or (i,) for i, p in at}) > 1}
        first, last, depth = maximal_groups(array, 4)
        found = {}
        for a, b, d in zip(first, last, depth):
            p = array.place[a]
            found[texts[array.owner[a]][p : p + d]] = sorted(zip(array.owner[a : b + 1].tolist(), array.place[a : b + 1].tolist()))
        assert maximal <= found.keys()
        assert all(sorted(whole[s]) == at for s, at in found.items())


def test_repeat_groups_list_all_occurrences(spark):
    rows = [(i, t) for i, t in awkward_texts() if i is not None]
    texts = {i: (t or "").encode() for i, t in rows}
    got = maximal_repeats(awkward(spark)).collect()
    assert got
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.repeat].append((texts[r.doc_id][r.start : r.start + r.length], r.doc_id, r.start))
    for found in groups.values():
        assert len({x[0] for x in found}) == 1 and len(set(found)) > 1 and len(found[0][0]) >= 50


@pytest.mark.parametrize(("hot", "parts"), [(1000, 8), (1000, 1), (20, 3)])
def test_repeat_groups_are_complete(spark, monkeypatch, hot, parts):
    """Every repeated window lies in a group with just its places; every group has all places of its bytes."""
    monkeypatch.setattr(repeats, "HOT_DOCS", hot)
    base = " ".join(f"inner{k}" for k in range(30))
    rows = [(i, t) for i, t in awkward_texts() if i not in (None, 7, 8)]
    # exact copies, a passage twice in one document, and periodic texts of which a part stands elsewhere
    rows += [(500 + i, " ".join(f"copy{k}" for k in range(50))) for i in range(9)] + [(520, f"{base} once more {base}")]
    rows += [(530, "a" * 200), (531, "b" + "a" * 70 + "c"), (532, "ab" * 60), (533, "x" + "ab" * 33 + "y"), (534, "pqr" * 40)]
    texts = {i: (t or "").encode() for i, t in rows}
    places = collections.defaultdict(set)
    for i, data in texts.items():
        for p in range(len(data) - 49):
            places[data[p : p + 50]].add((i, p))
    monkeypatch.setattr(repeats, "parts_of", lambda df: parts)
    monkeypatch.setattr("opslens.llm.suffix_dedup.parts_of", lambda df: parts)
    df = spark.createDataFrame(rows + [(500, texts[500].decode())], helpers.SCHEMA).repartition(4)
    groups = collections.defaultdict(list)
    for r in maximal_repeats(df).collect():
        groups[r.repeat, r.length].append((r.doc_id, r.start))
    covered = collections.defaultdict(set)
    for (_, n), found in groups.items():
        i, p = found[0]
        data = texts[i][p : p + n]
        assert len(data) == n >= 50 and len(found) == len(set(found)) > 1
        assert set(found) == {(j, q) for j, q in places[data[:50]] if texts[j][q : q + n] == data}
        for d in range(n - 49):
            covered[data[d : d + 50]].add(frozenset((j, q + d) for j, q in found))
    repeated = {w: at for w, at in places.items() if len(at) > 1}
    assert len(repeated) > 1000 and all(frozenset(at) in covered[w] for w, at in repeated.items())


def test_hot_anchors_are_bounded(spark, monkeypatch):
    """Few texts, each copied often: every anchor stands in many documents, but no more than HOT_SHARE are hot."""
    monkeypatch.setattr(repeats, "HOT_DOCS", 2)
    rows = [(i, " ".join(f"text{i % 20}word{k}" for k in range(20))) for i in range(800)]
    found = repeats.repeated_anchors(spark.createDataFrame(rows, "_id long, _text string").repartition(4), repeats.BYTES_50, 4).cache()
    for share in (5, 50):
        monkeypatch.setattr(repeats, "HOT_SHARE", share)
        assert len(repeats.hot_anchors(found)) <= share
    monkeypatch.setattr(repeats, "HOT_SHARE", 1_000_000)
    assert len(repeats.hot_anchors(found)) > 50
    found.unpersist()


@pytest.mark.parametrize(("like", "hot", "block"), [(Likeness(), 20_000, 1024), (Likeness(5, 80, rows=4), 3, 4)])
def test_near_classes(spark, monkeypatch, like, hot, block):
    monkeypatch.setattr(odd_minhash, "GROUP_BLOCK", block)
    df = some_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = helpers.near_classes(rows, like.shingle, like.percent)
    got = near_classes(df, like=like, hot_bucket=hot).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 20
    kept = drop_near_copies(df, like=like)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert near_classes(df.limit(0), like=like).count() == 0


def test_hot_band_keys_lose_no_pair(spark):
    """With one band no second key is left for the classes of a hot one."""
    df = some_documents(spark)
    like = Likeness(bands=1, rows=1)
    want, got = ({r.doc_id: r.component_id for r in near_classes(df, like=like, hot_bucket=hot).collect()} for hot in (20_000, 3))
    assert got == want and len(set(want.values())) < len(want) - 20


def test_exact_links_count_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(25)]
    sizes = np.array([len(s) for s in sets])
    got = set(zip(*(x.tolist() for x in exact_links(sets, sizes, 50))))
    want = {(i, j) for i in range(25) for j in range(i + 1, 25) if 100 * len(set(sets[i]) & set(sets[j])) >= 50 * len(set(sets[i]) | set(sets[j]))}
    assert got == want and want


def test_sketches_tell_how_many_values_differ():
    like = Likeness()
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for other in (1.0, 0.9, 0.86):
        keep = int(400 * 2 * other / (1 + other))
        changed = np.concatenate([base[:keep], rng.integers(0, 1 << 63, 400 - keep).astype(np.uint64)])
        _, _, sketch = odd_minhash.sketches(np.concatenate([np.sort(base), np.sort(changed)]), np.array([0, 400, 800]), like)
        assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= like.most_differing_bits()
    _, _, sketch = odd_minhash.sketches(np.sort(rng.integers(0, 1 << 63, 800).astype(np.uint64)), np.array([0, 400, 800]), like)
    assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() > like.most_differing_bits()


def test_components_follow_chains(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (200, 201), (201, 200), (300, 300)]
    got = {r._node: r._root for r in components(spark.createDataFrame(chain, "_from long, _to long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90, 201: 200}


def traced(run):
    """Result of `run` and the MB of Python and numpy that it held at most."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_block_whose_passages_all_repeat():
    letters = np.random.default_rng(5).integers(97, 123, (2000, 2000)).astype(np.uint8)
    texts, ids, unit = [x.tobytes().decode() for x in letters], np.arange(2000), repeats.BYTES_50
    block = pa.table({"_id": ids, "_text": texts})
    doc, anchor = [], []
    for at, raw, offsets in repeats.text_chunks(block.column("_text").combine_chunks()):
        runs = repeats.window_runs(*unit.symbols(raw, offsets)[:2], unit)
        doc.append(ids[at + runs.text])
        anchor.append(runs.anchor)
    asked = pa.table({"docs": [repeats.planes(np.concatenate(doc))], "anchors": [repeats.planes(np.concatenate(anchor))]})
    out, most = traced(lambda: repeats.passages((pa.scalar(0),), block, asked, unit, np.zeros(0, np.uint64), 20))
    rows = out.to_pylist()
    count, size = (np.concatenate([repeats.unplanes(r[c], "<i4") for r in rows]) for c in ("count", "size"))
    assert count.sum() == 2000 * 1951 and (size == count + 49).all()
    assert sum(len(r["data"]) for r in rows) == size.sum()
    for r in rows:
        a, starts = 0, repeats.unplanes(r["start"], "<i4")
        for d, f, n in zip(repeats.unplanes(r["doc"], "<i8")[:50], starts, repeats.unplanes(r["size"], "<i4"), strict=False):
            assert r["data"][a : a + n].decode() == texts[d][f : f + n]
            a += n
    # 24 MB of rows; 158 MB while every run was a tuple of Python numbers
    assert most < 120


def test_memory_of_a_suffix_array():
    letters = np.random.default_rng(6).integers(97, 100, (250, 2000)).astype(np.uint8)
    contents = [x.tobytes() for x in letters]
    array, most = traced(lambda: SuffixArray(contents, np.full(250, 1951), 76))
    suffixes = [contents[o][p : p + 76] for o, p in zip(array.owner.tolist(), array.place.tolist(), strict=True)]
    assert suffixes == sorted(suffixes) and len(suffixes) == 250 * 1951
    # the suffixes side by side are 39 MB; they were held four times
    assert most < 100
