"""Near-duplicate classes: MinHash bands for candidates, odd sketches to estimate them, full shingle sets to confirm.

1. Every text becomes its set of distinct word shingles, from that its size, a 128-bit hash of the set, MinHash values, band
   keys, and the odd sketch: MinHash values folded into a bitmap by parity, so that the population count of the XOR of
   two sketches tells how many values differ. Sketches are most precise where sets are most alike.
2. Equal sets are one class from here on, however many copies there are.
3. Classes that share a band key are candidates. Inside a bucket the sketches estimate every pair at once with XOR and
   popcount; pairs far below the threshold go. What hangs together by the others is a candidate group.
4. The full sets of the members of a group meet and each pair is counted exactly. A group yields one row per member
   (its smallest linked relative), never its pairs. A large group is cut into blocks, and each two blocks meet in a task.
5. Links become components by star contraction with a written table per round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.repeats import parts_of, text_chunks
from opslens.llm.suffix_dedup import spread
from opslens.llm.tokens import Slices, Words, grams, mix
from opslens.session import materialize

SKETCH_BITS = 256
HOT_BUCKET = 20_000
GROUP_BLOCK = 1024


@dataclass(frozen=True)
class Likeness:
    """Shingle width, similarity percent / 100 that links, and the bands (`bands` times `rows` MinHash values).

    With 24 bands of 5 a pair at 0.85 misses all bands once in a million; with 24 of 4 a pair at 0.8 three times.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 5

    def most_differing_bits(self) -> int:
        """Sketch bits in which a pair at the threshold may differ: 5.5 deviations of its MinHash values and 3 of the folding."""
        k, t = self.bands * self.rows, self.percent / 100
        differing = k * (1 - t) + 5.5 * (k * t * (1 - t)) ** 0.5
        share = (1 - np.exp(-4 * differing / SKETCH_BITS)) / 2
        return int(SKETCH_BITS * share + 3 * (SKETCH_BITS * share * (1 - share)) ** 0.5) + 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and their offsets. A text with fewer words is one shingle."""
    words = Words(raw, offsets, lower=True)
    symbols, places = words.hashes(), words.text_offsets
    count = np.diff(places)
    owner = words.text_of_word()
    found = grams(symbols, width)
    good = owner[: len(found)] == owner[width - 1 :][: len(found)]
    short = np.flatnonzero((count > 0) & (count < width))
    few = Slices(symbols).hash(places[:-1][short], places[1:][short])
    values = np.concatenate([found[good], mix(few + np.uint64(1))])
    owners = np.concatenate([owner[: len(found)][good], short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(offsets)))


def sketches(values: np.ndarray, offsets: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set hash (2 columns), band keys and odd sketch (4 words of 64 bits) of every non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    n = len(starts)
    identity = np.column_stack([np.add.reduceat(mix(values ^ np.uint64(s)), starts) for s in (0x1234567, 0x89ABCDEF)])
    keys, sketch = np.zeros((n, like.bands), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
    seeds = mix(np.arange(1, like.bands * like.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = np.arange(n)
    for i, seed in enumerate(seeds):
        smallest = np.minimum.reduceat((values ^ seed) * (seed | np.uint64(1)), starts)
        bit = mix(smallest ^ (seed >> np.uint64(1))) % np.uint64(SKETCH_BITS)
        sketch[rows, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
        band = i // like.rows
        keys[:, band] = mix(keys[:, band] ^ smallest) + np.uint64(band + 1)
    return identity, keys, sketch


def sketch_rows(named: DataFrame, like: Likeness) -> DataFrame:
    """_id, n_shingles, _h1, _h2, _bands, _sketch; the last four are null for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in text_chunks(batch.column(1)):
                values, bounds = shingle_sets(raw, offsets, like.shingle)
                count = np.diff(bounds)
                filled = np.flatnonzero(count > 0)
                if len(filled):
                    identity, keys, sketch = sketches(values, bounds, like)
                else:
                    identity, keys, sketch = np.zeros((0, 2), np.uint64), np.zeros((0, like.bands), np.uint64), np.zeros((0, 4), np.uint64)
                at = np.full(len(count), -1)
                at[filled] = np.arange(len(filled))
                take = pa.array(at, pa.int64(), mask=at < 0)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), like.bands).cast(pa.list_(pa.int64()))
                bitmaps = pa.array([x.tobytes() for x in sketch], pa.binary())
                columns = [pa.array(identity[:, i].view(np.int64) if len(filled) else np.zeros(0, np.int64)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(count)), pa.array(count, pa.int64()), *[c.take(take) for c in columns], bands.take(take), bitmaps.take(take)],
                    ["_id", "n_shingles", "_h1", "_h2", "_bands", "_sketch"],
                )

    return named.mapInArrow(work, "_id long, n_shingles long, _h1 long, _h2 long, _bands array<long>, _sketch binary")


def label_links(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member that each of n members reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def likely_links(sketch: np.ndarray, size: np.ndarray, starts: np.ndarray, count: np.ndarray, like: Likeness) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between members of the same bucket that sizes and sketches allow, block by block."""
    most = like.most_differing_bits()

    def allowed(a, b):
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        good = 100 * low >= like.percent * high
        a, b = a[good], b[good]
        bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        return a[bits <= most], b[bits <= most]

    # member i of a bucket against all after it, for many buckets at a time or a part of a large one
    member = np.flatnonzero(np.ones(int(count.sum()), dtype=bool))
    bucket = np.repeat(np.arange(len(starts)), count)
    inner = member - np.repeat(np.cumsum(count) - count, count)
    first = starts[bucket] + inner
    after = count[bucket] - inner - 1
    work = np.cumsum(after)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 20), side="right")))
        group, other = spread(first[at:to] + 1, after[at:to])
        yield allowed(first[at:to][group], other)
        at = to


def candidate_groups(buckets: DataFrame, like: Likeness) -> DataFrame:
    """Distinct (_group, _rep) of at least two classes that hang together by likely links in a bucket (_key, _rep, n_shingles, _sketch)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        key = table.column("_key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(starts, len(key)))
        shared = np.repeat(count > 1, count)
        order = order[shared]
        count = count[count > 1]
        starts = np.cumsum(count) - count
        if not len(order):
            return
        some = table.take(pa.array(order))
        rep, size = some.column("_rep").to_numpy(), some.column("n_shingles").to_numpy()
        sketch = np.frombuffer(b"".join(some.column("_sketch").to_pylist()), np.uint64).reshape(len(order), -1)
        links = list(likely_links(sketch, size, starts, count, like))
        a, b = (np.concatenate([x[i] for x in links]) for i in (0, 1))
        label = label_links(a, b, len(order))
        linked = np.bincount(label, minlength=len(order))[label] > 1
        rep, label = rep[linked], label[linked]
        by = np.lexsort((rep, label))
        rep, label = rep[by], label[by]
        cuts = np.flatnonzero(np.append(True, label[1:] != label[:-1])) if len(label) else np.zeros(0, np.int64)
        groups, members = [], []
        for part in np.split(rep, cuts[1:]):
            pieces = [part] if len(part) <= GROUP_BLOCK else np.array_split(part, -(-2 * len(part) // GROUP_BLOCK))
            pairs = [part] if len(pieces) == 1 else [np.concatenate([x, y]) for i, x in enumerate(pieces) for y in pieces[i + 1 :]]
            for found in pairs:
                if len(found):
                    # the same members meet in many bands: the group's name is a hash of them
                    name = Slices(mix(np.sort(found).astype(np.uint64))).hash(np.array([0]), np.array([len(found)])).view(np.int64)
                    groups.append(np.repeat(name, len(found)))
                    members.append(found)
        if groups:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(members))], ["_group", "_rep"])

    return buckets.mapInArrow(work, "_group long, _rep long").distinct()


def exact_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with 100 * intersection >= percent * union. Elements of one set only cannot meet; of the others the
    intersections of all pairs are a product of 0/1 matrices, taken in blocks of elements.
    """
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        hit = 100 * both >= percent * (sizes[0] + sizes[1] - both)
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    count = np.diff(np.append(starts, len(values)))
    met = np.repeat(count > 1, count)
    column = np.repeat(np.arange(len(starts)), count)[met]
    owner = owner[met]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((m, m), np.float32)
    width = 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        i, j = np.searchsorted(column, [a, a + width])
        block = np.zeros((m, width), np.float32)
        block[owner[i:j], column[i:j] - a] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu(100 * both.astype(np.int64) >= percent * union.astype(np.int64), 1))


def confirm(named: DataFrame, groups: DataFrame, like: Likeness) -> DataFrame:
    """Distinct links (_from, _to), _to the smallest member that _from reaches by exact links inside a group."""
    parts = parts_of(named)
    wanted = groups.groupBy("_rep").agg(F.collect_list("_group").alias("_groups"))
    # a list of candidates that is small today grows with the documents: join alike at every size
    joined = named.join(wanted.hint("merge"), named["_id"] == wanted["_rep"]).select("_id", "_text", "_groups")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, raw, offsets in text_chunks(batch.column(1)):
                values, bounds = shingle_sets(raw, offsets, like.shingle)
                groups, members, counts, data = [], [], [], []
                for i in range(len(offsets) - 1):
                    mine = values[bounds[i] : bounds[i + 1]]
                    packed = mine.astype("<u8").tobytes()
                    for group in lists[row + i]:
                        groups.append(group)
                        members.append(ids[row + i])
                        counts.append(len(mine))
                        data.append(packed)
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(members, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], ["_group", "_rep", "_n", "_set"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        group = table.column("_group").to_numpy()
        rep, size = table.column("_rep").to_numpy(), table.column("_n").to_numpy()
        data = table.column("_set")
        order = np.lexsort((rep, group))
        a, b = [], []
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            values = [np.frombuffer(data[i].as_py(), "<u8") for i in part.tolist()]
            x, y = exact_links(values, size[part], like.percent)
            label = label_links(np.asarray(x), np.asarray(y), len(part))
            tied = label != np.arange(len(part))
            a.append(rep[part[tied]])
            b.append(rep[part[label[tied]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["_from", "_to"])

    shipped = joined.mapInArrow(sets, "_group long, _rep long, _n long, _set binary").repartition(parts, "_group")
    return shipped.mapInArrow(meet, "_from long, _to long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(_node, _root): the smallest node that each linked node reaches. `links` has _from and _to.

    Star contraction: every larger neighbour of a node is hung on the node's smallest neighbour, then every smaller one, until
    nothing changes. Each round is written, so no lineage builds up, and a node with any number of neighbours is only
    joined and reduced to a minimum.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        # edges are (u, v), u > v
        both = edges.select("u", "v")
        if larger:
            both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        seen = both.join(least, "u")
        if larger:
            out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    edges = materialize(links.select(F.greatest("_from", "_to").alias("u"), F.least("_from", "_to").alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("_node"), F.col("v").alias("_root"))
        before = mark
        edges = materialize(star(star(edges, True), False), "links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness(), hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable over links) and kept (id = component_id).

    Words are compared without A-Z case. Null and empty texts have the empty set and link with nothing. A row with a null id
    has no component and is kept. An id names one text. Other columns are not read.

    The classes of a band key that more than `hot_bucket` share are cut into blocks, and each two blocks meet in a bucket of their
    own: no pair is lost, but the work for such a key grows with its square.
    """
    parts = parts_of(docs)
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = materialize(sketch_rows(named, like), "sketches")
    filled = rows.where("_id is not null and n_shingles > 0")
    classes = filled.groupBy("_h1", "_h2", "n_shingles").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"), F.first("_sketch").alias("_sketch"))
    classes = materialize(classes, "classes")
    keyed = classes.select("_rep", "n_shingles", "_sketch", "_bands", F.explode("_bands").alias("_key"))
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    counts = materialize(counts.where("_n > 1"), "buckets")
    hot = counts.where(F.col("_n") > hot_bucket).select(F.col("_key").alias("_hot"), F.ceil(2 * F.col("_n") / F.lit(hot_bucket)).cast("int").alias("_blocks"))
    plain = keyed.select("_key", "_rep", "n_shingles", "_sketch")
    if not hot.isEmpty():
        # at most bands / hot_bucket of the classes can be hot keys
        split = keyed.join(hot, keyed["_key"] == hot["_hot"], "left")
        mine = F.pmod(F.xxhash64("_rep"), F.col("_blocks").cast("long")).cast("int")
        met = split.where("_hot is not null").withColumn("_mine", mine).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)"))).where("_other <> _mine")
        met = met.select(F.xxhash64("_key", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("_key"), "_rep", "n_shingles", "_sketch")
        plain = split.where("_hot is null").select(*plain.columns).unionByName(met)
    groups = materialize(candidate_groups(plain.repartition(parts, "_key"), like), "groups")
    roots = components(confirm(named.where("_id is not null"), groups, like))
    of_class = classes.select("_h1", "_h2", "n_shingles", "_rep").join(roots, F.col("_rep") == F.col("_node"), "left")
    of_class = of_class.select("_h1", "_h2", F.col("n_shingles").alias("_n"), F.coalesce("_root", "_rep").alias("_component"))
    narrow = rows.select("_id", "n_shingles", "_h1", "_h2")
    same = (narrow["_h1"] == of_class["_h1"]) & (narrow["_h2"] == of_class["_h2"]) & (narrow["n_shingles"] == of_class["_n"])
    joined = narrow.where("n_shingles > 0").join(of_class, same, "left").select("_id", "n_shingles", "_component")
    result = joined.unionByName(narrow.where("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("_component")))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    kind = docs.schema[id_col].dataType
    return result.select(
        F.col("_id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness(shingle=5, percent=80, rows=4)) -> DataFrame:
    """The rows of `docs` that are the smallest id of their class, with all columns.

    Null and empty texts link with nothing and stay, as do rows without an id. Rows that repeat an id share its fate: they stay if
    a text of the id is the smallest of its class. An empty table stays empty.
    """
    kept = near_classes(docs, id_col, text_col, like).where("kept").select(F.col(id_col).alias("_kept_id"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
