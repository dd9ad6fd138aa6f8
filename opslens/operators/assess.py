"""Assessment scoring: criteria, detector scores, key repair, dependencies, weights, similarity.

Scores are long rows `item_id, criterion, score, confidence, verdict, method`. Criteria are the request's own
short list; everything taken from them becomes literals in the plan, so no join with a handful of keys
squeezes the scores into a handful of tasks.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.columns import clamp, exact_mean, mapping, one_of, round_binary, verdict
from opslens.functions.scale import beside, first_per_key, last_per_key
from opslens.functions.text import map_texts, strip


@dataclass(frozen=True)
class Criterion:
    name: str
    type: str = "llm"
    weight: float = 1.0
    hint: str = "auto"
    depends_on: str | None = None


# Size limits, file signatures and types of images.
MIN_SIDE, MAX_SIDE = 100, 1000
JPEG_SIGNATURE, PNG_SIGNATURE = "FFD8FF", "89504E470D0A1A0A"
IMAGE_TYPES = ("jpeg", "jpg", "png")

# Detector kinds and the criterion names that select them.
DETECTORS = {
    "sharpness": ("sharpness", "is sharp", "is blurry"),
    "exposure": ("exposure", "proper exposure", "is exposed"),
    "vegetation": ("has trees", "has vegetation", "has greenery", "has plants"),
    "sky": ("has sky",),
    "faces": ("has faces", "has people", "has person"),
    "water": ("has water", "has pool", "has swimming pool"),
    "text": ("has text", "has text regions", "has writing"),
}
# Measure bands of the coverage detectors. (pass above, marginal from, pass step, marginal step,
# confidence at pass: base, slope, top; at marginal; at fail)
BANDS = {
    "vegetation": (0.15, 0.05, 0.05, 0.01, 60, 150, 95, 65, 75),
    "sky": (0.60, 0.30, 0.10, 0.10, 70, 20, 90, 65, 70),
    "water": (0.15, 0.05, 0.05, 0.033, 65, 100, 85, 60, 70),
    "text": (0.10, 0.03, 0.05, 0.023, 65, 150, 85, 60, 75),
}
BLUR_LIMIT, DARK_LIMIT, BRIGHT_LIMIT = 100.0, 30.0, 220.0
FUZZY_CUTOFF = 0.6


def validity_gate(media: DataFrame) -> DataFrame:
    """Adds `problem` (null for usable images) and the size after scaling the long side to the limit."""
    signature = F.hex("signature")
    known = signature.startswith(JPEG_SIGNATURE) | signature.startswith(PNG_SIGNATURE)
    problem = one_of(
        [
            (~F.lower("image_type").isin(*IMAGE_TYPES), "type not allowed"),
            (~F.coalesce(known, F.lit(False)), "not a JPEG or PNG file"),
            ((F.col("width") < MIN_SIDE) | (F.col("height") < MIN_SIDE), "too small"),
        ]
    )
    longest = F.greatest("width", "height")
    scale = F.lit(float(MAX_SIDE)) / longest

    def resized(side: str) -> Column:
        return F.when(longest > MAX_SIDE, (F.col(side) * scale).cast("bigint")).otherwise(F.col(side).cast("bigint"))

    return media.withColumns({"problem": problem, "new_width": resized("width"), "new_height": resized("height")})


_CRITERIA = "ARRAY<STRUCT<name: STRING, type: STRING, weight: STRING, hint: STRING, depends_on: STRING>>"


def parse_criteria(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `criteria`, an array of typed structs, and `reject` with the reason why a request is refused."""
    shape = F.schema_of_variant(F.try_parse_json(raw))
    items = F.from_json(raw, _CRITERIA)
    typed = F.transform(
        items,
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(c["type"], F.lit("llm")).alias("type"),
            F.coalesce(c["weight"], F.lit("1.0")).try_cast("double").alias("weight"),
            F.coalesce(c["hint"], F.lit("auto")).alias("hint"),
            c["depends_on"].alias("depends_on"),
        ),
    )

    def any_item(test) -> Column:
        return F.exists(typed, test)

    reject = one_of(
        [
            (F.try_parse_json(raw).isNull(), "not JSON"),
            (~shape.startswith("ARRAY"), "not a list"),
            (F.exists(items, lambda c: c.isNull()) | any_item(lambda c: c["name"].isNull()), "name missing"),
            (any_item(lambda c: ~c["type"].isin("cv", "llm")), "unknown type"),
            (any_item(lambda c: c["weight"].isNull() | (c["weight"] <= 0)), "weight must be positive"),
            (any_item(lambda c: ~c["hint"].isin("quality", "presence", "auto")), "unknown hint"),
        ]
    )
    return requests.withColumn("reject", reject).withColumn("criteria", F.when(F.col("reject").isNull(), typed)).drop(raw)


def best_match(cutoff: float, names: Sequence[str]):
    """Pandas UDF: the most similar of `names` (Ratcliff-Obershelp), null below the cutoff."""
    known = list(names)

    def closest(texts: pd.Series) -> pd.Series:
        found = {}
        for text in texts.dropna().unique():
            found[text] = next(iter(difflib.get_close_matches(text, known, n=1, cutoff=cutoff)), None)
        return map_texts(texts, found.get)

    return F.pandas_udf(closest, T.StringType())


def detector_names() -> dict[str, str]:
    return {alias: kind for kind, aliases in DETECTORS.items() for alias in aliases}


def route_criteria(criteria: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds `detector` for cv criteria with a registered or similar name; all others go to the model."""
    registry = detector_names()
    name = F.lower(strip(F.col("name")))
    exact = F.try_element_at(mapping(registry), name)
    is_cv = F.col("type") == "cv"
    detector = exact
    if fuzzy:
        similar = best_match(FUZZY_CUTOFF, list(registry))(F.when(is_cv & exact.isNull(), name))
        detector = F.coalesce(exact, F.try_element_at(mapping(registry), similar))
    routed = criteria.withColumn("detector", F.when(is_cv, detector))
    return routed.withColumn("route", F.when(F.col("detector").isNotNull(), "detector").otherwise("model"))


def _whole(value: Column) -> Column:
    return value.cast("int")


def _coverage(kind: str, ratio: Column) -> Column:
    high, low, step, low_step, base, slope, top, conf_low, conf_fail = BANDS[kind]

    def result(score: Column, word: str, confidence: Column) -> Column:
        return F.struct(score.alias("score"), F.lit(word).alias("verdict"), confidence.alias("confidence"))

    return one_of(
        [
            (ratio > high, result(F.least(F.lit(10), _whole(7 + (ratio - high) / step)), "PASS", F.least(F.lit(top), _whole(base + ratio * slope)))),
            (ratio >= low, result(_whole(4 + (ratio - low) / low_step), "MARGINAL", F.lit(conf_low))),
        ],
        result(F.greatest(F.lit(1), _whole(ratio / low * 3)), "FAIL", F.lit(conf_fail)),
    )


def _plain(score: Column, good: Column) -> Column:
    return F.struct(score.alias("score"), F.when(good, "PASS").otherwise("FAIL").alias("verdict"), F.lit(100).alias("confidence"))


def default_measures() -> dict[str, Column]:
    """Expression of every detector kind over `measure` (and `measure_low` for faces)."""
    m = F.col("measure")
    in_range = (m >= DARK_LIMIT) & (m <= BRIGHT_LIMIT)
    exposure = F.when(in_range, _whole(1 + 9 * (m - DARK_LIMIT) / (BRIGHT_LIMIT - DARK_LIMIT))).otherwise(2)
    sharpness = F.least(F.lit(10), _whole(10 * F.least(m / (BLUR_LIMIT * 3), F.lit(1.0))))
    kinds = {"sharpness": _plain(sharpness, m >= BLUR_LIMIT), "exposure": _plain(exposure, in_range)}
    kinds.update({kind: _coverage(kind, m) for kind in BANDS})
    kinds["faces"] = face_score(m, F.col("measure_low"))
    return kinds


def face_score(confident: Column, possible: Column) -> Column:
    """Score of a face count: sure faces, else possible ones, else none."""
    def result(score: int, word: str, confidence: int) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(word).alias("verdict"), F.lit(confidence).alias("confidence"))

    return one_of([(confident >= 1, result(10, "PASS", 85)), (possible >= 1, result(5, "MARGINAL", 55))], result(1, "FAIL", 80))


class MeasureRegistry:
    """Detector kinds by name: each is a Column expression giving `score, verdict, confidence`."""

    def __init__(self) -> None:
        self.kinds = default_measures()
        self.aliases = dict(detector_names())

    def register(self, kind: str, aliases: Sequence[str], expression: Column) -> None:
        self.kinds[kind] = expression
        self.aliases.update({a.strip().lower(): kind for a in aliases})

    def score(self, measures: DataFrame) -> DataFrame:
        """Every measure with `score, verdict, confidence`; null for kinds that nobody registered."""
        low = measures if "measure_low" in measures.columns else measures.withColumn("measure_low", F.lit(None).cast("double"))
        rules = [(F.col("kind") == kind, expression) for kind, expression in self.kinds.items()]
        return low.withColumn("_s", one_of(rules)).select(*measures.columns, "_s.*")


def score_measure(measures: DataFrame) -> DataFrame:
    return MeasureRegistry().score(measures)


def repair_key(key: Column, names: Sequence[str]) -> Column:
    """Requested name behind a returned key: exact, then ignoring case and outer blanks, then the most similar,
    else the key itself. Only keys still open after the first two steps leave the JVM."""
    exact = F.when(key.isin(*names), key)
    first_by_low = {n.lower().strip(): n for n in reversed(names)}
    ignoring_case = F.try_element_at(mapping(first_by_low), F.lower(strip(key)))
    sure = F.coalesce(exact, ignoring_case)
    similar = best_match(FUZZY_CUTOFF, names)(F.when(sure.isNull(), key))
    return F.coalesce(sure, similar, key)


def clamp_score(raw: Column) -> Column:
    """Whole score 1 to 10; what is no whole number counts as 5. Numbers are cut, texts must be whole."""
    return clamp(F.coalesce(raw.try_cast("bigint"), F.lit(5)), 1, 10).cast("int")


def clamp_confidence(raw: Column) -> Column:
    return clamp(F.coalesce(raw.try_cast("bigint"), F.lit(50)), 0, 100).cast("int")


def clean_scores(raw: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """Raw model rows `item_id, crit_no, returned_key, raw_score, raw_confidence` to clamped scores.

    Of two returned keys repaired to the same name the later one stays.
    """
    rows = raw.select(
        "item_id",
        repair_key(F.col("returned_key"), [c.name for c in criteria]).alias("criterion"),
        "crit_no",
        clamp_score(F.col("raw_score")).alias("score"),
        clamp_confidence(F.col("raw_confidence")).alias("confidence"),
    )
    kept = last_per_key(rows, ["item_id", "criterion"], ["crit_no"], ["score", "confidence"])
    return kept.withColumn("verdict", verdict(F.col("score")))


def ancestors(criteria: Sequence[Criterion]) -> dict[str, list[str]]:
    """All criteria each one depends on, directly or through others; a cycle ends where it began."""
    parent = {c.name: c.depends_on for c in criteria if c.depends_on}
    chains: dict[str, list[str]] = {}
    for name in parent:
        chain, step = [], parent.get(name)
        while step and step not in chain:
            chain.append(step)
            step = parent.get(step)
        chains[name] = chain
    return chains


def skip_dependents(scores: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """SKIPPED and no score wherever any criterion up the chain did not pass; a missing one did not pass.

    Takes one row per item and criterion. The requested criteria of an item meet in one group, which is never
    longer than the request; every other key of the item forms a group of its own, so an item with very many
    keys stays spread out.
    """
    chains = ancestors(criteria)
    if not chains:
        return scores
    involved = sorted({c.name for c in criteria} | {a for chain in chains.values() for a in chain})
    others = [c for c in scores.columns if c != "item_id"]
    alone = F.when(F.col("criterion").isin(*involved), "").otherwise(F.col("criterion"))
    groups = scores.groupBy("item_id", alone.alias("_alone")).agg(F.collect_list(F.struct(*others)).alias("_rows"))
    required = F.create_map(*[x for k, v in chains.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    passed = F.transform(F.filter("_rows", lambda r: r["verdict"] == "PASS"), lambda r: r["criterion"])
    rows = groups.withColumn("_passed", passed).select("item_id", "_passed", F.inline("_rows"))
    open_chain = F.array_except(F.try_element_at(required, F.col("criterion")), F.col("_passed"))
    skip = F.coalesce(F.size(open_chain) > 0, F.lit(False)) & F.col("criterion").isin(*chains)
    rows = rows.withColumn("_skip", skip)
    changed = {c: F.when(~F.col("_skip"), F.col(c)) for c in ("score", "confidence")}
    changed["verdict"] = F.when(F.col("_skip"), "SKIPPED").otherwise(F.col("verdict"))
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in scores.columns])


def weighted_parts(scores: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """Requested, not skipped criteria of every item with weight and contribution."""
    weight = F.try_element_at(mapping({c.name: float(c.weight) for c in criteria}), F.col("criterion"))
    used = scores.withColumn("weight", weight).where(F.col("weight").isNotNull() & (F.col("verdict") != "SKIPPED"))
    return used.withColumn("contribution", round_binary(F.col("score") * F.col("weight"), 4))


def weighted_score(scores: DataFrame, criteria: Sequence[Criterion], prior: DataFrame | None = None) -> DataFrame:
    """Weighted mean per item, rounded half to even and kept within 1 to 10, with the part of every criterion.

    `prior` has `item_id, overall_score, overall_verdict` of all items: those without a matched criterion keep these
    and have no breakdown. Without it they have no row. The breakdown is never longer than the list of criteria.
    """
    return _weighted_means(weighted_parts(scores, criteria), ["item_id"], prior)


def _weighted_means(parts: DataFrame, keys: list[str], prior: DataFrame | None) -> DataFrame:
    breakdown = F.sort_array(F.collect_list(F.struct("criterion", "score", "weight", "contribution")))
    sums = parts.groupBy(*keys).agg(
        F.sum(F.col("score") * F.col("weight")).alias("_sum"), F.sum("weight").alias("_weight"), breakdown.alias("per_criterion")
    )
    mean = F.col("_sum") / F.col("_weight")
    final = clamp(round_binary(mean, 0), 1.0, 10.0).cast("int")
    weighted = sums.where(F.col("_weight") != 0).select(
        *keys,
        final.alias("overall_score"),
        verdict(final).alias("overall_verdict"),
        round_binary(F.col("_weight"), 4).alias("total_weight"),
        round_binary(F.col("_sum"), 4).alias("weighted_sum"),
        round_binary(mean, 4).alias("unrounded_average"),
        "per_criterion",
    )
    if prior is None:
        return weighted
    kept = prior.select(*keys, F.col("overall_score").alias("_score"), F.col("overall_verdict").alias("_verdict"))
    joined = kept.join(weighted, keys, "left")
    unchanged = {"overall_score": F.coalesce("overall_score", "_score"), "overall_verdict": F.coalesce("overall_verdict", "_verdict")}
    return joined.withColumns(unchanged).drop("_score", "_verdict")


@lru_cache(maxsize=100_000)
def _closest(key: str, names: tuple[str, ...], cutoff: float) -> str | None:
    return next(iter(difflib.get_close_matches(key, names, n=1, cutoff=cutoff)), None)


def closest_names(cutoff: float):
    """Pandas UDF over (key, names of its own request): the most similar name, null below the cutoff."""

    def closest(keys: pd.Series, lists: pd.Series) -> pd.Series:
        out = [None if names is None or not isinstance(key, str) else _closest(key, tuple(names), cutoff) for key, names in zip(keys, lists, strict=True)]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(closest, T.StringType())


def long_enough(names: Column, key: Column, cutoff: float) -> Column:
    """Those of `names` whose length alone does not keep them below the cutoff: a ratio is at most twice the shorter length over both."""
    both = lambda n: F.length(n) + F.length(key)
    return F.filter(names, lambda n: (both(n) == 0) | (2.0 * F.least(F.length(n), F.length(key)) / both(n) >= cutoff))


def _of_criterion(criteria: Column, name: Column, field: str) -> Column:
    """Field of the last criterion of that name in a request's array."""
    return F.try_element_at(F.filter(criteria, lambda c: c["name"] == name), F.lit(-1))[field]


def clean_request_scores(raw: DataFrame, criteria: DataFrame, key: str = "request_id") -> DataFrame:
    """As `clean_scores`, with every item's own list: `criteria` has one row `key, criteria` per request (`parse_criteria`).

    `raw` has `key` besides the columns of raw scores. The list travels with the rows of its items; rows of a request
    without a list are kept under the keys they came with. Only keys that some name is long enough for leave the JVM.
    """
    plain = lambda n: F.lower(strip(n))
    # names are made plain once per request and keys once per row, not for every pair of them
    names = F.transform("criteria", lambda c: c["name"])
    lists = criteria.select(key, names.alias("_names"), F.transform(names, plain).alias("_plain"))
    returned = F.col("returned_key")
    rows = raw.join(beside(lists), key, "left")
    exact = F.when(F.array_contains("_names", returned), returned)
    place = F.nullif(F.array_position("_plain", plain(returned)), F.lit(0).cast("long"))
    ignoring_case = F.try_element_at("_names", place.cast("int"))
    rows = rows.withColumn("_sure", F.coalesce(exact, ignoring_case))
    open_ = F.col("_sure").isNull() & F.col("_names").isNotNull()
    rows = rows.withColumn("_near", F.when(open_, long_enough(F.col("_names"), returned, FUZZY_CUTOFF)))
    asked = F.size("_near") > 0
    similar = closest_names(FUZZY_CUTOFF)(F.when(asked, returned), F.when(asked, F.col("_near")))
    cleaned = rows.select(
        key, "item_id", F.coalesce("_sure", similar, returned).alias("criterion"), "crit_no",
        clamp_score(F.col("raw_score")).alias("score"), clamp_confidence(F.col("raw_confidence")).alias("confidence"),
    )
    kept = last_per_key(cleaned, [key, "item_id", "criterion"], ["crit_no"], ["score", "confidence"])
    return kept.withColumn("verdict", verdict(F.col("score")))


def request_chains(criteria: Column) -> Column:
    """For every criterion of a request's array its `name` and `chain`, all it depends on; a cycle ends where it began."""
    none = F.lit(None).cast("string")

    def parent(name: Column) -> Column:
        return F.nullif(_of_criterion(criteria, name, "depends_on"), F.lit(""))

    def ended(state: Column) -> Column:
        return state["step"].isNull() | F.array_contains(state["chain"], state["step"])

    def climb(state: Column, _: Column) -> Column:
        further = F.struct(F.array_append(state["chain"], state["step"]).alias("chain"), parent(state["step"]).alias("step"))
        return F.when(ended(state), F.struct(state["chain"].alias("chain"), none.alias("step"))).otherwise(further)

    def whole(state: Column) -> Column:
        return F.when(ended(state), state["chain"]).otherwise(F.array_append(state["chain"], state["step"]))

    def chain(name: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("chain"), parent(name).alias("step"))
        return F.aggregate(criteria, start, climb, whole)

    return F.transform(criteria, lambda c: F.struct(c["name"].alias("name"), c["depends_on"].alias("depends_on"), chain(c["name"]).alias("chain")))


def skip_request_dependents(scores: DataFrame, criteria: DataFrame, key: str = "request_id") -> DataFrame:
    """As `skip_dependents`, with every item's own list of criteria; chains are climbed once per request, cycles end where they began."""
    lists = criteria.select(key, request_chains(F.col("criteria")).alias("_chains"))
    rows = scores.join(beside(lists), key, "left")
    listed = F.coalesce(F.exists("_chains", lambda c: (c["name"] == F.col("criterion")) | (c["depends_on"] == F.col("criterion"))), F.lit(False))
    others = [c for c in scores.columns if c not in (key, "item_id")]
    alone = F.when(listed, "").otherwise(F.col("criterion"))
    groups = rows.groupBy(key, "item_id", alone.alias("_alone")).agg(F.collect_list(F.struct(*others)).alias("_rows"))
    passed = F.transform(F.filter("_rows", lambda r: r["verdict"] == "PASS"), lambda r: r["criterion"])
    unfolded = groups.withColumn("_passed", passed).select(key, "item_id", "_passed", F.inline("_rows")).join(beside(lists), key, "left")
    chain = _of_criterion(F.col("_chains"), F.col("criterion"), "chain")
    skip = F.coalesce(F.size(F.array_except(chain, F.col("_passed"))) > 0, F.lit(False))
    flagged = unfolded.withColumn("_skip", skip)
    changed = {c: F.when(~F.col("_skip"), F.col(c)) for c in ("score", "confidence")}
    changed["verdict"] = F.when(F.col("_skip"), "SKIPPED").otherwise(F.col("verdict"))
    return flagged.select(*[changed.get(c, F.col(c)).alias(c) for c in scores.columns])


def weighted_request_score(scores: DataFrame, criteria: DataFrame, key: str = "request_id", prior: DataFrame | None = None) -> DataFrame:
    """As `weighted_score` per request and item, over the item's own list. `prior` has `key` besides its other columns."""
    rows = scores.join(beside(criteria.select(key, F.col("criteria").alias("_criteria"))), key)
    weight = _of_criterion(F.col("_criteria"), F.col("criterion"), "weight")
    used = rows.withColumn("weight", weight).where(F.col("weight").isNotNull() & (F.col("verdict") != "SKIPPED"))
    parts = used.withColumn("contribution", round_binary(F.col("score") * F.col("weight"), 4))
    return _weighted_means(parts, [key, "item_id"], prior)


def detector_overall(scored: DataFrame) -> DataFrame:
    """Overall verdict of the detector rows by number of failures, and their mean score."""
    scored = scored.where(F.col("score").isNotNull())
    fails = F.count_if(F.col("verdict") == "FAIL")
    overall = one_of([(fails >= 2, "FAIL"), (fails == 1, "MARGINAL")], "PASS")
    mean = F.coalesce(round_binary(F.avg("score"), 0).cast("int"), F.lit(5))
    return scored.groupBy("item_id").agg(overall.alias("overall_verdict"), mean.alias("overall_score"))


def merge_methods(detected: DataFrame, modelled: DataFrame) -> DataFrame:
    """Rows of both methods; where both scored a criterion the model's row stays.

    Rows are spread by their key before they are sorted for the pick: sorted where they are read, one input file of measures would be one sort.
    """
    columns = ("item_id", "criterion", "score", "confidence", "verdict")
    both = detected.where(F.col("score").isNotNull()).select(*columns, F.lit("detector").alias("method"), F.lit(1).alias("_rank")).unionByName(
        modelled.select(*columns, F.lit("model").alias("method"), F.lit(0).alias("_rank"))
    )
    spread = both.repartition("item_id", "criterion")
    return first_per_key(spread, ["item_id", "criterion"], ["_rank"], ["score", "confidence", "verdict", "method"])


def _score_map() -> Column:
    """Aggregate of the scored criteria of a group as a map; of several scores of a criterion the lowest counts."""
    scored = F.col("criterion").isNotNull() & F.col("score").isNotNull()
    entries = F.sort_array(F.collect_list(F.when(scored, F.struct("criterion", "score"))))
    before = F.concat(F.array(F.lit(None)), entries)
    firsts = F.zip_with(entries, before, lambda e, b: F.when(~e["criterion"].eqNullSafe(b["criterion"]), e))
    return F.map_from_entries(F.array_compact(firsts))


def similarity(pairs: DataFrame, scores: DataFrame, example_scores: DataFrame) -> DataFrame:
    """Similarity of items to examples over their common criteria, with the part of each; neutral where they share none.

    `pairs` has `item_id, example_id`; scores are `item_id, criterion, score` and `example_id, criterion, score`. Of several
    scores of a criterion the lowest counts; rows without criterion or score take no part.
    """
    mine = scores.groupBy("item_id").agg(_score_map().alias("_mine"))
    theirs = example_scores.groupBy("example_id").agg(_score_map().alias("_theirs"))
    # one row per item and per example: a pair is compared inside its row, without a shuffle of criteria
    joined = pairs.join(mine, "item_id", "left").join(theirs, "example_id", "left")
    shared = F.array_sort(F.array_intersect(F.map_keys("_mine"), F.map_keys("_theirs")))

    def compare(name: Column) -> Column:
        ours, example = F.col("_mine")[name], F.col("_theirs")[name]
        alike = round_binary(1.0 - F.abs(example - ours) / 9.0, 3)
        return F.struct(name.alias("criterion"), example.alias("example_score"), ours.alias("input_score"), alike.alias("similarity"))

    rows = joined.withColumn("per_criterion", F.coalesce(F.transform(shared, compare), F.array()))
    rows = rows.withColumn("common", F.size("per_criterion").cast("bigint"))
    # thousandths are whole, so their order cannot change the mean
    thousandths = F.aggregate("per_criterion", F.lit(0).cast("bigint"), lambda s, c: s + F.round(c["similarity"] * 1000).cast("bigint"))
    mean = F.when(F.col("common") > 0, thousandths / F.lit(1000.0) / F.col("common"))
    return rows.withColumn("_mean", mean).select(
        *pairs.columns,
        "common",
        F.coalesce(round_binary(F.col("_mean"), 3), F.lit(0.5)).alias("overall_similarity"),
        F.coalesce(round_binary(F.col("_mean") * 10, 1), F.lit(5.0)).alias("similarity_score"),
        "per_criterion",
    )


def blend(compared: DataFrame) -> DataFrame:
    """Own quality and similarity mixed by the example's weight, kept within 1 to 10."""
    mixed = (1.0 - F.col("weight")) * F.col("overall_score") + F.col("weight") * F.col("similarity_score")
    score = round_binary(clamp(mixed, 1.0, 10.0), 1)
    return compared.withColumn("blended", score).withColumn("blended_verdict", verdict(F.col("blended").cast("int")))


def aggregate(blended: DataFrame, method: str = "mean") -> DataFrame:
    """One score per item over its examples by mean, min or max."""
    folds = {"mean": exact_mean(F.col("blended"), 1), "min": F.min("blended"), "max": F.max("blended")}
    rows = blended.groupBy("item_id").agg(round_binary(folds[method], 1).alias("score"), F.count("*").alias("examples"))
    return rows.withColumn("verdict", verdict(F.col("score").cast("int")))


def work_list(examples: DataFrame) -> DataFrame:
    """Examples that still have to be scored, each once."""
    return examples.where(~F.col("has_prior")).select("example_id").distinct()


def reuse_prior(examples: DataFrame, prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Analysis of every example: the prior one where there is one, else the fresh one."""
    known = prior.select("example_id", F.col("overall_score").alias("_prior"))
    new = fresh.select("example_id", F.col("overall_score").alias("_fresh"))
    joined = examples.select("example_id", "has_prior").distinct().join(known, "example_id", "left").join(new, "example_id", "left")
    score = F.when(F.col("has_prior"), F.col("_prior")).otherwise(F.col("_fresh"))
    return joined.select("example_id", "has_prior", score.alias("overall_score"))


# Section texts of the prompt, by hint and in the order of the sections.
SECTIONS = {
    "quality": "Quality criteria, scored 1 to 10 (7 and more pass, 4 to 6 marginal)",
    "presence": "Presence criteria, 10 present, 5 unsure, 1 absent, with the evidence seen",
    "auto": "Other criteria, quality or presence as the name suggests",
}


def assemble_prompts(requests: DataFrame, sections: dict[str, str] = SECTIONS) -> DataFrame:
    """Prompt text, key list and count per request, from its array of criteria, without a shuffle."""

    def block(hint: str, heading: str) -> Column:
        names = F.transform(F.filter("criteria", lambda c: c["hint"] == hint), lambda c: F.concat(F.lit("  - "), c["name"]))
        return F.when(F.size(names) > 0, F.concat(F.lit(heading + ":\n"), F.array_join(names, "\n")))

    blocks = [block(hint, heading) for hint, heading in sections.items()]
    keys = F.array_join(F.transform("criteria", lambda c: F.concat(F.lit('"'), c["name"], F.lit('"'))), ", ")
    ready = requests.where(F.size("criteria") > 0)
    return ready.select(
        *[c for c in requests.columns if c not in ("criteria", "reject")],
        F.concat_ws("\n\n", *blocks).alias("prompt"),
        keys.alias("key_list"),
        F.size("criteria").alias("n_keys"),
        scaffold(F.col("criteria")).alias("scaffold"),
    )


def scaffold(criteria: Column) -> Column:
    """Empty answer with one entry per criterion, as JSON."""
    blank = F.struct(F.lit(0).alias("score"), F.lit("...").alias("verdict"), F.lit(0).alias("confidence"), F.lit("...").alias("reason"))
    names = F.array_distinct(F.transform(criteria, lambda c: c["name"]))
    entries = F.map_from_arrays(names, F.transform(names, lambda _: blank))
    answer = F.struct(
        F.lit("...").alias("overall_verdict"), F.lit(0).alias("overall_score"), entries.alias("per_criterion_scores")
    )
    return F.to_json(F.struct(answer.alias("assessment")))


def recover_json(reply: Column) -> Column:
    """JSON text of a reply: the reply itself, else its widest braces; null unless it holds an assessment."""
    span = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    text = one_of([(F.try_parse_json(reply).isNotNull(), reply), (F.try_parse_json(span).isNotNull(), span)])
    has_key = F.try_variant_get(F.try_parse_json(text), "$.assessment", "variant").isNotNull()
    return F.when(has_key, text)


def attempt_outcome(replies: DataFrame, max_attempts: int = 3) -> DataFrame:
    """First good attempt per item. A transport error ends the item; parse errors run on to the last attempt,
    after which the item fails with score 1. `transport_error` is optional."""
    error = F.col("transport_error") if "transport_error" in replies.columns else F.lit(False)
    rows = replies.where(F.col("attempt") <= max_attempts).withColumns({"json": recover_json(F.col("reply")), "_broken": error})
    decided = rows.where(F.col("_broken") | F.col("json").isNotNull())
    first = first_per_key(decided, ["item_id"], ["attempt"], ["attempt", "json", "_broken"])
    everyone = rows.groupBy("item_id").agg(F.max("attempt").alias("tried"))
    joined = everyone.join(first, "item_id", "left")
    outcome = one_of([(F.col("_broken"), "transport error"), (F.col("json").isNotNull(), "ok")], "failed")
    score = F.try_variant_get(F.try_parse_json("json"), "$.assessment.overall_score", "bigint")
    return joined.select(
        "item_id",
        outcome.alias("outcome"),
        F.coalesce("attempt", "tried").alias("attempts"),
        F.when(outcome == "ok", clamp_score(score)).when(outcome == "failed", 1).alias("score"),
    )


def group_aliases(groups: DataFrame, members: DataFrame, code: str = "code") -> DataFrame:
    """Members of every group as long rows; groups without members stay with a null member."""
    return groups.join(members.select(code, "member").distinct(), code, "left").orderBy(code, "member")


# Fixed value: the form of language tokens in a vocabulary.
LANGUAGE_TOKEN = r"^<2([a-z]{2,3}(?:_[A-Za-z]+)?)>$"


def tag_codes(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    code = F.nullif(F.regexp_extract(token, LANGUAGE_TOKEN, 1), F.lit(""))
    return vocabulary.select(code.alias("code")).where(F.col("code").isNotNull()).distinct().orderBy("code")


def check_targets(requests: DataFrame, codes: DataFrame, target: str = "target") -> DataFrame:
    known = codes.select(F.col("code").alias(target), F.lit(True).alias("_known"))
    return requests.join(known, target, "left").withColumn("supported", F.coalesce("_known", F.lit(False))).drop("_known")
