"""Capture routing and assessment scoring against small brute-force references."""

from __future__ import annotations

import difflib
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from opslens.functions.columns import round_binary
from opslens.functions.extend import ParserRegistry, score_batch, score_resumed
from opslens.operators import assess as a
from opslens.operators import captures as c
from opslens.sources.docs import read_docs

CAPTURE = "session_id BIGINT, arrival BIGINT, path STRING, seq BIGINT, is_load BOOLEAN, url STRING, body STRING"


@pytest.fixture(scope="module")
def captured():
    rnd = random.Random(3)
    return [
        (0 if rnd.random() < 0.4 else rnd.randint(1, 4), n, rnd.choice(["push", "poll"]), rnd.choice([None, *range(8)]), rnd.random() < 0.1, f"u/{n % 9}", rnd.choice(["{}", "{}", None]))
        for n in range(600)
    ]


@pytest.mark.parametrize("hot_rows", [0, 100, 1000])
def test_dedup_against_a_loop(spark, captured, hot_rows):
    gens, seen, want = {}, set(), []
    for session, arrival, _, seq, is_load, _, body in captured:
        gens[session] = gens.get(session, 0) + is_load
        key = (session, gens[session], seq)
        if body is None or (seq is not None and key in seen):
            continue
        seen.add(key)
        want.append((*key, arrival))
    df = spark.createDataFrame(captured, CAPTURE).repartition(4)
    got = [(r.session_id, r.gen, r.seq, r.arrival) for r in c.dedup_captures(df, hot_rows).collect()]
    assert sorted(got, key=lambda r: r[3]) == sorted(want, key=lambda r: r[3])


def test_full_bucket_drops_instead_of_passing_on(spark):
    rows = [(1, n, "push", n, False, "/a/b", "{}") for n in range(4)] + [(1, 9, "push", 9, False, "/b", "{}")]
    bucketed = c.bucket_first_match(spark.createDataFrame(rows, CAPTURE), ["/a/", "/b"])
    got = sorted((r.pattern, r.arrival) for r in c.cap_per_bucket(bucketed, 2).collect())
    assert got == [("/a/", 0), ("/a/", 1), ("/b", 9)]


def test_find_shapes_nested(spark):
    hit = {"id": 1, "name": None, "sub": [{"id": 2, "name": "x"}, {"id": 3}]}
    rows = [(1, json.dumps({"w": [hit]})), (2, "nope"), (3, None), (4, json.dumps([[{"id": 5, "name": 6}]]))]
    shapes = c.find_shapes(spark.createDataFrame(rows, "k BIGINT, body STRING"), "body", ("id", "name"))
    got = sorted((r.k, r.ord, r.depth, json.loads(r.object)["id"]) for r in shapes.collect())
    assert got == [(1, 0, 2, 1), (1, 1, 4, 2), (4, 0, 2, 5)]


def test_deep_json(spark):
    deep = '{"a":' * 300 + '{"id":1,"name":2}' + "}" * 300
    shapes = c.find_shapes(spark.createDataFrame([(1, deep)], "k BIGINT, body STRING"), "body", ("id", "name"))
    assert [r.depth for r in shapes.collect()] == [300]


def test_init_body(spark):
    order = json.dumps([{"type": "user"}, {"type": "t"}])
    rows = [(1, 1, order), (1, 2, order), (1, 3, "[]"), (1, 4, None), (2, 1, "[]"), (2, 2, '{"type":"t"}'), (3, 1, None)]
    got = {r.project_id: (r.arrival, r.bodies) for r in c.pick_init_body(spark.createDataFrame(rows, "project_id BIGINT, arrival INT, body STRING"), "t").collect()}
    assert got == {1: (2, 3), 2: (2, 2)}


def test_read_docs(spark):
    body = json.dumps({"docs": [{"_id": "1", "_type": "t", "_source": {"x": [1]}}, {"_id": "2"}]})
    rows = [("/mget", body), ("/other", body), ("/mget", "[]"), ("/mget", "bad")]
    docs = read_docs(spark.createDataFrame(rows, "url STRING, body STRING"), "/mget").collect()
    assert [(r.pos, r.doc_id, r.type, r.payload) for r in docs] == [(0, "1", "t", '{"x":[1]}'), (1, "2", None, None)]


def test_login_wall(spark):
    rows = [("waiting_login", None, None), ("done", "Please LOGIN", None), (None, None, True), (None, "other", False), ("done", None, None)]
    df = spark.createDataFrame(rows, "s STRING, e STRING, f BOOLEAN")
    assert [r.w for r in df.select(c.login_wall(F.col("s"), F.col("e"), F.col("f")).alias("w")).collect()] == [True, True, True, False, False]


def test_fuzzy_repair(spark):
    names = ["shelf labelled", "Image Sharpness", "aisle free", "image sharpness"]
    keys = ["shelves labelled", "shelf_labelled", "IMAGE sharpness ", "image sharpness", "aisle fre", "zzz", "", None]

    def want(key):
        if key is None or key in names:
            return key
        low = next((n for n in names if n.lower().strip() == key.lower().strip()), None)
        return low or next(iter(difflib.get_close_matches(key, names, n=1, cutoff=0.6)), key)

    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    assert [r.n for r in df.select(a.repair_key(F.col("k"), names).alias("n")).collect()] == [want(k) for k in keys]


def test_fuzzy_route(spark):
    rows = [("Has  sky", "cv"), ("has tree", "cv"), ("has tree", "llm"), ("quantum", "cv"), (" HAS POOL ", "cv")]
    got = [(r.detector, r.route) for r in a.route_criteria(spark.createDataFrame(rows, "name STRING, type STRING")).collect()]
    assert got == [("sky", "detector"), ("vegetation", "detector"), (None, "model"), (None, "model"), ("water", "detector")]


def test_clamp(spark):
    df = spark.createDataFrame([("7",), ("-1",), ("12",), ("3.7",), ("n/a",), (None,), (" 8 ",)], "s STRING")
    assert [r.x for r in df.select(a.clamp_score(F.col("s")).alias("x")).collect()] == [7, 1, 10, 5, 5, 5, 8]


def loop_skips(verdicts, parents):
    """Repeat until nothing changes: the plain reading of the rule."""
    verdicts = dict(verdicts)
    changed = True
    while changed:
        changed = False
        for name, parent in parents.items():
            if name in verdicts and verdicts[name] != "SKIPPED" and verdicts.get(parent, "FAIL") != "PASS":
                verdicts[name], changed = "SKIPPED", True
    return verdicts


def test_skip_chains_and_cycles(spark):
    rnd = random.Random(11)
    parents = {"b": "a", "c": "b", "d": "c", "x": "y", "y": "x", "s": "s", "m": "gone"}
    criteria = [a.Criterion(n, depends_on=parents.get(n)) for n in ("a", "b", "c", "d", "x", "y", "s", "m", "free")]
    items = {n: {c.name: rnd.choice(["PASS", "PASS", "PASS", "FAIL", "MARGINAL"]) for c in criteria if rnd.random() < 0.9} for n in range(80)}
    for n in range(0, 80, 5):
        items[n].update({"gone": "PASS", "extra": "FAIL"})
    rows = [(n, k, 8, 50, v) for n, item in items.items() for k, v in item.items()]
    df = spark.createDataFrame(rows, "item_id BIGINT, criterion STRING, score INT, confidence INT, verdict STRING")
    got: dict = {}
    for r in a.skip_dependents(df, criteria).collect():
        got.setdefault(r.item_id, {})[r.criterion] = r.verdict
        assert (r.score is None) == (r.verdict == "SKIPPED")
    assert got == {n: loop_skips(v, parents) for n, v in items.items() if v}


def test_later_key_wins(spark):
    rows = [(1, 1, "Door Shut", "3", 10), (1, 2, "door shut", "9", None)]
    df = spark.createDataFrame(rows, "item_id BIGINT, crit_no INT, returned_key STRING, raw_score STRING, raw_confidence BIGINT")
    got = a.clean_scores(df, [a.Criterion("door shut")]).collect()
    assert [(r.criterion, r.score, r.confidence, r.verdict) for r in got] == [("door shut", 9, 50, "PASS")]


def test_weighted_rounding(spark):
    rows = [(1, "a", 6), (1, "b", 7), (2, "a", 5), (2, "b", 6), (3, "zzz", 9)]
    df = spark.createDataFrame([(*r, 1, "PASS") for r in rows], "item_id BIGINT, criterion STRING, score INT, confidence INT, verdict STRING")
    got = {r.item_id: (r.overall_score, r.unrounded_average) for r in a.weighted_score(df, [a.Criterion("a"), a.Criterion("b")]).collect()}
    assert got == {1: (6, 6.5), 2: (6, 5.5)}
    prior = spark.createDataFrame([(1, 2, "FAIL"), (3, 9, "PASS")], "item_id BIGINT, overall_score INT, overall_verdict STRING")
    kept = {r.item_id: r for r in a.weighted_score(df, [a.Criterion("a"), a.Criterion("b", weight=3.0)], prior).collect()}
    assert set(kept) == {1, 3} and (kept[3].overall_score, kept[3].overall_verdict, kept[3].per_criterion) == (9, "PASS", None)
    assert [tuple(p) for p in kept[1].per_criterion] == [("a", 6, 1.0, 6.0), ("b", 7, 3.0, 21.0)]


def test_request_scores_keep_prior_and_breakdown(spark):
    lists = a.parse_criteria(spark.createDataFrame([(7, '[{"name":"a","weight":1},{"name":"b","weight":3}]'), (8, '[{"name":"c","weight":1}]')], "request_id BIGINT, raw STRING"))
    rows = [(7, 1, "a", 6, "MARGINAL"), (7, 1, "b", 7, "PASS"), (8, 2, "a", 5, "MARGINAL"), (8, 3, "c", None, "SKIPPED"), (9, 4, "a", 3, "FAIL")]
    df = spark.createDataFrame(rows, "request_id BIGINT, item_id BIGINT, criterion STRING, score INT, verdict STRING")
    prior = spark.createDataFrame([(7, 1, 2, "FAIL"), (8, 2, 9, "PASS"), (8, 3, 4, "MARGINAL"), (9, 4, 1, "FAIL")], "request_id BIGINT, item_id BIGINT, overall_score INT, overall_verdict STRING")
    got = {(r.request_id, r.item_id): r for r in a.weighted_request_score(df, lists, prior=prior).collect()}
    assert {k: (r.overall_score, r.overall_verdict) for k, r in got.items()} == {(7, 1): (7, "PASS"), (8, 2): (9, "PASS"), (8, 3): (4, "MARGINAL"), (9, 4): (1, "FAIL")}
    assert [tuple(p) for p in got[7, 1].per_criterion] == [("a", 6, 1.0, 6.0), ("b", 7, 3.0, 21.0)] and got[8, 2].per_criterion is None
    assert {r.item_id for r in a.weighted_request_score(df, lists).collect()} == {1}


def test_rounding_is_the_languages_own(spark):
    rnd = random.Random(5)
    values = [n / 2000 for n in range(0, 21001, 7)] + [rnd.uniform(0, 100) for _ in range(500)] + [2.675, 0.4445, 0.5, 1.5, 6.35, 6.25, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    rows = df.select("x", *[round_binary(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 2, 3, 4)]).collect()
    for r in rows:
        assert [r.r0, r.r1, r.r2, r.r3, r.r4] == [float(round(r.x, n)) for n in (0, 1, 2, 3, 4)], r.x


def test_faces_and_bands(spark):
    df = spark.createDataFrame([(2, 0), (0, 3), (0, 0)], "hi INT, lo INT")
    got = [tuple(r.s) for r in df.select(a.face_score(F.col("hi"), F.col("lo")).alias("s")).collect()]
    assert got == [(10, "PASS", 85), (5, "MARGINAL", 55), (1, "FAIL", 80)]
    rows = [("sky", 0.6), ("sky", 0.61), ("text", 0.03), ("exposure", 29.9), ("exposure", 220.0), ("sharpness", 99.9), ("nope", 1.0)]
    got = [(r.kind, r.score, r.verdict) for r in a.score_measure(spark.createDataFrame(rows, "kind STRING, measure DOUBLE")).collect()]
    assert got == [("sky", 7, "MARGINAL"), ("sky", 7, "PASS"), ("text", 4, "MARGINAL"), ("exposure", 2, "FAIL"), ("exposure", 10, "PASS"), ("sharpness", 3, "FAIL"), ("nope", None, None)]
    faces = spark.createDataFrame([("faces", 2.0, 5.0), ("faces", 0.0, 3.0), ("faces", 0.0, None)], "kind STRING, measure DOUBLE, measure_low DOUBLE")
    assert [(r.score, r.verdict, r.confidence) for r in a.score_measure(faces).collect()] == [(10, "PASS", 85), (5, "MARGINAL", 55), (1, "FAIL", 80)]


def test_similarity_neutral_and_blend(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0)], "item_id BIGINT, example_id BIGINT, weight DOUBLE")
    mine = spark.createDataFrame([(1, "a", 10), (1, "b", 4), (1, "n", None)], "item_id BIGINT, criterion STRING, score INT")
    theirs = spark.createDataFrame([(2, "a", 1), (2, "b", 5), (2, "n", 4), (3, "z", 5)], "example_id BIGINT, criterion STRING, score INT")
    rows = a.similarity(pairs, mine, theirs)
    got = {r.example_id: (r.overall_similarity, r.similarity_score) for r in rows.collect()}
    assert got == {2: (round((0.0 + 0.889) / 2, 3), 4.4), 3: (0.5, 5.0)}
    mixed = a.blend(rows.withColumn("overall_score", F.lit(8)))
    assert {r.example_id: (r.blended, r.blended_verdict) for r in mixed.collect()} == {2: (6.2, "MARGINAL"), 3: (5.0, "MARGINAL")}
    assert [a.aggregate(mixed, how).collect()[0].score for how in ("mean", "min", "max")] == [5.6, 5.0, 6.2]


def test_attempts(spark):
    good = '{"assessment":{"overall_score":4}}'
    rows = [(1, 1, "x", False), (1, 2, good, False), (2, 1, "x", True), (2, 2, good, False), (3, 1, "x", False), (3, 2, "y", False), (3, 3, "{}", False), (3, 4, good, False)]
    df = spark.createDataFrame(rows, "item_id BIGINT, attempt INT, reply STRING, transport_error BOOLEAN")
    got = {r.item_id: (r.outcome, r.attempts, r.score) for r in a.attempt_outcome(df).collect()}
    assert got == {1: ("ok", 2, 4), 2: ("transport error", 1, None), 3: ("failed", 3, 1)}


def test_prompt_scaffold(spark):
    raw = json.dumps([{"name": "p", "hint": "presence"}, {"name": "q", "hint": "quality"}])
    row = a.assemble_prompts(a.parse_criteria(spark.createDataFrame([(1, raw)], "request_id INT, raw STRING"))).collect()[0]
    assert row.prompt.index("- q") < row.prompt.index("- p") and row.key_list == '"p", "q"'
    assert list(json.loads(row.scaffold)["assessment"]["per_criterion_scores"]) == ["p", "q"]


def test_extension_points(spark):
    parsers = ParserRegistry()
    parsers.register("len", lambda url, body: {"n": len(body)} if body else None)
    df = spark.createDataFrame([("u", "abc"), ("u", None), ("u", "")], "url STRING, body STRING")
    assert [(r.parsed, r.parse_error) for r in parsers.apply("len", df).collect()] == [('{"n": 3}', None), (None, None), (None, None)]
    prompts = spark.createDataFrame([(n, "p" * n) for n in range(100)], "item_id BIGINT, prompt STRING")
    replies = score_batch(prompts, lambda texts: [str(len(t) + 0 * len(texts)) for t in texts], batch_size=7, tasks=3)
    assert replies.rdd.getNumPartitions() == 3
    assert {r.item_id: r.reply for r in replies.collect()} == {n: str(n) for n in range(100)}


def test_a_second_run_asks_the_model_only_for_what_is_open(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "item_id LONG, prompt STRING")
    asked = f"{tmp_path}/asked"
    os.mkdir(asked)

    def model(texts, broken):
        for t in texts:
            open(f"{asked}/{t}-{uuid.uuid4().hex}", "w").close()
        if broken and "p7" in texts:
            raise RuntimeError("model down")
        return [t.upper() for t in texts]

    with pytest.raises(Exception, match="model down"):
        score_resumed(prompts, lambda t: model(t, True), f"{tmp_path}/replies", parts=5)
    written = {r.item_id for r in spark.read.parquet(f"{tmp_path}/replies").collect()}
    before = len(os.listdir(asked))
    replies = score_resumed(prompts, lambda t: model(t, False), f"{tmp_path}/replies", parts=5)
    assert sorted((r.item_id, r.reply) for r in replies.collect()) == [(i, f"P{i}") for i in range(40)]
    assert written and len(os.listdir(asked)) - before == 40 - len(written)
    assert score_resumed(prompts, lambda t: 1 / 0, f"{tmp_path}/replies", parts=5).count() == 40


def test_similarity_of_doubled_criteria_takes_the_lowest_score(spark):
    pairs = spark.createDataFrame([(1, 9), (2, 9)], "item_id bigint, example_id bigint")
    scores = spark.createDataFrame([(1, "sky", 8), (1, "sky", 3), (1, "roof", 5), (1, None, 4), (2, "sky", None)], "item_id bigint, criterion string, score int")
    examples = spark.createDataFrame([(9, "sky", 3), (9, "sky", 3), (9, "door", 1)], "example_id bigint, criterion string, score int")
    rows = {r["item_id"]: r for r in a.similarity(pairs, scores, examples).collect()}
    assert [(c["criterion"], c["input_score"], c["similarity"]) for c in rows[1]["per_criterion"]] == [("sky", 3, 1.0)]
    assert (rows[2]["common"], rows[2]["overall_similarity"]) == (0, 0.5)


def test_names_too_short_or_long_for_the_cutoff_are_left_out(spark):
    names = ["", "a", "door shut", "floor dry", "large ring", "x" * 40]
    for key in ("", "zz4", "flor dry", "y" * 25):
        want = [n for n in names if difflib.SequenceMatcher(None, n, key).real_quick_ratio() >= a.FUZZY_CUTOFF]
        kept = spark.range(1).select(a.long_enough(F.array(*map(F.lit, names)), F.lit(key), a.FUZZY_CUTOFF).alias("n")).first().n
        assert kept == want


def test_methods_are_merged_after_the_shuffle_only(spark):
    rows = spark.createDataFrame([(1, "c", 5, 50, "MARGINAL"), (2, "c", 7, 50, "PASS")], "item_id INT, criterion STRING, score INT, confidence INT, verdict STRING")
    plan = a.merge_methods(rows, rows.where("item_id = 1"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("partial_min_by") < plan.index("REPARTITION_BY_COL")
    got = {(r.item_id, r.method) for r in a.merge_methods(rows, rows.where("item_id = 1")).collect()}
    assert got == {(1, "model"), (2, "detector")}


def test_chains_of_a_request(spark):
    lists = [(1, [("a", "b"), ("b", "c"), ("c", "a"), ("d", ""), ("e", "x")])]
    df = spark.createDataFrame(lists, "request_id INT, criteria ARRAY<STRUCT<name: STRING, depends_on: STRING>>")
    got = df.select(a.request_chains(F.col("criteria")).alias("c")).first().c
    assert {r.name: r.chain for r in got} == {"a": ["b", "c", "a"], "b": ["c", "a", "b"], "c": ["a", "b", "c"], "d": [], "e": ["x"]}


def test_lists_of_requests_stay_off_the_driver(spark, tmp_path):
    names = json.dumps([{"name": "a", "weight": 1}, {"name": "b", "weight": 3, "depends_on": "a"}])
    raw = spark.range(3000).select(F.col("id").alias("request_id"), F.lit(names).alias("raw"))
    a.parse_criteria(raw).select("request_id", "criteria").write.parquet(f"{tmp_path}/lists")
    rows = [(n % 3000, n, 1 + n % 2, "AB"[n % 2], "7" if n % 3 else "2", 60) for n in range(6000)]
    kinds = "request_id BIGINT, item_id BIGINT, crit_no INT, returned_key STRING, raw_score STRING, raw_confidence BIGINT"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/rows")
    lists, scores = spark.read.parquet(f"{tmp_path}/lists"), spark.read.parquet(f"{tmp_path}/rows")
    judged = a.skip_request_dependents(a.clean_request_scores(scores, lists), lists)
    got = a.weighted_request_score(judged, lists)
    # both tables are files of a few KB, whose rows may be any number
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    # the score of a; b stands alone in its items, so that its chain is open
    assert {r.item_id: r.overall_score for r in got.collect()} == {n: 7 if n % 3 else 2 for n in range(0, 6000, 2)}
