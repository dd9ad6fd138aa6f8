"""Registered assessment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions.scale import beside
from opslens.operators import assess as a
from opslens.plans.registry import query
from opslens.plans.views import table, view
from opslens.session import materialize

CRITERIA = (
    a.Criterion("aisle free", "llm", 1.5),
    a.Criterion("shelf labelled", "llm", 2.25, depends_on="aisle free"),
    a.Criterion("label legible", "llm", 3.5, depends_on="shelf labelled"),
    a.Criterion("has sky", "cv", 0.5),
    a.Criterion("proper exposure", "cv", 1.25),
    a.Criterion("sharpness", "cv", 0.75),
)
NAMES = [c.name for c in CRITERIA]
S = ("scores",)
CLEAN = """crit AS (SELECT * FROM (VALUES ('aisle free', 1.5::DOUBLE, NULL), ('shelf labelled', 2.25, 'aisle free'), ('label legible', 3.5, 'shelf labelled'), ('has sky', 0.5, NULL), ('proper exposure', 1.25, NULL), ('sharpness', 0.75, NULL)) c(name, weight, depends_on)),
clean AS (SELECT item_id, coalesce(name, returned_key) AS criterion, crit_no, least(greatest(coalesce(CASE WHEN regexp_matches(raw_score, '^-?[0-9]+$') THEN CAST(raw_score AS INTEGER) END, 5), 1), 10) AS score,
 least(greatest(coalesce(raw_confidence, 50), 0), 100) AS confidence FROM scores LEFT JOIN crit ON CASE lower(trim(returned_key)) WHEN 'aisle fre' THEN 'aisle free' WHEN 'has skyy' THEN 'has sky' ELSE lower(trim(returned_key)) END = name),
judged AS (SELECT *, CASE WHEN score >= 7 THEN 'PASS' WHEN score >= 4 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM clean)"""
SKIP = CLEAN + """, up(name, ancestor, depth) AS (SELECT name, depends_on, 1 FROM crit WHERE depends_on IS NOT NULL UNION ALL SELECT u.name, c.depends_on, depth + 1 FROM up u JOIN crit c ON c.name = u.ancestor WHERE c.depends_on IS NOT NULL AND depth < 6),
skips AS (SELECT DISTINCT j.item_id, j.criterion FROM judged j JOIN up ON up.name = j.criterion LEFT JOIN judged d ON d.item_id = j.item_id AND d.criterion = up.ancestor WHERE coalesce(d.verdict, 'FAIL') <> 'PASS'),
final AS (SELECT j.item_id, j.criterion, CASE WHEN s.item_id IS NULL THEN j.score END AS score, CASE WHEN s.item_id IS NULL THEN j.confidence END AS confidence, CASE WHEN s.item_id IS NULL THEN j.verdict ELSE 'SKIPPED' END AS verdict
 FROM judged j LEFT JOIN skips s ON s.item_id = j.item_id AND s.criterion = j.criterion)"""
WEIGHTED = SKIP + """, w AS (SELECT item_id, sum(score * weight) AS ws, sum(weight) AS tw FROM final JOIN crit ON name = criterion WHERE verdict <> 'SKIPPED' GROUP BY item_id),
prior AS (SELECT DISTINCT item_id, CAST(item_id % 10 + 1 AS INTEGER) AS prior_score FROM scores),
overall AS (SELECT item_id, CASE WHEN tw IS NULL THEN prior_score ELSE CAST(least(greatest(round_even(CAST(ws / tw AS DOUBLE), 0), 1), 10) AS INTEGER) END AS overall_score, ws, tw FROM prior LEFT JOIN w USING (item_id))"""


def raw_scores(spark, sf_dir):
    return view(spark, sf_dir, "scores")


def clean(spark, sf_dir):
    return a.clean_scores(raw_scores(spark, sf_dir), CRITERIA)


def skipped(spark, sf_dir):
    return a.skip_dependents(clean(spark, sf_dir), CRITERIA)


def weighted(spark, sf_dir, scores, items=None):
    """Every item, by default every scored one; those that match no criterion keep the score they came with."""
    came_with = (F.col("item_id") % 10 + 1).cast("int")
    items = raw_scores(spark, sf_dir) if items is None else items
    prior = items.select("item_id").distinct().select("item_id", came_with.alias("overall_score"), a.verdict(came_with).alias("overall_verdict"))
    return a.weighted_score(scores, CRITERIA, prior)


@query("a01_validity_gate", ("media",), """m AS (SELECT *, page_id % 6 AS sig, greatest(width, height) AS longest FROM media) SELECT page_id, CASE WHEN lower(image_type) NOT IN ('jpeg', 'jpg', 'png') THEN 'type not allowed' WHEN sig > 3 THEN 'not a JPEG or PNG file'
 WHEN width < 100 OR height < 100 THEN 'too small' END AS problem, CASE WHEN longest > 1000 THEN CAST(trunc(width * (CAST(1000 AS DOUBLE) / longest)) AS BIGINT) ELSE width END AS new_width,
 CASE WHEN longest > 1000 THEN CAST(trunc(height * (CAST(1000 AS DOUBLE) / longest)) AS BIGINT) ELSE height END AS new_height FROM m""")
def a01(spark, sf_dir):
    kind = F.col("page_id") % 6
    signature = F.when(kind < 2, F.unhex(F.lit("FFD8FFE000104A46"))).when(kind < 4, F.unhex(F.lit("89504E470D0A1A0A"))).when(kind == 4, F.unhex(F.lit("4749463839610000")))
    media = view(spark, sf_dir, "media").withColumn("signature", signature)
    return a.validity_gate(media).select("page_id", "problem", "new_width", "new_height")


def requests(spark, sf_dir):
    """Criteria lists as a form field would bring them, good and bad."""
    key, name = F.col("p_partkey"), F.col("p_name")
    good = F.concat(
        F.lit('[{"name":"'), name, F.lit('","type":"cv","weight":'), (key % 5 + 1).cast("string"),
        F.lit(',"hint":"quality"},{"name":"has roof","depends_on":"'), name, F.lit('"},{"name":"has door","hint":"presence","weight":0.5}]'),
    )
    raw = (
        F.when(key % 11 == 1, "[{").when(key % 11 == 2, '{"name":"a"}').when(key % 11 == 3, '[{"type":"cv"}]')
        .when(key % 11 == 4, '[{"name":"a","type":"xx"}]').when(key % 11 == 5, '[{"name":"a","weight":0}]')
        .when(key % 11 == 6, '[{"name":"a","hint":"loud"}]').otherwise(good)
    )
    return table(spark, sf_dir, "part").select(key.alias("request_id"), raw.alias("raw"))


@query("a02_parse_criteria", (), """SELECT p_partkey AS request_id, x.pos, CASE x.pos WHEN 0 THEN p_name WHEN 1 THEN 'has roof' ELSE 'has door' END AS name, CASE x.pos WHEN 0 THEN 'cv' ELSE 'llm' END AS type,
 CASE x.pos WHEN 0 THEN CAST(p_partkey % 5 + 1 AS DOUBLE) WHEN 1 THEN 1.0 ELSE 0.5 END AS weight, CASE x.pos WHEN 0 THEN 'quality' WHEN 1 THEN 'auto' ELSE 'presence' END AS hint,
 CASE x.pos WHEN 1 THEN p_name END AS depends_on FROM part CROSS JOIN (VALUES (0), (1), (2)) x(pos) WHERE p_partkey % 11 NOT IN (1, 2, 3, 4, 5, 6)""")
def a02(spark, sf_dir):
    rows = a.parse_criteria(requests(spark, sf_dir)).where(F.col("reject").isNull())
    return rows.select("request_id", F.posexplode("criteria").alias("pos", "c")).select("request_id", "pos", "c.*")


@query("a02_parse_criteria_rejects", (), """SELECT p_partkey AS request_id, CASE p_partkey % 11 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not a list' WHEN 3 THEN 'name missing' WHEN 4 THEN 'unknown type'
 WHEN 5 THEN 'weight must be positive' ELSE 'unknown hint' END AS reject FROM part WHERE p_partkey % 11 BETWEEN 1 AND 6""")
def a02_rejects(spark, sf_dir):
    return a.parse_criteria(requests(spark, sf_dir)).where(F.col("reject").isNotNull()).select("request_id", "reject")


def named_criteria(spark, sf_dir):
    kind = F.when(F.col("crit_no") > 3, "cv").otherwise("llm").alias("type")
    return raw_scores(spark, sf_dir).select("item_id", F.col("returned_key").alias("name"), kind)


@query("a03_route_criteria", S, """SELECT item_id, returned_key AS name, d AS detector, CASE WHEN d IS NULL THEN 'model' ELSE 'detector' END AS route
 FROM (SELECT *, CASE WHEN crit_no > 3 THEN CASE lower(trim(returned_key)) WHEN 'sharpness' THEN 'sharpness' WHEN 'proper exposure' THEN 'exposure' WHEN 'has sky' THEN 'sky' WHEN 'has skyy' THEN 'sky' END END AS d FROM scores) t""")
def a03(spark, sf_dir):
    return a.route_criteria(named_criteria(spark, sf_dir)).select("item_id", "name", "detector", "route")


COVER = """CASE WHEN m > {hi} THEN least(10, CAST(trunc(7 + (m - {hi}::DOUBLE) / {st}::DOUBLE) AS INTEGER)) WHEN m >= {lo} THEN CAST(trunc(4 + (m - {lo}::DOUBLE) / {ls}::DOUBLE) AS INTEGER)
 ELSE greatest(1, CAST(trunc(m / {lo}::DOUBLE * 3) AS INTEGER)) END"""
CONF = "CASE WHEN m > {hi} THEN least({top}, CAST(trunc({base} + m * {slope}) AS INTEGER)) WHEN m >= {lo} THEN {cl} ELSE {cf} END"
WORD = "CASE WHEN m > {hi} THEN 'PASS' WHEN m >= {lo} THEN 'MARGINAL' ELSE 'FAIL' END"


def _bands(template: str) -> str:
    names = ("hi", "lo", "st", "ls", "base", "slope", "top", "cl", "cf")
    return " ".join(f"WHEN '{k}' THEN {template.format(**dict(zip(names, v)))}" for k, v in a.BANDS.items())


MEASURED = f"""scored AS (SELECT item_id, kind, measure, measure_low, CASE kind WHEN 'sharpness' THEN least(10, CAST(trunc(10 * least(m / 300.0::DOUBLE, 1.0::DOUBLE)) AS INTEGER))
 WHEN 'exposure' THEN CASE WHEN m BETWEEN 30 AND 220 THEN CAST(trunc(1 + 9 * (m - 30) / 190.0::DOUBLE) AS INTEGER) ELSE 2 END WHEN 'faces' THEN CASE WHEN m >= 1 THEN 10 WHEN measure_low >= 1 THEN 5 ELSE 1 END {_bands(COVER)} END AS score,
 CASE kind WHEN 'sharpness' THEN CASE WHEN m >= 100 THEN 'PASS' ELSE 'FAIL' END WHEN 'exposure' THEN CASE WHEN m BETWEEN 30 AND 220 THEN 'PASS' ELSE 'FAIL' END WHEN 'faces' THEN CASE WHEN m >= 1 THEN 'PASS' WHEN measure_low >= 1 THEN 'MARGINAL' ELSE 'FAIL' END {_bands(WORD)} END AS verdict,
 CASE WHEN kind IN ('sharpness', 'exposure') THEN 100 WHEN kind = 'faces' THEN CASE WHEN m >= 1 THEN 85 WHEN measure_low >= 1 THEN 55 ELSE 80 END ELSE CASE kind {_bands(CONF)} END END AS confidence FROM (SELECT *, measure AS m FROM measures) x)"""


@query("a04_score_measure", ("measures",), MEASURED + " SELECT item_id, kind, measure, measure_low, score, verdict, confidence FROM scored")
def a04(spark, sf_dir):
    return a.score_measure(view(spark, sf_dir, "measures"))


@query("a05_repair_keys", S, CLEAN + " SELECT item_id, crit_no, criterion FROM clean")
def a05(spark, sf_dir):
    return raw_scores(spark, sf_dir).select("item_id", "crit_no", a.repair_key(F.col("returned_key"), NAMES).alias("criterion"))


@query("a06_clamp_scores", S, CLEAN + " SELECT item_id, criterion, score, confidence FROM clean")
def a06(spark, sf_dir):
    return clean(spark, sf_dir).drop("verdict")


@query("a07_verdict", S, CLEAN + " SELECT verdict, count(*) AS rows, min(score) AS low, max(score) AS high FROM judged GROUP BY verdict")
def a07(spark, sf_dir):
    return clean(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("rows"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("a08_skip_dependents", S, SKIP + " SELECT item_id, criterion, score, confidence, verdict FROM final", recursive=True)
def a08(spark, sf_dir):
    return skipped(spark, sf_dir)


@query("a09_weighted_score", S, WEIGHTED + """, parts AS (SELECT item_id, string_agg(criterion || ':' || score || '*' || weight || '=' || CAST(score * weight AS DOUBLE), ' ' ORDER BY criterion) AS breakdown FROM final JOIN crit ON name = criterion WHERE verdict <> 'SKIPPED' GROUP BY item_id)
 SELECT item_id, overall_score, CASE WHEN overall_score >= 7 THEN 'PASS' WHEN overall_score >= 4 THEN 'MARGINAL' ELSE 'FAIL' END AS overall_verdict, breakdown,
 tw AS total_weight, ws AS weighted_sum, CAST(printf('%.4f', CAST(ws / tw AS DOUBLE)) AS DOUBLE) AS unrounded_average FROM overall LEFT JOIN parts USING (item_id)""", recursive=True)
def a09(spark, sf_dir):
    rows = weighted(spark, sf_dir, skipped(spark, sf_dir))

    def part(c):
        return F.concat(c["criterion"], F.lit(":"), c["score"].cast("string"), F.lit("*"), c["weight"].cast("string"), F.lit("="), c["contribution"].cast("string"))

    return rows.withColumn("breakdown", F.array_join(F.transform("per_criterion", part), " ")).drop("per_criterion")


def request_lists(spark, sf_dir):
    """A criteria list per part: a chain, a cycle, a self-dependency or no dependency, all with names and weights of its own."""
    key, name = F.col("p_partkey"), F.col("p_name")
    first_parent = F.when(key % 4 == 1, ',"depends_on":"door shut"').when(key % 4 == 2, F.concat(F.lit(',"depends_on":"'), name, F.lit('"'))).otherwise("")
    second_parent = F.when(key % 4 < 2, F.concat(F.lit(',"depends_on":"'), name, F.lit('"'))).otherwise("")
    third_parent = F.when(key % 4 == 0, ',"depends_on":"door shut"').otherwise("")
    raw = F.concat(
        F.lit('[{"name":"'), name, F.lit('","weight":'), (key % 5 + 1).cast("string"), first_parent, F.lit('},{"name":"door shut","weight":0.5'), second_parent,
        F.lit('},{"name":"floor dry","weight":2.25'), third_parent, F.lit("}]"),
    )
    return a.parse_criteria(table(spark, sf_dir, "part").select(key.alias("request_id"), raw.alias("raw"))).select("request_id", "criteria")


def request_scores(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), "p_name")
    wide = view(spark, sf_dir, "scores").withColumn("request_id", 1 + F.col("item_id") % F.lit(parts.count())).join(beside(parts), "request_id")
    number = F.col("crit_no")
    key = F.when(number == 1, F.concat(F.upper("p_name"), F.lit(" "))).when(number == 2, "door shut").when(number == 3, "flor dry").otherwise(F.concat(F.lit("zz"), number.cast("string")))
    return wide.withColumn("returned_key", key).drop("p_name")


@query("a21_criteria_per_request", S, """n AS (SELECT count(*) AS parts FROM part),
 lists AS (SELECT p_partkey AS request_id, p_name AS name, CAST(p_partkey % 5 + 1 AS DOUBLE) AS weight, CASE p_partkey % 4 WHEN 1 THEN 'door shut' WHEN 2 THEN p_name END AS parent FROM part
 UNION ALL SELECT p_partkey, 'door shut', 0.5, CASE WHEN p_partkey % 4 < 2 THEN p_name END FROM part UNION ALL SELECT p_partkey, 'floor dry', 2.25, CASE WHEN p_partkey % 4 = 0 THEN 'door shut' END FROM part),
 judged AS (SELECT request_id, item_id, criterion, score, CASE WHEN score >= 7 THEN 'PASS' WHEN score >= 4 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM (SELECT p_partkey AS request_id, item_id, CASE crit_no WHEN 1 THEN p_name WHEN 2 THEN 'door shut' WHEN 3 THEN 'floor dry' ELSE 'zz' || CAST(crit_no AS VARCHAR) END AS criterion,
 least(greatest(coalesce(CASE WHEN regexp_matches(raw_score, '^-?[0-9]+$') THEN CAST(raw_score AS INTEGER) END, 5), 1), 10) AS score FROM scores, n JOIN part ON p_partkey = 1 + item_id % parts) t),
 up(request_id, name, ancestor, depth) AS (SELECT request_id, name, parent, 1 FROM lists WHERE parent IS NOT NULL UNION ALL SELECT u.request_id, u.name, l.parent, depth + 1 FROM up u JOIN lists l ON l.request_id = u.request_id AND l.name = u.ancestor WHERE l.parent IS NOT NULL AND depth < 4),
 skips AS (SELECT DISTINCT j.item_id, j.criterion FROM judged j JOIN up ON up.request_id = j.request_id AND up.name = j.criterion LEFT JOIN judged d ON d.item_id = j.item_id AND d.criterion = up.ancestor WHERE coalesce(d.verdict, 'FAIL') <> 'PASS'),
 final AS (SELECT j.request_id, j.item_id, j.criterion, CASE WHEN s.item_id IS NULL THEN j.score END AS score, CASE WHEN s.item_id IS NULL THEN j.verdict ELSE 'SKIPPED' END AS verdict FROM judged j LEFT JOIN skips s ON s.item_id = j.item_id AND s.criterion = j.criterion),
 w AS (SELECT f.item_id, CAST(least(greatest(round_even(CAST(sum(score * weight) / sum(weight) AS DOUBLE), 0), 1), 10) AS INTEGER) AS overall_score FROM final f JOIN lists l ON l.request_id = f.request_id AND l.name = f.criterion WHERE verdict <> 'SKIPPED' GROUP BY f.item_id)
 SELECT request_id, f.item_id, criterion, score, verdict, overall_score FROM final f LEFT JOIN w ON w.item_id = f.item_id""", recursive=True)
def a21(spark, sf_dir):
    lists = materialize(request_lists(spark, sf_dir), "lists")
    scores = materialize(a.skip_request_dependents(a.clean_request_scores(request_scores(spark, sf_dir), lists), lists), "scores")
    overall = a.weighted_request_score(scores, lists).select("item_id", "overall_score")
    return scores.join(overall, "item_id", "left").select("request_id", "item_id", "criterion", "score", "verdict", "overall_score")


@query("a10_detector_overall", ("measures",), MEASURED + """ SELECT item_id, CASE WHEN count(*) FILTER (WHERE verdict = 'FAIL') >= 2 THEN 'FAIL' WHEN count(*) FILTER (WHERE verdict = 'FAIL') = 1 THEN 'MARGINAL' ELSE 'PASS' END AS overall_verdict,
 CAST(round_even(avg(score), 0) AS INTEGER) AS overall_score FROM scored WHERE score IS NOT NULL GROUP BY item_id""")
def a10(spark, sf_dir):
    return a.detector_overall(a.score_measure(view(spark, sf_dir, "measures")))


@query("a11_merge_methods", ("measures", "scores"), MEASURED + ", " + CLEAN + """, det AS (SELECT item_id, CASE kind WHEN 'exposure' THEN 'proper exposure' ELSE kind END AS criterion, score, confidence, verdict FROM scored WHERE score IS NOT NULL),
 both_ AS (SELECT item_id, criterion, score, confidence, verdict, 'detector' AS method, 1 AS r FROM det UNION ALL SELECT item_id, criterion, score, confidence, verdict, 'model', 0 FROM judged)
 SELECT item_id, criterion, score, confidence, verdict, method FROM both_ QUALIFY row_number() OVER (PARTITION BY item_id, criterion ORDER BY r) = 1""")
def a11(spark, sf_dir):
    name = F.when(F.col("kind") == "exposure", "proper exposure").otherwise(F.col("kind"))
    detected = a.score_measure(view(spark, sf_dir, "measures")).withColumn("criterion", name)
    return a.merge_methods(detected, clean(spark, sf_dir))


def pairs(spark, sf_dir):
    """Every order is compared with two others; weights cycle through their range."""
    key = F.col("o_orderkey")
    others = F.explode(F.array(key - key % 8, key - key % 64 + 3)).alias("example_id")
    weighted = table(spark, sf_dir, "orders").select(key.alias("item_id"), others).distinct()
    return weighted.withColumn("weight", (F.col("example_id") % 5) / F.lit(4.0))


def scores_twice(spark, sf_dir):
    """Final scores of the items and the same rows as examples, computed once and written."""
    scores = materialize(skipped(spark, sf_dir), "scores")
    return scores, scores.select(F.col("item_id").alias("example_id"), "criterion", "score")


SIMILAR = WEIGHTED + """, pairs AS (SELECT DISTINCT o_orderkey AS item_id, unnest([o_orderkey - o_orderkey % 8, o_orderkey - o_orderkey % 64 + 3]) AS example_id FROM orders),
 common AS (SELECT p.item_id, p.example_id, CAST(sum(CAST(printf('%.3f', 1.0::DOUBLE - abs(e.score - i.score) / 9.0::DOUBLE) AS DECIMAL(18, 3))) AS DOUBLE) / count(*) AS mean, count(*) AS common FROM pairs p JOIN final i ON i.item_id = p.item_id AND i.score IS NOT NULL
 JOIN final e ON e.item_id = p.example_id AND e.criterion = i.criterion AND e.score IS NOT NULL GROUP BY 1, 2),
 sim AS (SELECT p.item_id, p.example_id, (p.example_id % 5) / 4.0::DOUBLE AS weight, coalesce(common, 0) AS common, coalesce(CAST(printf('%.3f', mean) AS DOUBLE), 0.5) AS overall_similarity,
 coalesce(CAST(printf('%.1f', mean * 10) AS DOUBLE), 5.0) AS similarity_score FROM pairs p LEFT JOIN common c USING (item_id, example_id)),
 blended AS (SELECT s.*, o.overall_score, CAST(printf('%.1f', CAST(least(greatest((1.0::DOUBLE - weight) * coalesce(o.overall_score, s.item_id % 10 + 1) + weight * similarity_score, 1.0), 10.0) AS DOUBLE)) AS DOUBLE) AS blended FROM sim s LEFT JOIN overall o ON o.item_id = s.item_id)"""
VERDICT = "CASE WHEN trunc({c}) >= 7 THEN 'PASS' WHEN trunc({c}) >= 4 THEN 'MARGINAL' ELSE 'FAIL' END"


@query("a12_similarity", S, SIMILAR + """, listed AS (SELECT p.item_id, p.example_id, string_agg(i.criterion || ':' || e.score || ',' || i.score || ',' || CAST(printf('%.3f', 1.0::DOUBLE - abs(e.score - i.score) / 9.0::DOUBLE) AS DOUBLE), ' ' ORDER BY i.criterion) AS parts
 FROM pairs p JOIN final i ON i.item_id = p.item_id AND i.score IS NOT NULL JOIN final e ON e.item_id = p.example_id AND e.criterion = i.criterion AND e.score IS NOT NULL GROUP BY 1, 2)
 SELECT item_id, example_id, common, overall_similarity, similarity_score, coalesce(parts, '') AS parts FROM sim LEFT JOIN listed USING (item_id, example_id)""", recursive=True)
def a12(spark, sf_dir):
    def part(c):
        return F.concat(c["criterion"], F.lit(":"), c["example_score"].cast("string"), F.lit(","), c["input_score"].cast("string"), F.lit(","), c["similarity"].cast("string"))

    rows = a.similarity(pairs(spark, sf_dir), *scores_twice(spark, sf_dir)).drop("weight")
    return rows.withColumn("parts", F.array_join(F.transform("per_criterion", part), " ")).drop("per_criterion")


def blended(spark, sf_dir):
    scores, examples = scores_twice(spark, sf_dir)
    compared = a.similarity(pairs(spark, sf_dir), scores, examples)
    compared_items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    overall = weighted(spark, sf_dir, scores, compared_items).select("item_id", "overall_score")
    return a.blend(compared.join(overall, "item_id"))


@query("a13_blend", S, SIMILAR + f" SELECT item_id, example_id, blended, {VERDICT.format(c='blended')} AS blended_verdict FROM blended", recursive=True)
def a13(spark, sf_dir):
    return blended(spark, sf_dir).select("item_id", "example_id", "blended", "blended_verdict")


@query("a14_aggregate", S, SIMILAR + f""", agg AS (SELECT item_id, CAST(printf('%.1f', CAST(sum(CAST(printf('%.1f', blended) AS DECIMAL(18, 1))) AS DOUBLE) / count(*)) AS DOUBLE) AS score, count(*) AS examples FROM blended GROUP BY item_id)
 SELECT item_id, score, examples, {VERDICT.format(c='score')} AS verdict FROM agg""", recursive=True)
def a14(spark, sf_dir):
    return a.aggregate(blended(spark, sf_dir), "mean")


@query("a15_reuse_prior", S, WEIGHTED + """, ex AS (SELECT DISTINCT o_orderkey - o_orderkey % 8 AS example_id FROM orders)
 SELECT example_id, example_id % 3 = 0 AS has_prior, CASE WHEN example_id % 3 = 0 THEN CAST(example_id % 10 + 1 AS INTEGER) ELSE o.overall_score END AS overall_score FROM ex LEFT JOIN overall o ON o.item_id = example_id AND tw IS NOT NULL""", recursive=True)
def a15(spark, sf_dir):
    key = F.col("o_orderkey")
    examples = table(spark, sf_dir, "orders").select((key - key % 8).alias("example_id")).distinct().withColumn("has_prior", F.col("example_id") % 3 == 0)
    prior = examples.where("has_prior").select("example_id", (F.col("example_id") % 10 + 1).cast("int").alias("overall_score"))
    todo = a.work_list(examples)
    scores = clean(spark, sf_dir).join(todo.withColumnRenamed("example_id", "item_id"), "item_id", "left_semi")
    fresh = a.weighted_score(a.skip_dependents(scores, CRITERIA), CRITERIA).withColumnRenamed("item_id", "example_id")
    return a.reuse_prior(examples, prior, fresh)


@query("a16_assemble_prompts", (), f"""SELECT p_partkey AS request_id, '{a.SECTIONS["quality"]}:' || chr(10) || '  - ' || p_name || chr(10) || chr(10) || '{a.SECTIONS["presence"]}:' || chr(10) || '  - has door' || chr(10) || chr(10)
 || '{a.SECTIONS["auto"]}:' || chr(10) || '  - has roof' AS prompt, '"' || p_name || '", "has roof", "has door"' AS key_list, 3 AS n_keys FROM part WHERE p_partkey % 11 NOT BETWEEN 1 AND 6""")
def a16(spark, sf_dir):
    return a.assemble_prompts(a.parse_criteria(requests(spark, sf_dir))).drop("scaffold")


RECOVERED = """r AS (SELECT item_id, attempt, CASE WHEN json_valid(reply) THEN reply WHEN json_valid(regexp_extract(reply, '(?s)\\{.*\\}')) THEN regexp_extract(reply, '(?s)\\{.*\\}') END AS j FROM model_replies),
 good AS (SELECT item_id, attempt, CASE WHEN json_extract(j, '$.assessment') IS NOT NULL THEN j END AS j FROM r)"""


@query("a17_recover_json", ("model_replies",), RECOVERED + " SELECT item_id, attempt, CAST(j->>'$.assessment.overall_score' AS BIGINT) AS score, j IS NOT NULL AS recovered FROM good")
def a17(spark, sf_dir):
    text = a.recover_json(F.col("reply"))
    score = F.try_variant_get(F.try_parse_json(text), "$.assessment.overall_score", "bigint")
    return view(spark, sf_dir, "model_replies").select("item_id", "attempt", score.alias("score"), text.isNotNull().alias("recovered"))


@query("a18_attempt_outcome", ("model_replies",), RECOVERED + """, m AS (SELECT g.item_id, g.attempt, g.j, (g.item_id + g.attempt) % 17 = 0 AS broken FROM good g),
 f AS (SELECT * FROM m WHERE broken OR j IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt) = 1), everyone AS (SELECT item_id, max(attempt) AS tried FROM m GROUP BY item_id)
 SELECT e.item_id, CASE WHEN f.broken THEN 'transport error' WHEN f.j IS NOT NULL THEN 'ok' ELSE 'failed' END AS outcome, coalesce(f.attempt, tried) AS attempts,
 CASE WHEN f.broken THEN NULL WHEN f.j IS NOT NULL THEN least(greatest(CAST(f.j->>'$.assessment.overall_score' AS INTEGER), 1), 10) ELSE 1 END AS score FROM everyone e LEFT JOIN f USING (item_id)""")
def a18(spark, sf_dir):
    replies = view(spark, sf_dir, "model_replies")
    return a.attempt_outcome(replies.withColumn("transport_error", (F.col("item_id") + F.col("attempt")) % 17 == 0))


@query("a19_group_aliases", (), """g AS (SELECT DISTINCT lower(substr(n_name, 1, 1)) AS code FROM nation), m AS (SELECT DISTINCT substr(p_name, 1, 1) AS code, p_name AS member FROM part)
 SELECT code, member FROM g LEFT JOIN m USING (code)""")
def a19(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 1)).alias("code")).distinct()
    members = table(spark, sf_dir, "part").select(F.substring("p_name", 1, 1).alias("code"), F.col("p_name").alias("member"))
    return a.group_aliases(groups, members)


@query("a20_tag_codes", (), """codes AS (SELECT DISTINCT regexp_extract(token, '^<2([a-z]{2,3}(?:_[A-Za-z]+)?)>$', 1) AS code FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN '<2' || lang || '_Latn>' WHEN doc_id % 3 = 0 THEN '<' || lang || '>' ELSE '<2' || lang || '>' END AS token FROM documents) t WHERE regexp_matches(token, '^<2([a-z]{2,3}(?:_[A-Za-z]+)?)>$')),
 asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr_Latn' WHEN 2 THEN 'xx' ELSE lower(substr(n_name, 1, 2)) END AS target FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT c_custkey, target, code IS NOT NULL AS supported FROM asked LEFT JOIN codes ON code = target""")
def a20(spark, sf_dir):
    lang = F.col("lang")
    token = (
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("<2"), lang, F.lit("_Latn>")))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<"), lang, F.lit(">"))).otherwise(F.concat(F.lit("<2"), lang, F.lit(">")))
    )
    codes = a.tag_codes(table(spark, sf_dir, "documents").select(token.alias("token")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    kind = F.col("c_custkey") % 4
    target = F.when(kind == 0, "de").when(kind == 1, "fr_Latn").when(kind == 2, "xx").otherwise(F.lower(F.substring("n_name", 1, 2)))
    asked = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", target.alias("target"))
    return a.check_targets(asked, codes)
