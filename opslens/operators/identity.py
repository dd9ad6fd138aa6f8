"""Identity resolution of events against customer and project tables, and plans of what to write.

Lookups never list pairs: the reference side is first reduced to one row per lookup key with the number
of candidates, so every join adds at most one row per event however often a name repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.columns import mapping, one_of, truthy_text
from opslens.functions.scale import HOT_ROWS, last_per_key, row_rank
from opslens.session import materialize

# Status of cancelled projects and the object type of people.
CANCELLED_STATUS = (59,)
PERSON_TYPE = 8

_KEY = ("_kind", "_k1", "_k2", "_k3")


def identity_key(ext_id: Column, name: Column, address: Column) -> Column:
    """`id:` and the external id, else `na:` with lower-case name and address."""
    def low(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    return F.when(F.coalesce(ext_id, F.lit("")) != "", F.concat(F.lit("id:"), ext_id)).otherwise(
        F.concat(F.lit("na:"), low(name), F.lit("|"), low(address))
    )


def with_identity(events: DataFrame) -> DataFrame:
    return events.withColumn("identity", identity_key(F.col("ext_id"), F.col("customer_name"), F.col("address")))


def group_in_order(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Position of every event within its identity by time; events without a time come first.

    The events are read once for the counts of identities, once more for the bounds of hot ones, and once for the ranks: hand over a
    written table where they are costly to compute.
    """
    time = F.coalesce("sent_s", F.lit(-1))
    order = [time, F.col("message_id")]
    return row_rank(events, ["identity"], order, "position", hot_rows)


def group_sizes(events: DataFrame, top: int = 10) -> DataFrame:
    """The largest identities and one row with the number of the others."""
    sizes = events.groupBy("identity").agg(F.count("*").alias("events"))
    rest = sizes.agg(F.greatest(F.count("*") - top, F.lit(0)).alias("events")).select(F.lit("(others)").alias("identity"), "events")
    return sizes.orderBy(F.desc("events"), "identity").limit(top).unionByName(rest)


def live_projects(projects: DataFrame) -> DataFrame:
    """Neither archived nor cancelled; a null status is dropped as in SQL."""
    return projects.where(~F.col("archived") & ~F.col("status_id").isin(*CANCELLED_STATUS))


def _key(kind: str, *parts: Column) -> Column:
    padded = list(parts) + [F.lit("")] * (3 - len(parts))
    return F.struct(F.lit(kind).alias("_kind"), *[c.alias(f"_k{i}") for i, c in enumerate(padded, 1)])


def lookup_table(rows: DataFrame, keys: Sequence[Column], found: str, count: str) -> DataFrame:
    """One row per lookup key: candidate count and the id to use when there is just one."""
    exploded = rows.select("id", F.explode(F.array(*keys)).alias("k")).select("id", "k.*")
    filled = F.col("_k1").isNotNull() & F.col("_k2").isNotNull() & F.col("_k3").isNotNull()
    return exploded.where(filled).groupBy(*_KEY).agg(F.count("*").alias(count), F.min("id").alias(found))


def attach_lookup(rows: DataFrame, key: Column, row_id: str, table: DataFrame, found: str, count: str) -> DataFrame:
    """Left join of the lookup. Rows with nothing to look up get a key of their own, so they do not pile up."""
    spread = F.coalesce(key, _key("none", F.col(row_id).cast("string")))
    joined = rows.withColumn("_k", spread).select("*", "_k.*").join(table, list(_KEY), "left").drop("_k", *_KEY)
    return joined.withColumn(count, F.coalesce(count, F.lit(0)))


def project_lookup(projects: DataFrame, kinds: Sequence[str] = ("ext", "name", "place")) -> DataFrame:
    """Lookup rows of live projects for the wanted kinds of key only."""
    name, street = F.lower("project_name"), F.lower("street1")
    keys = {"ext": _key("ext", F.col("ext_id")), "name": _key("name", name), "place": _key("place", name, street)}
    return lookup_table(live_projects(projects), [keys[k] for k in kinds], "_project", "_count")


def _ext_key() -> Column:
    return F.when(F.coalesce("ext_id", F.lit("")) != "", _key("ext", F.col("ext_id")))


def _name_key() -> Column:
    name = F.nullif(F.col("customer_name"), F.lit(""))
    low, place = F.lower(F.trim(name)), F.lower(F.trim("address"))
    has_place = F.coalesce("address", F.lit("")) != ""
    return F.when(name.isNotNull(), F.when(has_place, _key("place", low, place)).otherwise(_key("name", low)))


def resolve_by_ext_id(events: DataFrame, projects: DataFrame, row_id: str = "message_id") -> DataFrame:
    """Number of live projects with the event's external id, and the id of a single one."""
    hits = attach_lookup(events, _ext_key(), row_id, project_lookup(projects, ["ext"]), "_project", "_count")
    return _named(hits, "matches", "project_id")


def resolve_by_name(events: DataFrame, projects: DataFrame, row_id: str = "message_id") -> DataFrame:
    """The same by name, and by street too where the event has one. Several candidates are never picked from."""
    hits = attach_lookup(events, _name_key(), row_id, project_lookup(projects, ["name", "place"]), "_project", "_count")
    return _named(hits, "matches", "project_id")


def _named(hits: DataFrame, count: str, found: str) -> DataFrame:
    single = F.when(F.col("_count") == 1, F.col("_project"))
    return hits.withColumn(found, single).withColumnRenamed("_count", count).drop("_project")


def resolve_context(events: DataFrame, projects: DataFrame, row_id: str = "message_id") -> DataFrame:
    """What the project table knows about every event: found, ambiguous, project_id, candidate_count, note.

    By external id first; only where that finds nothing, by name.
    """
    table = project_lookup(projects)
    first = _named(attach_lookup(events, _ext_key(), row_id, table, "_project", "_count"), "_ext_count", "_ext_project")
    name_key = F.when(F.col("_ext_count") == 0, _name_key())
    second = _named(attach_lookup(first, name_key, row_id, table, "_project", "_count"), "_name_count", "_name_project")
    count = F.when(F.col("_ext_count") > 0, F.col("_ext_count")).otherwise(F.col("_name_count"))
    rows = second.withColumns(
        {"candidate_count": count, "project_id": F.coalesce("_ext_project", "_name_project")}
    ).drop("_ext_count", "_ext_project", "_name_count", "_name_project")
    rows = rows.withColumns({"found": F.col("candidate_count") > 0, "ambiguous": F.col("candidate_count") > 1})
    return rows.withColumn("context_note", context_note())


def context_note() -> Column:
    return one_of(
        [
            (F.col("ambiguous"), F.concat(F.lit("ambiguous ("), F.col("candidate_count").cast("string"), F.lit(" candidates)"))),
            (F.col("found"), F.concat(F.lit("project found (id="), F.col("project_id").cast("string"), F.lit(")"))),
        ],
        "project not found",
    )


def offline_context(events: DataFrame) -> DataFrame:
    """Context without a project table: nothing found, nothing looked up."""
    return events.withColumns(
        {
            "candidate_count": F.lit(0).cast("bigint"),
            "project_id": F.lit(None).cast("bigint"),
            "found": F.lit(False),
            "ambiguous": F.lit(False),
            "context_note": F.lit("offline"),
        }
    )


def entity_lookup(entities: DataFrame) -> DataFrame:
    people = entities.where(~F.col("archived") & (F.col("object_type_id") == PERSON_TYPE))
    first, last, street = F.lower("first_name"), F.lower("last_name"), F.lower("street1")
    keys = [
        _key("email", F.lower("email")), _key("last", last), _key("last_first", last, first),
        _key("last_street", last, street), _key("last_first_street", last, first, street),
    ]
    return lookup_table(people, keys, "_entity", "_entities")


def entity_key(name: Column, email: Column, street: Column) -> Column:
    """The e-mail address wins; else the last name, with first name and street where given."""
    parts = F.split(F.trim(name), r"\s+", 2)
    last = F.lower(F.element_at(parts, -1))
    first = F.when(F.size(parts) == 2, F.lower(F.get(parts, F.lit(0))))
    place = F.lower(F.trim(F.nullif(street, F.lit(""))))
    has_email, has_name = F.coalesce(email, F.lit("")) != "", F.coalesce(name, F.lit("")) != ""
    return one_of(
        [
            (has_email, _key("email", F.lower(F.trim(email)))),
            (has_name & first.isNotNull() & place.isNotNull(), _key("last_first_street", last, first, place)),
            (has_name & first.isNotNull(), _key("last_first", last, first)),
            (has_name & place.isNotNull(), _key("last_street", last, place)),
            (has_name, _key("last", last)),
        ]
    )


def match_entity(people: DataFrame, entities: DataFrame, row_id: str) -> DataFrame:
    """`entity_matches` and, for a single one, `entity_id`; people have `name, email, street`."""
    key = entity_key(F.col("name"), F.col("email"), F.col("street"))
    hits = attach_lookup(people, key, row_id, entity_lookup(entities), "_entity", "_entities")
    single = F.when(F.col("_entities") == 1, F.col("_entity"))
    return hits.withColumn("entity_id", single).withColumnRenamed("_entities", "entity_matches").drop("_entity")


def lookup_state(rows: DataFrame, states: DataFrame) -> DataFrame:
    """`state_id` by abbreviation, else by name."""
    by_abbr = states.groupBy(F.upper("abbreviation").alias("_abbr")).agg(F.max("id").alias("_by_abbr"))
    by_name = states.groupBy(F.lower("state_name").alias("_name")).agg(F.max("id").alias("_by_name"))
    joined = rows.join(by_abbr, F.upper(F.trim("state_abbr")) == F.col("_abbr"), "left").join(
        by_name, F.lower(F.trim("state_text")) == F.col("_name"), "left"
    )
    return joined.withColumn("state_id", F.coalesce("_by_abbr", "_by_name")).drop("_abbr", "_name", "_by_abbr", "_by_name")


def lookup_unique_name(asked: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Case-insensitive name to id; anything but one hit is an error row. `table` has `id, name, archived`."""
    by_name = (
        table.where(~F.col("archived")).groupBy(F.lower("name").alias("_name")).agg(F.count("*").alias("hits"), F.min("id").alias("_id"))
    )
    joined = asked.join(by_name, F.lower(F.trim(name)) == F.col("_name"), "left")
    return joined.select(
        *asked.columns,
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when(F.col("hits") == 1, F.col("_id")).alias("id"),
        F.when(F.coalesce("hits", F.lit(0)) != 1, F.lit("needs exactly one")).alias("error"),
    )


def _firsts(rows: DataFrame, row_id: str, wants: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Flags, for every name in `wants`, the first row of each key among the rows that want it.

    All keys go through one partial aggregate; its winners are joined back by the unique row id, so a key
    shared by very many rows never meets in one task.
    """
    entries = [
        F.when(wanted, F.struct(F.lit(flag).alias("flag"), key.alias("key"))) for flag, (key, wanted) in wants.items()
    ]
    asked = rows.select(F.col(row_id).alias("_id"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
    winners = asked.groupBy("e.flag", "e.key").agg(F.min("_id").alias("_id"))
    flags = winners.groupBy("_id").agg(*[F.bool_or(F.col("flag") == flag).alias(flag) for flag in wants])
    joined = rows.join(flags, rows[row_id] == flags["_id"], "left").drop("_id")
    return joined.withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in wants})


def plan_entities_projects(
    proposals: DataFrame,
    entities: DataFrame,
    projects: DataFrame,
    links: DataFrame,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Find-or-create plan of people, projects and their links, in set form.

    `proposals` has `proposal_id` (order), `ext_id, name, email, street, display_text`. Several matches go
    to review. Creates are deduplicated by lookup key: the first proposal creates, later ones reuse it.
    `links` has `entity_id, project_id, archived`. The matched rows are read twice; `cut` may write them first.
    """
    rows = match_entity(proposals, entities, "proposal_id")
    hits = attach_lookup(rows, _ext_key(), "proposal_id", project_lookup(projects, ["ext"]), "_project", "_count")
    rows = _named(hits, "project_matches", "project_id")
    has_ext = F.coalesce("ext_id", F.lit("")) != ""
    key = entity_key(F.col("name"), F.col("email"), F.col("street"))
    rows = rows.withColumn("_entity_key", F.to_json(key))
    status = one_of(
        [
            (~has_ext, "no external id"),
            (F.col("_entity_key").isNull(), "no name or email"),
            (F.col("entity_matches") > 1, "review entity"),
            (F.col("project_matches") > 1, "review project"),
        ],
        "ok",
    )
    rows = rows.withColumn("status", status)
    live_links = links.where(~F.col("archived")).select("entity_id", "project_id").distinct().withColumn("_linked", F.lit(True))
    both_known = F.col("entity_id").isNotNull() & F.col("project_id").isNotNull()
    probe = F.when(both_known, F.col("entity_id")).otherwise(-F.col("proposal_id") - 1)
    rows = (
        rows.withColumn("_probe", probe)
        .join(live_links.withColumnRenamed("entity_id", "_probe"), ["_probe", "project_id"], "left")
        .drop("_probe")
    )
    ok = F.col("status") == "ok"
    pair = F.concat_ws("|", F.coalesce(F.col("entity_id").cast("string"), F.col("_entity_key")), F.coalesce(F.col("project_id").cast("string"), F.col("ext_id")))
    rows = _firsts(
        cut(rows),
        "proposal_id",
        {
            "created_entity": (F.col("_entity_key"), F.col("status").isin("ok", "review project") & (F.col("entity_matches") == 0)),
            "created_project": (F.col("ext_id"), ok & (F.col("project_matches") == 0)),
            "created_link": (pair, ok & F.col("_linked").isNull()),
        },
    )
    project_name = F.coalesce(truthy_text(F.col("display_text"), F.col("name")), F.concat(F.lit("Project "), F.col("ext_id")))
    return rows.withColumn("project_name", F.when(F.col("created_project"), project_name)).drop("_entity_key", "_linked")


def milestone_updates(updates: DataFrame, stage_of: dict[str, tuple[str, int]], blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last status of every project and block, and the updates that failed; see `upsert_milestone`."""
    names = mapping({k: v[0] for k, v in stage_of.items()})
    states = mapping({k: v[1] for k, v in stage_of.items()})
    mapped = updates.withColumns(
        {"block_name": F.try_element_at(names, F.col("event_type")), "new_status": F.try_element_at(states, F.col("event_type"))}
    )
    known = lookup_unique_name(mapped, blocks, "block_name")
    reason = one_of([(F.col("block_name").isNull(), "no mapping"), (F.col("error").isNotNull(), "block is not unique")])
    failed = known.where(F.col("id").isNull()).select("project_id", "event_type", "ts", "seq", reason.alias("reason"))
    good = known.where(F.col("id").isNotNull()).withColumnRenamed("id", "block_id")
    return last_per_key(good, ["project_id", "block_id"], ["ts", "seq"], ["new_status"]), failed


def _merge_milestones(target: DataFrame, wanted: DataFrame) -> DataFrame:
    return target.join(wanted, ["project_id", "block_id"], "full_outer").select(
        "project_id",
        "block_id",
        F.coalesce("new_status", "status_id").alias("status_id"),
        one_of([(F.col("new_status").isNull(), "kept"), (F.col("status_id").isNull(), "inserted")], "updated").alias("change"),
    )


def upsert_milestone(target: DataFrame, updates: DataFrame, stage_of: dict[str, tuple[str, int]], blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New content of the milestone table and the updates that failed.

    `updates` has `project_id, event_type, ts, seq`; `stage_of` maps an event type to a block name and a
    status; `blocks` has `id, name, archived` and must hold the block name exactly once. The last update
    of a project and block wins; the target row is replaced or added.
    """
    wanted, failed = milestone_updates(updates, stage_of, blocks)
    return _merge_milestones(target, wanted), failed


class MilestoneTable:
    """The milestone table on disk, in folders by bucket of the project; an upsert rewrites only the buckets it touches.

    Neighbouring projects share a bucket (`span` of them in a row), so updates of recent projects touch few. `files` is the
    number of files of a bucket. Projects need an id: updates without one fail with a reason, stored rows have one.
    """

    SCHEMA = "project_id BIGINT, block_id BIGINT, status_id INT"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, span: int = 512, files: int = 1) -> None:
        self.spark, self.path, self.buckets, self.span, self.files = spark, path, buckets, span, files

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.expr(f"project_id div {self.span}"), F.lit(self.buckets)).cast("int"))

    def write(self, rows: DataFrame) -> None:
        """Replace the buckets that `rows` has, and no others."""
        part = F.pmod(F.xxhash64("project_id", "block_id"), F.lit(self.files)).cast("int")
        dealt = self._placed(rows.select("project_id", "block_id", "status_id")).repartition("bucket", part)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.SCHEMA}, bucket INT").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))).drop("bucket")

    def upsert(self, updates: DataFrame, stage_of: dict[str, tuple[str, int]], blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Apply the updates; the new rows of the touched buckets with `change`, and the updates that failed.

        The new rows are written beside the table before any bucket is replaced: if the job dies while buckets are
        swapped, `write` of the same rows, or the same upsert again, ends the work.
        """
        nameless = updates.where(F.col("project_id").isNull()).select("project_id", "event_type", "ts", "seq", F.lit("no project").alias("reason"))
        wanted, failed = milestone_updates(updates.where(F.col("project_id").isNotNull()), stage_of, blocks)
        wanted = materialize(wanted, "wanted")
        # numbers below `buckets`, so the list is bounded and prunes the scan as literals
        touched = sorted(r.bucket for r in self._placed(wanted).select("bucket").distinct().collect())
        merged = materialize(_merge_milestones(self.read(touched), wanted), "merged")
        if touched:
            self.write(merged)
        return merged, failed.unionByName(nameless)


def append_note(decisions: DataFrame, writer_id: int, prefix: str) -> DataFrame:
    """Note rows to append: text with prefix and mentions, and the same text as an insert delta."""
    names = F.array_join("mentioned_users", ", ")
    text = F.concat(
        F.lit(prefix), F.col("comment_text"),
        F.when(F.size("mentioned_users") > 0, F.concat(F.lit("\n(Mentions: "), names, F.lit(")"))).otherwise(""),
    )
    ended = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    delta = F.to_json(F.struct(F.array(F.struct(ended.alias("insert"))).alias("ops")))
    return decisions.select(
        "message_id", "project_id", text.alias("content_text"), delta.alias("content_delta"),
        F.lit(writer_id).alias("created_by"), F.lit(False).alias("archived"),
    )


def dry_run(plan: DataFrame, writer_id: int | None, dry: bool = True) -> DataFrame:
    """The intended writes with a flag; without a writer id every write is refused."""
    outcome = "refused" if writer_id is None else ("planned" if dry else "write")
    return plan.withColumns({"dry_run": F.lit(dry), "outcome": F.lit(outcome)})


def outcome_by_key(plan: DataFrame) -> DataFrame:
    flags = ("status", "created_entity", "created_project", "created_link")
    return plan.groupBy(*flags).agg(F.count("*").alias("proposals"))
