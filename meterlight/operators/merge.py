"""Merging repeated, late and conflicting observations, as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlight.functions.identity import nocase
from meterlight.schema import EVENT_KEY, RELATION_CONFIRMED, RELATION_NONE, RELATION_UNCERTAIN, SESSION_KEY, TURN_KEY


#: Entities up to which their marks are broadcast, at some hundred bytes each.
BROADCAST_MARKS = 100_000


def upsert_events(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """One row for each event key: the highest completion state, then revision, then
    the first to arrive by ``order``."""
    rank = Window.partitionBy(*EVENT_KEY).orderBy(F.desc("completion_state"), F.desc("source_revision"), *order)
    return arrivals.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def _last(value: str) -> Column:
    """The value of the last arrival that has one."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("arrival")))


def merge_sessions(observed: DataFrame) -> DataFrame:
    """Session rows from observations with arrival: side kind stays, unknown codes
    never win, two different confirmed parents or an uncertain relation end as
    uncertain without a parent, names go by their own time, first and last seen by
    minimum and maximum; entity, replay state and parser are those last seen. Merged rows may be
    merged again as the first to arrive."""
    confirmed = F.when(F.col("relation_state") == RELATION_CONFIRMED, F.col("parent_session_id"))
    conflict = (F.min(confirmed) != F.max(confirmed)) | (F.max("relation_state") == RELATION_UNCERTAIN)
    disputed = F.coalesce(conflict, F.lit(False))
    differ = F.coalesce((F.min(confirmed) != F.max(confirmed)).cast("int"), F.lit(0))
    has = set(observed.columns)
    if "forked_from_session_id" in has:
        differ = F.greatest(differ, F.coalesce((F.min("forked_from_session_id") != F.max("forked_from_session_id")).cast("int"), F.lit(0)))
    seen = F.struct("last_ms", "arrival")
    return observed.groupBy(*SESSION_KEY).agg(
        F.max("session_kind").alias("session_kind"),
        F.when(disputed, None).otherwise(F.max(confirmed)).alias("parent_session_id"),
        F.when(disputed, RELATION_UNCERTAIN).when(F.max(confirmed).isNotNull(), RELATION_CONFIRMED).otherwise(RELATION_NONE).alias("relation_state"),
        F.greatest(F.max("compatibility"), differ).alias("compatibility"),
        *[F.when(disputed, 0).otherwise(F.coalesce(F.max_by("relation_origin", F.when(confirmed.isNotNull(), F.col("arrival"))), F.lit(0))).alias("relation_origin") for _ in range("relation_origin" in has)],
        F.coalesce(F.max_by("session_role", F.when(F.col("session_role") != 0, F.col("arrival"))), F.lit(0)).alias("session_role"),
        _last("project_id").alias("project_id"),
        *[F.when(F.min(c) == F.max(c), F.max(c)).alias(c) for c in ("forked_from_session_id",) if c in has],
        *[_last(c).alias(c) for c in ("agent_path_hash", "agent_leaf_hash", "project_path", "repository_hash") if c in has],
        *[F.max_by(c, seen).alias(c) for c in ("source_entity_id", "replay_state", "parser_version") if c in has],
        F.max_by("session_name", F.when(F.col("session_name").isNotNull(), F.struct("name_ms", "arrival"))).alias("session_name"),
        F.max(F.when(F.col("session_name").isNotNull(), F.col("name_ms"))).alias("name_ms"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    )


def merge_turns(observed: DataFrame) -> DataFrame:
    """Earliest start, latest end, first preview, most messages, last known origin."""
    return observed.groupBy(*TURN_KEY).agg(
        F.min("start_ms").alias("start_ms"),
        F.max("completed_ms").alias("completed_ms"),
        F.min_by("preview", F.when(F.col("preview").isNotNull(), F.col("arrival"))).alias("preview"),
        F.max("user_messages").alias("user_messages"),
        _last("prompt_origin_turn").alias("prompt_origin_turn"),
    )


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last arrival of each key."""
    rank = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def path_repositories(rows: DataFrame) -> DataFrame:
    """(__path, __one) of the paths, ASCII case ignored, that have exactly one valid hash."""
    valid = F.when(F.col("repository_hash").rlike("^[0-9a-f]{64}$"), F.col("repository_hash"))
    seen = rows.where(valid.isNotNull() & F.col("project_path").isNotNull())
    return seen.groupBy(nocase(F.col("project_path")).alias("__path")).agg(F.min(valid).alias("__one"), F.max(valid).alias("__two")).where("__one = __two").select("__path", "__one")


def give_repositories(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the hash that ``known`` has for their path, and its first 24 digits as
    project_id, where they have no hash or the same."""
    joined = rows.join(known, nocase(F.col("project_path")) == F.col("__path"), "left")
    fits = F.col("__one").isNotNull() & (F.col("repository_hash").isNull() | (F.col("repository_hash") == F.col("__one")))
    return joined.withColumns({"project_id": F.when(fits, F.substring("__one", 1, 24)).otherwise(F.col("project_id")), "repository_hash": F.when(fits, F.col("__one")).otherwise(F.col("repository_hash"))}).drop("__path", "__one")


def reconcile_projects(rows: DataFrame) -> DataFrame:
    """``rows`` (project_path, repository_hash, project_id) where a path, ASCII case
    ignored, with exactly one valid hash gives it, and its first 24 digits as id, to
    rows that have none or the same."""
    return give_repositories(rows, path_repositories(rows))


def reconcile_touched(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """``rows`` reconciled at the paths that ``touched`` (project_path) names alone, ASCII case
    ignored; as ``reconcile_projects`` of all rows where the others were reconciled before."""
    paths = touched.where("project_path is not null").select(nocase(F.col("project_path")).alias("__at")).distinct()
    paths = F.broadcast(paths) if paths.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS else paths
    on = nocase(F.col("project_path")) == F.col("__at")
    return rows.join(paths, on, "left_anti").unionByName(reconcile_projects(rows.join(paths, on, "left_semi")).select(*rows.columns))


def preserve_prices(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """``staged`` with the price of a stored priced event: of the same dedup key,
    else of the same entity and event id, else of the same entity and revision."""
    at = ["agent_id", "source_instance_id"]
    price = F.struct("estimated_cost", "pricing_status", "pricing_missing")
    priced = stored.where("pricing_status <> 0").select(*at, "dedup_key", "source_entity_id", "event_id", "source_revision", price.alias("price"))
    own = staged.select(*at, "dedup_key", "source_entity_id", "event_id", "source_revision")
    found = []
    for rank, on in enumerate((["dedup_key"], ["source_entity_id", "event_id"], ["source_entity_id", "source_revision"])):
        other = priced.select(*at, *on, F.struct(F.lit(rank).alias("rank"), F.col("dedup_key").alias("from"), "price").alias("match"))
        found.append(own.join(other, [*at, *on]).select(*at, "dedup_key", "match"))
    best = found[0].union(found[1]).union(found[2]).groupBy(*at, "dedup_key").agg(F.min_by("match.price", F.struct("match.rank", "match.from")).alias("price"))
    names = ("estimated_cost", "pricing_status", "pricing_missing")
    return staged.join(best, [*at, "dedup_key"], "left").withColumns({n: F.when(F.col("price").isNotNull(), F.col(f"price.{n}")).otherwise(F.col(n)) for n in names}).drop("price")


def merge_staged(stored: DataFrame, staged: DataFrame, marks: DataFrame) -> DataFrame:
    """Stored events without those that the stage has under another key or has
    dropped up to the high-water revision that ``marks`` (agent_id, source_instance_id,
    source_entity_id, high_water) gives its entity, and with all staged ones."""
    at = ["agent_id", "source_instance_id", "source_entity_id"]
    left = stored
    for on in ("event_id", "source_revision"):
        # Of the stage's keys for one id the least and the greatest tell whether any differs.
        other = staged.groupBy(*at, on).agg(F.min("dedup_key").alias("__a"), F.max("dedup_key").alias("__b"))
        left = left.join(other, [*at, on], "left").where("__a is null or (__a = dedup_key and __b = dedup_key)").select(*stored.columns)
    known = staged.select(*at, "source_revision").distinct().withColumn("__known", F.lit(True))
    left = left.join(F.broadcast(marks) if marks.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS else marks, at, "left").join(known, [*at, "source_revision"], "left")
    left = left.where("high_water is null or source_revision > high_water or __known").select(*stored.columns)
    return left.join(staged.select(*EVENT_KEY), list(EVENT_KEY), "left_anti").unionByName(staged.select(*stored.columns))


def replace_instances(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Stored rows of the instances that the stage doesn't hold, and the stage."""
    at = ["agent_id", "source_instance_id"]
    return stored.join(staged.select(*at).distinct(), at, "left_anti").unionByName(staged)


def sync_names(session_rows: DataFrame, names: DataFrame) -> DataFrame:
    """Session names (key, name, name_ms) where stored ones are not newer."""
    new = names.select(*SESSION_KEY, F.col("session_name").alias("__name"), F.col("name_ms").alias("__ms"))
    newer = F.col("__ms").isNotNull() & (F.col("name_ms").isNull() | (F.col("name_ms") <= F.col("__ms")))
    joined = session_rows.join(new, list(SESSION_KEY), "left")
    return joined.withColumns({"session_name": F.when(newer, F.col("__name")).otherwise(F.col("session_name")), "name_ms": F.when(newer, F.col("__ms")).otherwise(F.col("name_ms"))}).drop("__name", "__ms")
