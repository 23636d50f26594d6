"""The usage queries: totals, trends, breakdowns, sessions, projects and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlight.functions.expressions import hour_bucket, model, preferred_path, span, usage
from meterlight.functions.identity import nocase
from meterlight.operators.filters import UsageFilter
from meterlight.schema import SESSION_KEY, UNIDENTIFIED_PROJECT

ROOT = ["agent_id", "source_instance_id", "root_session_id"]


def overview(events: DataFrame, f: UsageFilter, session_rows: DataFrame | None = None) -> DataFrame:
    """One row, with nulls and zero counts where nothing matches."""
    return f.apply(events, session_rows).agg(*usage(), *span())


def trend(events: DataFrame, f: UsageFilter, session_rows: DataFrame | None = None) -> DataFrame:
    """A row for each UTC hour that has events."""
    return f.apply(events, session_rows).groupBy(hour_bucket().alias("bucket_ms")).agg(*usage()).orderBy("bucket_ms")


def recent(events: DataFrame, f: UsageFilter, session_rows: DataFrame | None = None) -> DataFrame:
    """One page of events, newest first."""
    order = [F.desc("occurred_ms"), "agent_id", "source_instance_id", "dedup_key"]
    return f.apply(events, session_rows).withColumn("model", model()).orderBy(*order).offset(f.offset).limit(f.limit)


def by(events: DataFrame, f: UsageFilter, *keys: str, session_rows: DataFrame | None = None) -> DataFrame:
    """Usage by any of agent_id and model, most tokens first."""
    out = f.apply(events, session_rows).withColumn("model", model()).groupBy(*keys).agg(*usage(), *span())
    return out.orderBy(F.desc_nulls_last("normalized_total"), *[nocase(F.col(k)) for k in keys], *keys)


def facet_agents(events: DataFrame, f: UsageFilter, session_rows: DataFrame | None = None) -> DataFrame:
    return f.apply(events, session_rows, ignore="agent").select("agent_id").distinct().orderBy(nocase(F.col("agent_id")))


def facet_models(events: DataFrame, f: UsageFilter, session_rows: DataFrame | None = None) -> DataFrame:
    return f.apply(events, session_rows, ignore="model").select(model().alias("model")).distinct().orderBy(nocase(F.col("model")))


def facet_projects(events: DataFrame, f: UsageFilter, session_rows: DataFrame | None = None) -> DataFrame:
    """Projects in the range; their paths are chosen among all events."""
    ids = f.apply(events, session_rows, ignore="project").select("project_id").distinct().where("project_id is not null")
    out = events.join(ids, "project_id", "left_semi").groupBy("project_id").agg(preferred_path().alias("path"))
    return out.orderBy(F.col("path").isNull(), nocase(F.col("path")), "project_id")


def sources(instances: DataFrame, cursors: DataFrame) -> DataFrame:
    return instances.join(cursors, ["agent_id", "source_instance_id"]).orderBy(nocase(F.col("display_name")), "agent_id", "source_instance_id", "entity_id")


def root_sessions(events: DataFrame, tree: DataFrame, f: UsageFilter) -> DataFrame:
    """Usage by root session; subagents are the side sessions other than the root."""
    side = F.when((F.col("session_id") != F.col("root_session_id")) & (F.col("session_kind") == 2), F.col("session_id"))
    joined = f.apply(events, tree).join(tree.select(*SESSION_KEY, "root_session_id", "session_kind"), list(SESSION_KEY))
    return joined.groupBy(*ROOT).agg(*usage(), *span(), F.count_distinct(side).alias("subagents"))


def page_after(rows: DataFrame, size: int, cursor: tuple[int, str, str, str] | None = None) -> DataFrame:
    """Up to ``size`` + 1 roots after the cursor (last_ms, agent, instance, root); the
    extra row tells that there are more."""
    if not 1 <= size <= 200:
        raise ValueError("a page has 1 to 200 rows")
    if cursor:
        last, *key = cursor
        names = [F.col(c) for c in ROOT]
        after = F.lit(False)
        for i in reversed(range(3)):
            after = (names[i] > key[i]) | ((names[i] == key[i]) & after)
        rows = rows.where((F.col("last_ms") < last) | ((F.col("last_ms") == last) & after))
    return rows.orderBy(F.desc("last_ms"), *ROOT).limit(size + 1)


def session_contributions(events: DataFrame, tree: DataFrame, f: UsageFilter, root: tuple[str, str, str]) -> DataFrame:
    """Usage of each session of a root; sessions without events count 0."""
    own = tree.where((F.col("agent_id") == root[0]) & (F.col("source_instance_id") == root[1]) & (F.col("root_session_id") == root[2]))
    found = f.apply(events, tree).groupBy(*SESSION_KEY).agg(*usage())
    zeros = {c: F.coalesce(c, F.lit(0)) for c in found.columns if c.rsplit("_", 1)[-1] in ("available", "unavailable", "unknown") or c in ("requests", "priced", "partly_priced", "unpriced", "missing")}
    return own.select(*SESSION_KEY, "depth").join(found, list(SESSION_KEY), "left").withColumns(zeros).orderBy("depth", "session_id")


def root_models(events: DataFrame, tree: DataFrame, f: UsageFilter, *keys: str) -> DataFrame:
    """Usage by root (and session, if named in ``keys``) and model."""
    joined = f.apply(events, tree).join(tree.select(*SESSION_KEY, "root_session_id"), list(SESSION_KEY)).withColumn("model", model())
    return joined.groupBy(*ROOT, *keys, "model").agg(*usage())


def projects(events: DataFrame, tree: DataFrame, f: UsageFilter) -> DataFrame:
    """Usage by project, those without one together, with the count of root sessions."""
    joined = f.apply(events, tree).join(tree.select(*SESSION_KEY, "root_session_id"), list(SESSION_KEY), "left")
    out = joined.groupBy("project_id").agg(preferred_path().alias("path"), *usage(), *span(), F.count_distinct(*ROOT).alias("roots"))
    return out.withColumn("project", F.coalesce("project_id", F.lit(UNIDENTIFIED_PROJECT))).drop("project_id").orderBy(F.desc("last_ms"), "project")


def turns(attributed: DataFrame, turn_rows: DataFrame, tools: DataFrame, f: UsageFilter) -> DataFrame:
    """Usage by root and prompt turn, with tools and the largest prompt of all pages."""
    per_event = tools.groupBy("agent_id", "source_instance_id", "dedup_key").agg(F.count("*").alias("tools"))
    own = f.apply(attributed).where("prompt_turn is not null").join(per_event, ["agent_id", "source_instance_id", "dedup_key"], "left")
    grouped = own.groupBy(*ROOT, "prompt_turn").agg(*usage(), *span(), F.sum(F.coalesce("tools", F.lit(0))).alias("tools"))
    rows = turn_rows.select("agent_id", "source_instance_id", F.col("session_id").alias("root_session_id"), F.col("turn_id").alias("prompt_turn"), "start_ms", "preview", "user_messages")
    out = grouped.join(rows, [*ROOT, "prompt_turn"], "left").withColumn("start_ms", F.coalesce("start_ms", "first_ms"))
    return out.withColumn("largest", F.max(F.coalesce("normalized_total", F.lit(0))).over(Window.partitionBy(*ROOT)))


def turn_coverage(attributed: DataFrame, f: UsageFilter) -> DataFrame:
    """Calls, attributed calls and prompts of each root, and a status: 1 complete,
    2 partial, 3 none attributed."""
    out = f.apply(attributed).groupBy(*ROOT).agg(F.count("*").alias("calls"), F.count("prompt_turn").alias("attributed"), F.count_distinct("prompt_turn").alias("prompts"))
    return out.withColumn("status", F.when(F.col("attributed") == F.col("calls"), 1).when(F.col("attributed") == 0, 3).otherwise(2))


def unattributed(attributed: DataFrame, f: UsageFilter) -> DataFrame:
    return f.apply(attributed).where("prompt_turn is null").groupBy(*ROOT).agg(*usage())


def turn_calls(attributed: DataFrame, tools: DataFrame, f: UsageFilter) -> DataFrame:
    """The calls of prompt turns, each with its tools in order."""
    listed = tools.groupBy("agent_id", "source_instance_id", "dedup_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tool_name"))).alias("t"))
    calls = f.apply(attributed).where("prompt_turn is not null").join(listed, ["agent_id", "source_instance_id", "dedup_key"], "left")
    return calls.withColumns({"tools": F.coalesce(F.col("t.tool_name"), F.array().cast("array<string>")), "model": model()}).drop("t")


def turn_coverage_overall(attributed: DataFrame, f: UsageFilter) -> DataFrame:
    """One row over all roots of the filter; status 0 where there is no call."""
    out = f.apply(attributed).agg(F.count("*").alias("calls"), F.count("prompt_turn").alias("attributed"), F.count_distinct(*ROOT, "prompt_turn").alias("prompts"))
    return out.withColumn("status", F.when(F.col("calls") == 0, 0).when(F.col("attributed") == F.col("calls"), 1).when(F.col("attributed") == 0, 3).otherwise(2))


def root_detail(events: DataFrame, session_rows: DataFrame, tree: DataFrame, f: UsageFilter, root: tuple[str, str, str]) -> dict[str, DataFrame]:
    """The root's own row (none if it has no events), its sessions, their models and the
    models of all of them, as tables of one root."""
    own = (F.col("agent_id") == root[0]) & (F.col("source_instance_id") == root[1]) & (F.col("root_session_id") == root[2])
    below = tree.where(own)
    found = events.join(below.select(*SESSION_KEY), list(SESSION_KEY), "left_semi")
    return {
        "root": root_sessions(found, below, f),
        "sessions": session_contributions(found, below, f, root),
        "session_models": root_models(found, below, f, "session_id"),
        "models": root_models(found, below, f).orderBy(F.desc(F.coalesce("normalized_total", F.lit(0))), nocase(F.col("model")), "model"),
    }
