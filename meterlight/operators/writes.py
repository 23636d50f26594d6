"""Whole-table changes: keyed replacement, staging, clearing, compatibility, prices, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.functions.identity import canonical_models
from meterlight.operators.merge import latest
from meterlight.operators.pricing import effective, estimate
from meterlight.plans.tables import save
from meterlight.schema import EVENT_KEY, TURN_KEY, UNPRICED

AT = ["agent_id", "source_instance_id"]
ENTITY = [*AT, "source_entity_id"]
PRICE = ("estimated_cost", "pricing_status", "pricing_missing")


def upsert_tools(rows: DataFrame, order: list[str]) -> DataFrame:
    """One tool for each event and ordinal: the last to arrive."""
    return latest(rows, [*EVENT_KEY, "ordinal"], order)


def upsert_dispatches(rows: DataFrame, order: list[str]) -> DataFrame:
    """One dispatch for each id: the last to arrive."""
    return latest(rows, [*AT, "dispatch_id"], order)


def upsert_cursors(reads: DataFrame) -> DataFrame:
    """One read position for each entity from its reads (arrival, position, at_ms, error):
    that of the last success, which clears earlier errors; a failure leaves the position
    and the time of the last success, and gives the error and its time."""
    good = F.col("error").isNull()
    done = F.when(good, F.col("arrival"))
    return reads.groupBy(*ENTITY).agg(
        F.max_by("position", done).alias("position"), F.max_by("at_ms", done).alias("success_ms"),
        F.max_by(F.when(~good, F.col("error")), "arrival").alias("error"), F.max_by(F.when(~good, F.col("at_ms")), "arrival").alias("error_ms"),
    )


def staged_turns(stored: DataFrame, staged: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Turns after a stage: those of entities that the stage read again (``read``, or those
    with staged turns) are gone, and of the rest the stage's preview and origin win, with
    the earliest start and the latest end."""
    kept = stored.join((staged if read is None else read).select(*ENTITY).distinct(), ENTITY, "left_anti").withColumn("__new", F.lit(0))
    both = kept.unionByName(staged.select(*stored.columns).withColumn("__new", F.lit(1)))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__new")))
    return both.groupBy(*TURN_KEY).agg(
        F.max_by("source_entity_id", "__new").alias("source_entity_id"), F.min("start_ms").alias("start_ms"), F.max("completed_ms").alias("completed_ms"),
        newest("preview").alias("preview"), F.max("user_messages").alias("user_messages"), *[newest(c).alias(c) for c in ("prompt_origin_turn",) if c in stored.columns],
    )


def staged_children(stored: DataFrame, staged: DataFrame, key: list[str], of: DataFrame | None = None) -> DataFrame:
    """Tools of staged events, or dispatches of staged entities, in place of stored ones; ``of``
    holds the staged events or entities, where some have no children now."""
    return stored.join((staged if of is None else of).select(*key).distinct(), key, "left_anti").unionByName(staged.select(*stored.columns))


def reset_instance(rows: DataFrame, agent: str, instance: str) -> DataFrame:
    """Rows without those of one instance."""
    return rows.where(~((F.col("agent_id") == agent) & (F.col("source_instance_id") == instance)))


def clear_to_baseline(tables: dict[str, DataFrame], ends: DataFrame, agent: str | None = None) -> dict[str, DataFrame]:
    """Tables without statistics, of one agent or all; cursors stand at the ends of
    their files (entity, position), so that what was read isn't read again."""
    gone = F.lit(True) if agent is None else F.col("agent_id") == agent
    out = {name: rows.where(~gone) for name, rows in tables.items() if name != "cursors"}
    cursors = tables["cursors"]
    at_end = cursors.join(ends.select(*ENTITY, F.col("position").alias("__end")), ENTITY, "left")
    out["cursors"] = at_end.withColumn("position", F.when(gone, F.coalesce("__end", "position")).otherwise(F.col("position"))).drop("__end")
    return out


def raise_compatibility(instances: DataFrame, observed: DataFrame) -> DataFrame:
    """Instances whose level is the higher of stored and observed; the code changes
    only with the level. Of several observations the highest, then least code, counts."""
    worst = observed.groupBy(*AT).agg(F.max(F.col("level")).alias("__level"), F.min_by("code", F.struct((-F.col("level")).alias("l"), "code")).alias("__code"))
    joined = instances.join(worst, AT, "left")
    higher = F.coalesce(F.col("__level") > F.col("compatibility_level"), F.lit(False))
    return joined.withColumns({"compatibility_code": F.when(higher, F.col("__code")).otherwise(F.col("compatibility_code")), "compatibility_level": F.greatest("compatibility_level", F.coalesce("__level", "compatibility_level"))}).drop("__level", "__code")


def parser_state(events: DataFrame, cursors: DataFrame, version: str) -> DataFrame:
    """has_derived and requires_rebuild of each instance: whether it has events, and
    whether any event or cursor comes from another parser version."""
    seen = events.groupBy(*AT).agg(F.lit(True).alias("has_derived"), F.max(~F.col("parser_version").eqNullSafe(F.lit(version))).alias("a"))
    read = cursors.groupBy(*AT).agg(F.max(~F.col("parser_version").eqNullSafe(F.lit(version))).alias("b"))
    both = seen.join(read, AT, "full")
    return both.select(*AT, F.coalesce("has_derived", F.lit(False)).alias("has_derived"), (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("requires_rebuild"))


def entities_with_events(events: DataFrame, agent: str) -> DataFrame:
    return events.where(F.col("agent_id") == agent).select("source_instance_id", "source_entity_id").distinct()


def change_overrides(stored: DataFrame, put: DataFrame | None = None, restore: list[str] | None = None, restore_all: bool = False) -> DataFrame:
    """Custom rates after setting some, going back to built-in ones for some models, or
    for all. Models are keyed trimmed and lower-cased; of several rates put for a model
    the last by ``arrival`` counts."""
    key = F.lower(F.trim("model"))
    out = stored.withColumn("model", key)
    if restore_all:
        out = out.where("false")
    if restore:
        out = out.where(~F.col("model").isin([m.strip().lower() for m in restore]))
    if put is not None:
        new = latest(put.withColumn("model", key), ["model"], ["arrival"])
        out = out.join(new, "model", "left_anti").unionByName(new.select(*out.columns))
    return out


def bind_unpriced(events: DataFrame, built_in: DataFrame, overrides: DataFrame | None = None, models: list[str] | None = None) -> DataFrame:
    """Events whose unpriced ones, of some models or all, have the price that rates give
    them now. A price once bound stays, also after rates or the catalog change."""
    rates = effective(built_in, overrides).drop("rate_source")
    bare = F.col("pricing_status") == UNPRICED
    if models is not None:
        bare &= F.lower(F.trim("normalized_model")).isin([m.strip().lower() for m in models])
    new = estimate(events, rates).select(*EVENT_KEY, *[F.col(c).alias(f"__{c}") for c in PRICE])
    joined = events.join(new, list(EVENT_KEY))
    return joined.withColumns({c: F.when(F.coalesce(bare, F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in PRICE}).select(*events.columns)


def rename_models(events: DataFrame, overrides: DataFrame, global_aliases: DataFrame, market_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, overrides) under the model names of a new catalog. An override moves with
    its model if no other stands or moves there; else it stays."""
    named = canonical_models(events, global_aliases, market_aliases, model="normalized_model")
    renamed = named.withColumn("normalized_model", F.coalesce("canonical_model", "normalized_model")).select(*events.columns)
    keyed = overrides.withColumns({"agent_id": F.lit(None).cast("string"), "provider_id": F.lit(None).cast("string")})
    moved = canonical_models(keyed, global_aliases, market_aliases, model="model").drop("agent_id", "provider_id")
    aims = moved.groupBy("canonical_model").agg(F.count("*").alias("__n"))
    out = moved.join(aims, "canonical_model", "left").withColumn("model", F.when(F.col("__n") == 1, F.col("canonical_model")).otherwise(F.col("model")))
    return renamed, out.select(*overrides.columns)


def cut_cycles(edges: DataFrame) -> DataFrame:
    """``edges`` (agent_id, source_instance_id, session_id, parent_session_id, arrival) with
    relation_state and parent as they end up when edges come one by one: an edge that
    would close a cycle is uncertain and has no parent. Each session has one parent at
    most, so every cycle loses just its last edge."""
    from meterlight.operators.sessions import cycles

    on = cycles(edges)
    # Each cycle is named by its least session, found by doubling along it.
    at = AT
    ring = save(edges.join(on, [*at, "session_id"], "left_semi").select(*at, "session_id", F.col("parent_session_id").alias("up"), F.struct("arrival", "session_id").alias("last")), "ring")
    while True:
        ahead = ring.select(*at, F.col("session_id").alias("up"), F.col("up").alias("next"), F.col("last").alias("more"))
        joined = ring.join(ahead, [*at, "up"])
        now = save(joined.select(*at, "session_id", F.col("next").alias("up"), F.greatest("last", "more").alias("last"), (F.col("more") > F.col("last")).alias("grew")), "ring")
        if not now.where("grew").limit(1).count():
            break
        ring = now.drop("grew")
    cut = now.where(F.col("last.session_id") == F.col("session_id")).select(*at, "session_id", F.lit(True).alias("__cut"))
    out = edges.join(cut, [*at, "session_id"], "left")
    gone = F.coalesce("__cut", F.lit(False))
    return out.withColumns({"relation_state": F.when(gone, 2).when(F.col("parent_session_id").isNotNull(), 1).otherwise(0), "parent_session_id": F.when(~gone, F.col("parent_session_id"))}).drop("__cut")


# --- snapshots ---------------------------------------------------------------------


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Row count, and a hash of the rows that doesn't depend on their order."""
    row = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    n, a, b = rows.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit("second"), row).alias("b")).agg(F.count("*"), wide(F.col("a")), wide(F.col("b"))).head()
    return n, f"{a or 0}:{b or 0}"


def backup(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Copy tables below ``folder`` and write a manifest (name, rows, hash) last, so
    that a copy without one isn't complete. An existing backup is refused."""
    written = []
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
        written.append((name, *fingerprint(spark.read.parquet(f"{folder}/{name}"))))
    manifest = spark.createDataFrame(written, "name string, rows long, hash string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest.json")
    return manifest


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a backup; refused if one is missing or differs from the manifest."""
    manifest = spark.read.schema("name string, rows long, hash string").json(f"{folder}/manifest.json").collect()
    out = {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in manifest}
    for r in manifest:
        if fingerprint(out[r["name"]]) != (r["rows"], r["hash"]):
            raise ValueError(f"the backup's table {r['name']} differs from its manifest")
    return out


# --- catalogs --------------------------------------------------------------------------


def catalog_rates(market: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Rates by model from a market catalog of JSON lines (provider, model, input, cached,
    write, output, tiers of threshold, input and output), before those of a fallback in the same
    form. Unqualified keys come first, then by key. One context tier at most, its multipliers
    within 1 to 100; other models stay without one, and rates are 0 to 1,000,000."""
    ranked = [rows.withColumn("__rank", F.lit(i)) for i, rows in enumerate(x for x in (market, fallback) if x is not None)]
    rows = reduce(DataFrame.unionByName, ranked).withColumns({"key": F.lower(F.trim("model"))})
    rows = rows.withColumn("__name", F.substring_index("key", "/", -1)).where("input between 0 and 1000000 and output between 0 and 1000000")
    best = rows.groupBy("__name").agg(F.min_by(F.struct("input", "cached", "write", "output", "tiers"), F.struct("__rank", F.col("key").contains("/").alias("q"), "key")).alias("x")).select("__name", "x.*")
    tier = F.when(F.size("tiers") == 1, F.element_at("tiers", 1))
    ratio = lambda a, b: (a / b).cast("decimal(9,6)")
    rise: list[Column] = [F.when(F.col(c) > 0, ratio(tier[c], F.col(c))) for c in ("input", "output")]
    fits = tier.isNotNull() & rise[0].between(1, 100) & rise[1].between(1, 100)
    rate = lambda c: F.col(c).cast("decimal(18,9)")
    return best.select(
        F.col("__name").alias("model"), rate("input").alias("input_rate"), rate("cached").alias("cached_rate"), rate("write").alias("write_rate"), rate("output").alias("output_rate"),
        F.when(fits, tier["threshold"]).cast("bigint").alias("long_threshold"), F.when(fits, rise[0]).alias("long_input"), F.when(fits, rise[1]).alias("long_output"),
    )


def voted_aliases(evidence: DataFrame, least: int = 1) -> DataFrame:
    """(alias, canonical) of aliases for which ``least`` or more sources name one and the
    same model, and none another."""
    votes = evidence.select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("canonical")).alias("canonical"), "source").distinct()
    one = votes.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other"), F.count_distinct("source").alias("n"))
    return one.where((F.col("canonical") == F.col("other")) & (F.col("n") >= least) & (F.col("alias") != F.col("canonical"))).select("alias", "canonical")
