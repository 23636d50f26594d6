"""Session forests: sessions with and without rows of their own, roots and depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.plans.tables import discard, save
from meterlight.schema import MAX_DEPTH, RELATION_CONFIRMED, SESSION_KEY

KEY = list(SESSION_KEY)


def all_sessions(session_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Session rows, and the sessions that only events name (codes 0)."""
    if "relation_state" not in session_rows.columns:  # a tree made before: its links are confirmed
        session_rows = session_rows.withColumn("relation_state", F.when(F.col("depth") > 0, RELATION_CONFIRMED).otherwise(0))
    rows = session_rows.select(*KEY, "parent_session_id", "relation_state", "session_kind", "session_role")
    only = events.where("session_id is not null").select(*KEY).distinct().join(rows, KEY, "left_anti")
    zero = F.lit(0)
    return rows.unionByName(only.select(*KEY, F.lit(None).cast("string").alias("parent_session_id"), zero.alias("relation_state"), zero.alias("session_kind"), zero.alias("session_role")))


def _climb(nodes: DataFrame, top: str) -> DataFrame:
    """Follow ``top`` (with ``depth`` and ``done``) to the roots, twice as far each round."""
    at = ["agent_id", "source_instance_id"]
    reach = 1
    nodes = save(nodes, "climb")
    while reach < MAX_DEPTH and nodes.where("not done").limit(1).count():
        above = nodes.select(*at, F.col("session_id").alias(top), F.col(top).alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"))
        before = nodes
        nodes = save(
            nodes.join(above, [*at, top], "left").select(
                *KEY, F.when(F.col("done"), F.col(top)).otherwise(F.col("next")).alias(top),
                F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), (F.col("done") | F.col("end")).alias("done"),
            ),
            "climb",
        )
        discard(before)
        reach *= 2
    return nodes


def tree(session_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Each session with root_session_id and depth. A session without an existing
    confirmed parent is a root; sessions on a cycle have none and are left out."""
    every = all_sessions(session_rows, events)
    at = ["agent_id", "source_instance_id"]
    parents = every.select(*at, F.col("session_id").alias("parent_session_id"), F.lit(True).alias("exists"))
    linked = every.join(parents, [*at, "parent_session_id"], "left")
    child = F.col("exists").isNotNull() & (F.col("relation_state") == RELATION_CONFIRMED)
    nodes = linked.select(*KEY, F.when(child, F.col("parent_session_id")).otherwise(F.col("session_id")).alias("root_session_id"), child.cast("int").alias("depth"), (~child).alias("done"))
    # Done nodes point at themselves; the others at a node that is yet to climb.
    found = _climb(nodes, "root_session_id").where("done").select(*KEY, "root_session_id", "depth")
    return every.select(*KEY, "session_kind", "session_role", "parent_session_id").join(found, KEY)


def descendants(session_rows: DataFrame, events: DataFrame, root: str, agent: str | None = None, instance: str | None = None) -> DataFrame:
    """The sessions below ``root`` (itself included), in any agent and instance or in
    the given ones, also where it isn't a root; a frontier join ends at cycles."""
    every = save(all_sessions(session_rows, events), "sessions")
    first = F.col("session_id") == root
    if agent:
        first &= (F.col("agent_id") == agent) & (F.col("source_instance_id") == instance)
    found = save(every.where(first).select(*KEY), "frontier")
    frontier = found
    for _ in range(MAX_DEPTH):
        up = frontier.select("agent_id", "source_instance_id", F.col("session_id").alias("parent_session_id"))
        step = every.where(F.col("relation_state") == RELATION_CONFIRMED).join(up, ["agent_id", "source_instance_id", "parent_session_id"], "left_semi").select(*KEY)
        frontier = save(step.join(found, KEY, "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        found = save(found.union(frontier), "below")
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """Sessions (agent, instance, session_id, parent_session_id) that are their own
    ancestor. Parents are followed twice as far each round; pointers that never end
    then point at sessions on cycles, and at all of them."""
    at = ["agent_id", "source_instance_id"]
    now = save(edges.where("parent_session_id is not null").select(*at, "session_id", F.col("parent_session_id").alias("up")), "up")
    reach = 1
    while reach < MAX_DEPTH and now.limit(1).count():
        jump = now.select(*at, F.col("session_id").alias("up"), F.col("up").alias("next"))
        now = save(now.join(jump, [*at, "up"]).select(*at, "session_id", F.col("next").alias("up")), "up")
        reach *= 2
    return now.select(*at, F.col("up").alias("session_id")).distinct()
