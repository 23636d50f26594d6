"""The queries by name, over the projected tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.functions import expressions as E
from meterlight.operators import attribution, derive, merge, pricing, sessions, usage, writes
from meterlight.operators.filters import UsageFilter
from meterlight.plans.tables import save
from meterlight.schema import EVENT_KEY, METRICS, SESSION_KEY
from meterlight.sources import projection

Query = Callable[[SparkSession, str], DataFrame]
ALL = UsageFilter(datetime(1970, 1, 1, tzinfo=UTC), datetime(2100, 1, 1, tzinfo=UTC))
TWO_YEARS = UsageFilter(datetime(1996, 1, 1, tzinfo=UTC), datetime(1998, 1, 1, tzinfo=UTC))
EMPTY = UsageFilter(datetime(1980, 1, 1, tzinfo=UTC), datetime(1981, 1, 1, tzinfo=UTC))
ZONE = "America/New_York"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- SQL of the projected tables ---------------------------------------------

_B = "(k // 64)"
_IN, _OUT = "q * 1000 + p % 997", "q * 37 + s % 11"
_VALUES = {
    "input_reported": _IN, "uncached_input": f"({_IN}) - ({_IN}) * (s % 4) // 8", "cache_read": f"({_IN}) * (s % 4) // 8", "cache_write": "p % 50", "output": _OUT, "reasoning": f"({_OUT}) // 4", "tool": "s % 3",
    "reported_total": f"({_IN}) + ({_OUT})", "normalized_total": f"({_IN}) + ({_OUT})",
}
_METRIC_COLUMNS = ", ".join(
    f"CASE WHEN (k + n + {i}) % 13 = 0 OR (k + n + {i}) % 17 = 0 THEN NULL ELSE {_VALUES[m]} END AS {m}_value, CASE WHEN (k + n + {i}) % 13 = 0 THEN 0 WHEN (k + n + {i}) % 17 = 0 THEN 6 ELSE 1 END AS {m}_origin"
    for i, m in enumerate(METRICS)
)
RAW = f"""raw AS (SELECT 'agent-' || ({_B} % 5) AS agent_id, 'agent-' || ({_B} % 5) || ':' || ({_B} % 3) AS source_instance_id, 's' || k AS session_id, 't' || k || ':' || (n // 3) AS turn_id, k || ':' || n AS dedup_key,
  'e' || {_B} AS source_entity_id, 'v' || k || ':' || (n % 3) || ':' || p AS event_id, p AS source_revision, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS completion_state,
  CASE WHEN {_B} % 6 = 0 THEN NULL ELSE 'p' || ({_B} % 12) END AS project_id,
  CASE WHEN {_B} % 6 = 0 THEN NULL WHEN k % 3 = 0 THEN '/work/p' || ({_B} % 12) WHEN k % 3 = 1 THEN 'C:\\work\\p' || ({_B} % 12) ELSE 'C:\\u\\.codex\\worktrees\\p' || ({_B} % 12) END AS project_path,
  day_ms + n * 3600000 + (p % 3600) * 1000 AS occurred_ms, CASE WHEN p_size % 17 = 0 THEN NULL ELSE lower(brand) END AS normalized_model, k, n, p, s, cents, {_METRIC_COLUMNS}
  FROM (SELECT l_orderkey k, CAST(l_linenumber AS BIGINT) n, CAST(l_quantity AS BIGINT) q, l_partkey p, l_suppkey s, CAST(round(l_extendedprice * 100) AS BIGINT) cents, l_returnflag flag, epoch_ms(l_shipdate) day_ms, p_brand brand, p_size
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey))"""
_UNC = "coalesce(uncached_input_value, CASE WHEN cache_read_value IS NOT NULL AND input_reported_value IS NOT NULL THEN greatest(0, input_reported_value - cache_read_value) END)"
_CAC = "coalesce(cache_read_value, CASE WHEN uncached_input_value IS NOT NULL AND input_reported_value IS NOT NULL THEN greatest(0, input_reported_value - uncached_input_value) END)"


def priced(table: str) -> str:
    """SQL that prices a table in millionths of a millionth of a dollar."""
    long = "(id % 3 = 0 AND coalesce(input_reported_value > 20000, false))"
    return f"""SELECT * EXCLUDE (u, id, unc, cac), CASE WHEN u IS NULL THEN NULL ELSE (CASE WHEN {long} THEN 2 ELSE 1 END) * u * (coalesce(unc * 100000, 0) + CASE WHEN id % 4 = 0 THEN 0 ELSE coalesce(cac * 10000, 0) END + CASE WHEN id % 5 = 0 THEN 0 ELSE coalesce(cache_write_value * 125000, 0) END)
   + (CASE WHEN {long} THEN 750000 ELSE 500000 END) * u * coalesce(output_value, 0) END AS pico,
  CASE WHEN u IS NULL THEN 1 ELSE (CASE WHEN id % 3 = 0 AND input_reported_value IS NULL THEN 128 ELSE 0 END) + (CASE WHEN unc IS NULL THEN 2 ELSE 0 END) + (CASE WHEN cac IS NULL THEN 4 ELSE 0 END) + (CASE WHEN cac <> 0 AND id % 4 = 0 THEN 8 ELSE 0 END)
   + (CASE WHEN id % 5 <> 0 AND cache_write_value IS NULL THEN 16 ELSE 0 END) + (CASE WHEN id % 5 = 0 AND cache_write_value > 0 THEN 32 ELSE 0 END) + (CASE WHEN output_value IS NULL THEN 64 ELSE 0 END) END AS pricing_missing,
  CASE WHEN u IS NULL THEN 0 WHEN pricing_missing = 0 THEN 1 ELSE 2 END AS pricing_status
  FROM (SELECT t.*, r.u, r.id, {_UNC} unc, {_CAC} cac FROM {table} t LEFT JOIN rate r ON t.normalized_model = r.model)"""


RATE = "rate AS (SELECT 'brand#' || (id // 5 + 1) || (id % 5 + 1) AS model, id + 1 AS u, id FROM range(25) x(id) WHERE id % 8 <> 7)"
EV = f"{RAW}, {RATE}, one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY agent_id, source_instance_id, dedup_key ORDER BY completion_state DESC, source_revision DESC, p, s, cents) = 1), ev AS ({priced('one')})"
_P = "(k % 64 > 0 AND k % 7 <> 0)"
SESS = f"""sess AS (SELECT 'agent-' || ({_B} % 5) AS agent_id, 'agent-' || ({_B} % 5) || ':' || ({_B} % 3) AS source_instance_id, 's' || k AS session_id, CASE WHEN {_P} THEN 's' || (k - k % 64 + (k % 64 - 1) // 3) END AS parent_session_id,
  CAST({_P} AS INT) AS relation_state, CAST({_P} AS INT) + 1 AS session_kind, CAST(k % 4 AS INT) AS session_role, CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END AS relation_origin, k FROM (SELECT o_orderkey k FROM orders) WHERE k % 11 <> 0)"""
TREE = f"""{SESS}, every_one AS (SELECT agent_id, source_instance_id, session_id, parent_session_id, relation_state, session_kind, session_role FROM sess UNION ALL
  SELECT DISTINCT agent_id, source_instance_id, session_id, NULL, 0, 0, 0 FROM ev WHERE NOT EXISTS (SELECT 1 FROM sess WHERE sess.session_id = ev.session_id)),
tree AS (WITH RECURSIVE t AS (SELECT a.*, a.session_id AS root_session_id, 0 AS depth FROM every_one a WHERE NOT (relation_state = 1 AND EXISTS (SELECT 1 FROM every_one b WHERE b.agent_id = a.agent_id AND b.source_instance_id = a.source_instance_id AND b.session_id = a.parent_session_id))
  UNION ALL SELECT c.*, t.root_session_id, t.depth + 1 FROM every_one c JOIN t ON c.agent_id = t.agent_id AND c.source_instance_id = t.source_instance_id AND c.parent_session_id = t.session_id WHERE c.relation_state = 1) SELECT * FROM t)"""
TURNS = """turn AS (SELECT *, CASE WHEN o % 10 = 3 THEN NULL ELSE last + 1728000000 END AS completed_ms, CASE WHEN i > 0 AND o % 5 = 0 THEN 't' || o || ':' || (i - 1) END AS prompt_origin_turn FROM (
  SELECT agent_id, source_instance_id, session_id, turn_id, min(occurred_ms) AS start_ms, max(occurred_ms) AS last, count(*) AS user_messages, min(k) AS o, min(n // 3) AS i FROM ev GROUP BY ALL))"""
TOOLS = "tool AS (SELECT agent_id, source_instance_id, dedup_key, ordinal, 'tool' || ((s + ordinal * ordinal) % 3) AS tool_name FROM (SELECT agent_id, source_instance_id, dedup_key, s, unnest(range(1, s % 4 + 1)) AS ordinal FROM ev))"
ATTR = f"""{TURNS}, first_turn AS (SELECT t.agent_id, t.source_instance_id, s.parent_session_id AS src, 't' || substr(s.parent_session_id, 2) || ':0' AS src_turn, t.i AS kind, t.session_id AS child, t.start_ms - 1000 * (t.o % 3) AS at, t.o FROM turn t JOIN sess s USING (agent_id, source_instance_id, session_id) WHERE s.parent_session_id IS NOT NULL AND t.i < 2),
disp AS (SELECT * FROM first_turn UNION ALL SELECT * FROM first_turn WHERE o % 9 = 0 AND kind = 0),
ts AS (SELECT t.*, s.parent_session_id, s.relation_state = 1 AS conf, s.session_role, s.relation_origin, row_number() OVER w - 1 AS num, lag(coalesce(completed_ms, start_ms)) OVER w AS low FROM turn t JOIN sess s USING (agent_id, source_instance_id, session_id) WINDOW w AS (PARTITION BY agent_id, source_instance_id, session_id ORDER BY start_ms, turn_id)),
e_sent AS (SELECT ts.session_id, ts.turn_id, min(d.src) AS us, min(d.src_turn) AS ut, 1 + min(d.kind) AS origin FROM ts JOIN disp d ON d.agent_id = ts.agent_id AND d.source_instance_id = ts.source_instance_id AND d.src = ts.parent_session_id AND d.child = ts.session_id AND d.kind = CASE WHEN ts.num = 0 THEN 0 ELSE 1 END
  WHERE conf AND session_role = 2 AND ts.prompt_origin_turn IS NULL AND d.at <= ts.start_ms AND (ts.num = 0 OR d.at >= ts.low) GROUP BY ALL HAVING count(*) = 1),
e_held AS (SELECT ts.session_id, ts.turn_id, min(p.session_id) AS us, min(p.turn_id) AS ut, CASE WHEN min(ts.session_role) = 3 THEN 3 ELSE 4 END AS origin FROM ts JOIN turn p ON p.agent_id = ts.agent_id AND p.source_instance_id = ts.source_instance_id AND p.session_id = ts.parent_session_id AND p.start_ms <= ts.start_ms AND ts.start_ms <= p.completed_ms
  WHERE conf AND ts.prompt_origin_turn IS NULL AND (session_role = 3 OR session_role = 2 AND relation_origin = 4 AND NOT EXISTS (SELECT 1 FROM e_sent x WHERE x.turn_id = ts.turn_id)) GROUP BY ts.session_id, ts.turn_id HAVING count(*) = 1),
edge AS (SELECT session_id, turn_id, us, ut, origin FROM e_sent UNION ALL SELECT session_id, turn_id, us, ut, origin FROM e_held
  UNION ALL SELECT ts.session_id, ts.turn_id, ts.session_id, ts.prompt_origin_turn, 5 FROM ts JOIN turn o ON o.turn_id = ts.prompt_origin_turn WHERE ts.prompt_origin_turn <> ts.turn_id),
chain AS (WITH RECURSIVE c AS (SELECT session_id, turn_id, session_id AS os, turn_id AS ot, 0 AS origin FROM ts WHERE NOT conf AND prompt_origin_turn IS NULL
  UNION ALL SELECT e.session_id, e.turn_id, c.os, c.ot, e.origin FROM edge e JOIN c ON e.us = c.session_id AND e.ut = c.turn_id) SELECT * FROM c),
attr AS (SELECT t.agent_id, t.source_instance_id, t.session_id, t.turn_id, c.os AS origin_session_id, c.ot AS origin_turn_id, c.origin, CASE WHEN c.ot IS NULL THEN 1 ELSE 0 END AS state FROM turn t LEFT JOIN chain c USING (session_id, turn_id)),
at_ev AS (SELECT ev.*, tree.root_session_id, tree.depth, tree.session_kind, tree.session_role, CASE WHEN attr.state = 0 AND attr.origin_session_id = tree.root_session_id THEN attr.origin_turn_id WHEN ev.session_id = tree.root_session_id THEN ev.turn_id END AS prompt_turn
  FROM ev JOIN tree USING (agent_id, source_instance_id, session_id) LEFT JOIN attr USING (agent_id, source_instance_id, session_id, turn_id))"""
U = "count(*) AS requests, " + ", ".join(f"CAST(sum({m}_value) AS BIGINT) AS {m}, count({m}_value) AS {m}_available, count(*) FILTER ({m}_value IS NULL AND {m}_origin = 0) AS {m}_unavailable, count(*) FILTER ({m}_value IS NULL AND {m}_origin = 6) AS {m}_unknown" for m in METRICS) + (
    ", CAST(sum(pico) FILTER (pricing_status IN (1, 2)) AS BIGINT) AS cost, count(*) FILTER (pricing_status = 1) AS priced, count(*) FILTER (pricing_status = 2) AS partly_priced, count(*) FILTER (pricing_status = 0) AS unpriced, coalesce(bit_or(pricing_missing), 0) AS missing"
)
SPAN = "min(occurred_ms) AS first_ms, max(occurred_ms) AS last_ms"
IN = "occurred_ms >= 820454400000 AND occurred_ms < 883612800000"
MODEL = "coalesce(normalized_model, '未知模型')"
PATH = r"coalesce(max(project_path) FILTER (NOT contains(lower(replace(project_path, '/', '\')), '\.codex\worktrees\')), max(project_path))"
KEYS = "agent_id, source_instance_id, session_id"
ROOT = "agent_id, source_instance_id, root_session_id"


def pico(df: DataFrame) -> DataFrame:
    """Costs as whole millionths of a millionth of a dollar."""
    names = [c for c in df.columns if c in ("cost", "estimated_cost")]
    return df.withColumns({c: (F.col(c) * 1_000_000_000_000).cast("bigint") for c in names}) if names else df


def query(sql: str | None = None, stored: bool = False) -> Callable[[Callable], Callable]:
    """Register a query and its SQL; ``stored`` if it reads merged events more than once."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: pico(f(projection.load(spark, sf_dir, stored)))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _tree(m: projection.Model) -> DataFrame:
    # Merging events changes no session's name, so the arrivals tell which there are.
    return sessions.tree(m.sessions, m.raw)


def _attributed(m: projection.Model) -> DataFrame:
    turn_rows = save(m.turns, "turn_rows")
    known = attribution.attribute(turn_rows, m.sessions, projection.dispatches(turn_rows, m.sessions))
    return attribution.attributed(m.events, _tree(m), known)


# --- totals and breakdowns ----------------------------------------------------


@query(f"WITH {EV} SELECT {U}, {SPAN} FROM ev WHERE {IN}")
def overview(m):
    return usage.overview(m.events, TWO_YEARS)


@query(f"WITH {EV} SELECT {U}, {SPAN} FROM ev WHERE occurred_ms < 0")
def overview_empty_range(m):
    return usage.overview(m.events, EMPTY)


@query(f"WITH {EV} SELECT (occurred_ms // 3600000) * 3600000 AS bucket_ms, {U} FROM ev WHERE {IN} GROUP BY 1")
def trend_hourly(m):
    return usage.trend(m.events, TWO_YEARS)


@query(f"WITH {EV} SELECT agent_id, source_instance_id, dedup_key, occurred_ms, {MODEL} AS model, normalized_total_value, pico AS estimated_cost FROM ev WHERE {IN} ORDER BY occurred_ms DESC, agent_id, source_instance_id, dedup_key LIMIT 200 OFFSET 100")
def recent_records(m):
    return usage.recent(m.events, replace(TWO_YEARS, offset=100)).select("agent_id", "source_instance_id", "dedup_key", "occurred_ms", "model", "normalized_total_value", "estimated_cost")


@query(f"WITH {EV} SELECT {MODEL} AS model, {U}, {SPAN} FROM ev WHERE {IN} GROUP BY 1")
def models(m):
    return usage.by(m.events, TWO_YEARS, "model")


@query(f"WITH {EV} SELECT agent_id, {U}, {SPAN} FROM ev WHERE {IN} GROUP BY 1")
def agents(m):
    return usage.by(m.events, TWO_YEARS, "agent_id")


@query(f"WITH {EV} SELECT agent_id, {MODEL} AS model, {U}, {SPAN} FROM ev WHERE {IN} GROUP BY 1, 2")
def agent_models(m):
    return usage.by(m.events, TWO_YEARS, "agent_id", "model")


@query(
    f"WITH {EV} SELECT session_id, CASE WHEN count(tool_value) > 0 THEN CASE WHEN count(tool_value) < count(*) THEN 2 ELSE 1 END WHEN count_if(tool_origin = 6) > 0 THEN 3 WHEN count_if(tool_origin = 0) > 0 THEN 4 ELSE 0 END AS tool_coverage, "
    "CASE WHEN count_if(pricing_status = 0) = count(*) THEN 3 WHEN count_if(pricing_status <> 1) > 0 THEN 2 ELSE 1 END AS price_coverage FROM ev GROUP BY 1"
)
def coverage_status(m):
    rows = m.events.groupBy("session_id").agg(*E.usage())
    return rows.select("session_id", E.coverage("tool").alias("tool_coverage"), E.pricing_coverage().alias("price_coverage"))


@query(f"WITH {EV} SELECT DISTINCT agent_id FROM ev WHERE {IN} AND {MODEL} = 'brand#11'")
def facet_agents(m):
    return usage.facet_agents(m.events, replace(TWO_YEARS, agent="agent-1", model="brand#11"))


@query(f"WITH {EV} SELECT DISTINCT {MODEL} AS model FROM ev WHERE {IN} AND agent_id = 'agent-1' AND project_id IS NULL")
def facet_models(m):
    return usage.facet_models(m.events, replace(TWO_YEARS, agent="agent-1", model="brand#11", unidentified_project=True))


@query(f"WITH {EV} SELECT project_id, {PATH} AS path FROM ev WHERE project_id IN (SELECT project_id FROM ev WHERE {IN} AND agent_id = 'agent-1') GROUP BY 1")
def facet_projects(m):
    return usage.facet_projects(m.events, replace(TWO_YEARS, agent="agent-1", project="p1"))


@query(f"WITH {EV} SELECT agent_id, source_instance_id, upper(source_instance_id) AS display_name, source_entity_id AS entity_id, max(source_revision) AS revision FROM ev GROUP BY 1, 2, 3, 4")
def sources(m):
    instances = m.events.groupBy("agent_id", "source_instance_id").agg(F.upper("source_instance_id").alias("display_name"))
    return usage.sources(instances, m.events.groupBy("agent_id", "source_instance_id", F.col("source_entity_id").alias("entity_id")).agg(F.max("source_revision").alias("revision")))


def _overrides(m):
    return m.rates.where("model in ('brand#11', 'brand#22')").withColumn("input_rate", F.lit(9).cast("decimal(18,9)")).unionByName(m.rates.where("model = 'brand#12'").withColumn("model", F.lit(" My-Model ")))


@query(
    f"WITH {EV}, seen AS (SELECT normalized_model AS model, count(*) AS observed FROM ev WHERE normalized_model IS NOT NULL GROUP BY 1), asked AS (SELECT unnest(['brand#11', 'brand#22', 'my-model']) AS model) "
    "SELECT model, coalesce(observed, 0) AS observed, CAST(round(CASE WHEN model IN ('brand#11', 'brand#22') THEN 9 WHEN model = 'my-model' THEN 0.2 ELSE u / 10.0 END * 1000) AS BIGINT) AS input_milli, CASE WHEN asked.model IS NOT NULL THEN 1 WHEN u IS NOT NULL THEN 0 ELSE 2 END AS source "
    "FROM seen FULL JOIN asked USING (model) LEFT JOIN rate USING (model)"
)
def price_settings(m):
    out = pricing.settings(m.events, m.rates, _overrides(m))
    return out.select("model", "observed", (F.col("input_rate") * 1000).cast("bigint").alias("input_milli"), "source")


# --- sessions and projects ----------------------------------------------------


@query(f"WITH {EV}, {TREE} SELECT {KEYS}, root_session_id, depth, session_kind, session_role, parent_session_id FROM tree")
def session_tree(m):
    return _tree(m)


@query(f"WITH {EV}, {TREE}, below AS (WITH RECURSIVE d AS (SELECT {KEYS} FROM every_one WHERE session_id = 's1' UNION SELECT c.agent_id, c.source_instance_id, c.session_id FROM every_one c JOIN d ON c.agent_id = d.agent_id AND c.source_instance_id = d.source_instance_id AND c.parent_session_id = d.session_id AND c.relation_state = 1) SELECT * FROM d) SELECT * FROM below")
def descendants(m):
    return sessions.descendants(m.sessions, m.events, "s1")


@query(f"WITH {EV}, {TREE} SELECT {U}, {SPAN} FROM ev WHERE {IN} AND session_id IN (SELECT session_id FROM tree WHERE root_session_id = 's64' AND agent_id = 'agent-1')")
def filter_root_subtree(m):
    f = replace(TWO_YEARS, root_agent="agent-1", root_instance="agent-1:1", root_session="s64")
    return f.apply(m.events, m.sessions).agg(*E.usage(), *E.span())


ROOTS = f"roots AS (SELECT {ROOT}, {U}, {SPAN}, count(DISTINCT CASE WHEN session_id <> root_session_id AND session_kind = 2 THEN session_id END) AS subagents FROM (SELECT ev.*, root_session_id, session_kind FROM ev JOIN tree USING ({KEYS}) WHERE {IN}) GROUP BY {ROOT})"


@query(f"WITH {EV}, {TREE}, {ROOTS} SELECT * FROM roots")
def root_sessions(m):
    return usage.root_sessions(m.events, _tree(m), TWO_YEARS)


@query(f"WITH {EV}, {TREE}, {ROOTS} SELECT {ROOT}, requests, last_ms FROM roots WHERE last_ms < 870000000000 OR last_ms = 870000000000 AND (agent_id, source_instance_id, root_session_id) > ('agent-1', 'agent-1:1', 's64') ORDER BY last_ms DESC, {ROOT} LIMIT 51")
def root_sessions_page2(m):
    rows = usage.root_sessions(m.events, _tree(m), TWO_YEARS)
    return usage.page_after(rows, 50, (870000000000, "agent-1", "agent-1:1", "s64")).select("agent_id", "source_instance_id", "root_session_id", "requests", "last_ms")


@query(f"WITH {EV}, {TREE} SELECT t.session_id, t.depth, count(ev.dedup_key) AS requests, CAST(sum(normalized_total_value) AS BIGINT) AS normalized_total FROM tree t LEFT JOIN ev ON ev.session_id = t.session_id AND {IN} WHERE root_session_id = 's64' GROUP BY 1, 2")
def session_contributions(m):
    return usage.session_contributions(m.events, _tree(m), TWO_YEARS, ("agent-1", "agent-1:1", "s64")).select("session_id", "depth", "requests", "normalized_total")


@query(f"WITH {EV}, {TREE} SELECT {ROOT}, session_id, {MODEL} AS model, {U} FROM (SELECT ev.*, root_session_id FROM ev JOIN tree USING ({KEYS}) WHERE {IN}) GROUP BY ALL")
def session_models(m):
    return usage.root_models(m.events, _tree(m), TWO_YEARS, "session_id")


@query(f"WITH {EV}, {TREE} SELECT {ROOT}, {MODEL} AS model, {U} FROM (SELECT ev.*, root_session_id FROM ev JOIN tree USING ({KEYS}) WHERE {IN}) GROUP BY ALL")
def root_models(m):
    return usage.root_models(m.events, _tree(m), TWO_YEARS)


PROJECTS = f"prj AS (SELECT coalesce(project_id, '__unidentified_project__') AS project, {PATH} AS path, {U}, {SPAN}, count(DISTINCT agent_id || chr(31) || source_instance_id || chr(31) || root_session_id) AS roots FROM (SELECT ev.*, root_session_id FROM ev LEFT JOIN tree USING ({KEYS}) WHERE {IN}) GROUP BY project_id)"


@query(f"WITH {EV}, {TREE}, {PROJECTS} SELECT * FROM prj")
def projects(m):
    return usage.projects(m.events, _tree(m), TWO_YEARS)


@query(f"WITH {EV}, {TREE}, {PROJECTS} SELECT project, path, requests FROM prj WHERE contains(lower(project), 'p1') OR contains(lower(coalesce(path, '')), 'p1')")
def project_search(m):
    return derive.search(usage.projects(m.events, _tree(m), TWO_YEARS), "P1").select("project", "path", "requests")


# --- merges and prices ----------------------------------------------------------


@query(f"WITH {EV} SELECT agent_id, source_instance_id, dedup_key, completion_state, source_revision, occurred_ms, output_value, output_origin FROM one")
def event_upsert(m):
    return merge.upsert_events(m.raw, projection.ARRIVAL).select(*EVENT_KEY, "completion_state", "source_revision", "occurred_ms", "output_value", "output_origin")


@query(f"WITH {EV} SELECT agent_id, source_instance_id, dedup_key, pico AS estimated_cost, pricing_status, pricing_missing FROM ev")
def price_estimate(m):
    return m.events.select(*EVENT_KEY, "estimated_cost", "pricing_status", "pricing_missing")


@query(f"WITH {EV}, pr AS ({priced('raw')}) SELECT agent_id, source_instance_id, dedup_key, pico AS estimated_cost, pricing_status, pricing_missing FROM pr QUALIFY row_number() OVER (PARTITION BY agent_id, source_instance_id, dedup_key ORDER BY pricing_status = 0, p, s, cents) = 1")
def price_frozen(m):
    return pricing.frozen(m.raw, m.rates, list(EVENT_KEY), projection.ARRIVAL)


@query(f"WITH {EV} SELECT DISTINCT CASE WHEN x.i = 0 THEN model ELSE 'alias ' || model END AS model, CASE WHEN id < 10 THEN 1 ELSE 2 END * CAST(u AS BIGINT) * 100 AS input_milli FROM ev JOIN rate ON model = normalized_model, range(2) x(i)")
def price_layering(m):
    """Rates of the models that events have; later ones from upstream, and an alias of each."""
    used = m.events.select(F.col("normalized_model").alias("model")).distinct()
    mine = m.rates.join(used, "model", "left_semi")
    first = mine.where("model < 'brand#31'")
    upstream = mine.withColumn("input_rate", (F.col("input_rate") * 2).cast("decimal(18,9)"))
    aliases = used.where("model is not null").select(F.concat(F.lit("alias "), "model").alias("alias"), F.col("model").alias("priced_as"))
    return pricing.layered(first, upstream, aliases).select("model", (F.col("input_rate") * 1000).cast("bigint").alias("input_milli"))


OBSERVED = "obs AS (SELECT agent_id, source_instance_id, session_id, turn_id, CAST(p % 3 AS INT) AS session_kind, CASE WHEN p % 5 > 0 THEN 's' || (k - CASE WHEN k % 13 = 0 THEN p % 2 ELSE 0 END + 1) END AS parent_session_id, CASE WHEN p % 5 > 0 THEN 1 ELSE 0 END AS relation_state, CAST(p % 2 AS INT) AS compatibility, CAST(p % 4 AS INT) AS session_role, CASE WHEN p % 3 > 0 THEN 'p' || p END AS project_id, CASE WHEN p % 4 > 0 THEN 'name ' || p END AS session_name, p // 7 AS name_ms, occurred_ms AS ms, p * 10 + n AS arrival, p FROM raw)"


def _observed(m):
    k, p = "cast(substring(session_id, 2) as bigint)", "source_revision"
    return m.raw.selectExpr(
        "agent_id", "source_instance_id", "session_id", "turn_id", f"cast({p} % 3 as int) session_kind", f"case when {p} % 5 > 0 then concat('s', {k} - case when {k} % 13 = 0 then {p} % 2 else 0 end + 1) end parent_session_id",
        f"cast({p} % 5 > 0 as int) relation_state", f"cast({p} % 2 as int) compatibility", f"cast({p} % 4 as int) session_role", f"case when {p} % 3 > 0 then concat('p', {p}) end project_id",
        f"case when {p} % 4 > 0 then concat('name ', {p}) end session_name", f"{p} div 7 name_ms", "occurred_ms first_ms", "occurred_ms last_ms", f"{p} * 10 + cast(split_part(dedup_key, ':', 2) as bigint) arrival",
    )


@query(
    f"WITH {EV}, {OBSERVED}, g AS (SELECT {KEYS}, max(session_kind) AS session_kind, min(parent_session_id) AS a, max(parent_session_id) AS b, max(compatibility) AS c, arg_max(session_role, arrival) FILTER (session_role <> 0) AS r, arg_max(project_id, arrival) FILTER (project_id IS NOT NULL) AS project_id, "
    f"arg_max(session_name, name_ms * 1000000 + arrival) FILTER (session_name IS NOT NULL) AS session_name, min(ms) AS first_ms, max(ms) AS last_ms FROM obs GROUP BY {KEYS}) "
    f"SELECT {KEYS}, session_kind, CASE WHEN a <> b THEN NULL ELSE a END AS parent_session_id, CASE WHEN a <> b THEN 2 WHEN a IS NULL THEN 0 ELSE 1 END AS relation_state, CASE WHEN a <> b THEN 1 ELSE c END AS compatibility, coalesce(r, 0) AS session_role, project_id, session_name, first_ms, last_ms FROM g"
)
def session_merge(m):
    return merge.merge_sessions(_observed(m)).drop("name_ms")


@query(
    f"WITH {EV}, {OBSERVED} SELECT {KEYS}, turn_id, min(ms) AS start_ms, max(CASE WHEN p % 2 = 0 THEN ms END) AS completed_ms, arg_min(session_name, arrival) FILTER (session_name IS NOT NULL) AS preview, max(session_role) AS user_messages, arg_max(project_id, arrival) FILTER (project_id IS NOT NULL) AS prompt_origin_turn FROM obs GROUP BY {KEYS}, turn_id"
)
def turn_merge(m):
    seen = _observed(m).selectExpr(*SESSION_KEY, "turn_id", "first_ms start_ms", "case when compatibility = 0 then first_ms end completed_ms", "session_name preview", "session_role user_messages", "project_id prompt_origin_turn", "arrival")
    return merge.merge_turns(seen)


@query(f"WITH {EV} SELECT agent_id, source_instance_id, event_id, max(p) AS p FROM raw GROUP BY 1, 2, 3")
def tool_dedup(m):
    return merge.latest(m.raw, ["agent_id", "source_instance_id", "event_id"], projection.ARRIVAL).select("agent_id", "source_instance_id", "event_id", F.col("arrival_p").alias("p"))


def _looped(m):
    """An edge for the session of each order; four of every ten keys make a cycle."""
    up = "case when k % 10 < 4 then k - k % 10 + (k % 10 + 1) % 4 else k - 1 end"
    return m.orders.selectExpr("'a' agent_id", "'i' source_instance_id", "concat('s', k) session_id", f"concat('s', {up}) parent_session_id", "k")


LOOPED = "e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 4 THEN o_orderkey - o_orderkey % 10 + (o_orderkey % 10 + 1) % 4 ELSE o_orderkey - 1 END AS up FROM orders), ring AS (SELECT a.k FROM e a JOIN e b ON b.k = a.up JOIN e c ON c.k = b.up JOIN e d ON d.k = c.up WHERE d.up = a.k)"


@query(f"WITH {LOOPED} SELECT 'a' AS agent_id, 'i' AS source_instance_id, 's' || k AS session_id FROM ring")
def session_cycles(m):
    """Of every session; by the way that edges are made, cycles have four."""
    return sessions.cycles(_looped(m))


@query(f"WITH {LOOPED} SELECT 's' || e.k AS session_id, CASE WHEN ring.k IS NOT NULL AND e.k % 10 = 2 THEN NULL ELSE 's' || up END AS parent_session_id, CASE WHEN ring.k IS NOT NULL AND e.k % 10 = 2 THEN 2 ELSE 1 END AS relation_state FROM e LEFT JOIN ring USING (k)")
def cycle_cut(m):
    """The edge of a cycle that came last, that of its third session, is cut."""
    return writes.cut_cycles(_looped(m).withColumn("arrival", F.expr("k % 10 * 3 % 7"))).select("session_id", "parent_session_id", "relation_state")


HASHES = "hs AS (SELECT dedup_key, agent_id, source_instance_id, project_path, project_id, CASE WHEN k % 5 = 0 THEN sha256('repo' || (k // 64 % 12)) WHEN k % 50 = 1 AND k // 64 % 12 = 7 THEN sha256('other') END AS repository_hash FROM ev)"


@query(
    f"WITH {EV}, {HASHES}, good AS (SELECT lower(project_path) AS path, min(repository_hash) AS h FROM hs WHERE repository_hash IS NOT NULL AND project_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repository_hash) = 1) "
    "SELECT agent_id, source_instance_id, dedup_key, CASE WHEN h IS NOT NULL AND (repository_hash IS NULL OR repository_hash = h) THEN substr(h, 1, 24) ELSE project_id END AS project_id FROM hs LEFT JOIN good ON lower(project_path) = path"
)
def project_reconcile(m):
    k = "cast(substring(session_id, 2) as bigint)"
    rows = m.events.withColumn("repository_hash", F.expr(f"case when {k} % 5 = 0 then sha2(concat('repo', {k} div 64 % 12), 256) when {k} % 50 = 1 and {k} div 64 % 12 = 7 then sha2('other', 256) end"))
    return merge.reconcile_projects(rows).select(*EVENT_KEY, "project_id")


STAGED = "staged AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN dedup_key ELSE 'new:' || dedup_key END AS dedup_key) FROM ev WHERE k % 3 = 0 AND source_revision % 4 > 0)"


def _staged(m):
    k = "cast(substring(session_id, 2) as bigint)"
    return m.events.where(f"{k} % 3 = 0 and source_revision % 4 > 0").withColumn("dedup_key", F.expr(f"case when {k} % 2 = 0 then dedup_key else concat('new:', dedup_key) end"))


@query(
    f"WITH {EV}, {STAGED}, hit AS (SELECT s.agent_id, s.source_instance_id, s.dedup_key, e.pico, CASE WHEN e.dedup_key = s.dedup_key THEN 0 WHEN e.event_id = s.event_id THEN 1 ELSE 2 END AS rank, e.dedup_key AS src FROM staged s JOIN ev e ON e.agent_id = s.agent_id AND e.source_instance_id = s.source_instance_id AND e.pricing_status <> 0 "
    "AND (e.dedup_key = s.dedup_key OR e.source_entity_id = s.source_entity_id AND (e.event_id = s.event_id OR e.source_revision = s.source_revision))) "
    "SELECT s.agent_id, s.source_instance_id, s.dedup_key, h.pico AS estimated_cost FROM staged s LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY agent_id, source_instance_id, dedup_key ORDER BY rank, src) = 1) h USING (agent_id, source_instance_id, dedup_key)",
    stored=True,
)
def staged_preserve_price(m):
    bare = _staged(m).withColumns({"estimated_cost": F.lit(None).cast("decimal(38,15)"), "pricing_status": F.lit(0), "pricing_missing": F.lit(1)})
    return merge.preserve_prices(bare, m.events).select(*EVENT_KEY, "estimated_cost")


@query(
    f"WITH {EV}, {STAGED} SELECT agent_id, source_instance_id, dedup_key FROM staged UNION SELECT agent_id, source_instance_id, dedup_key FROM ev e WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.source_entity_id = e.source_entity_id AND s.agent_id = e.agent_id AND s.source_instance_id = e.source_instance_id AND s.dedup_key <> e.dedup_key AND (s.event_id = e.event_id OR s.source_revision = e.source_revision)) "
    "AND NOT (e.source_revision <= e.k // 64 % 7 * 300 AND NOT EXISTS (SELECT 1 FROM staged s WHERE s.source_entity_id = e.source_entity_id AND s.source_revision = e.source_revision))",
    stored=True,
)
def staged_merge_events(m):
    marks = m.events.select("agent_id", "source_instance_id", "source_entity_id").distinct().withColumn("high_water", F.expr("cast(substring(source_entity_id, 2) as bigint) % 7 * 300"))
    return merge.merge_staged(m.events, save(_staged(m), "staged"), marks).select(*EVENT_KEY)


@query(f"WITH {EV}, staged AS (SELECT * FROM ev WHERE agent_id = 'agent-1' AND source_revision % 2 = 0) SELECT agent_id, source_instance_id, dedup_key FROM staged UNION ALL SELECT agent_id, source_instance_id, dedup_key FROM ev WHERE source_instance_id NOT IN (SELECT source_instance_id FROM staged)")
def staged_replace(m):
    return merge.replace_instances(m.events, m.events.where("agent_id = 'agent-1' and source_revision % 2 = 0")).select(*EVENT_KEY)


# --- prompts --------------------------------------------------------------------


@query(f"WITH {EV}, {TREE}, {ATTR} SELECT * FROM attr", stored=True)
def turn_attribution(m):
    turn_rows = save(m.turns, "turn_rows")
    return attribution.attribute(turn_rows, m.sessions, projection.dispatches(turn_rows, m.sessions))


@query(
    f"WITH {EV}, {TREE}, {ATTR}, {TOOLS}, g AS (SELECT {ROOT}, prompt_turn, {U}, {SPAN}, coalesce(CAST(sum(nt) AS BIGINT), 0) AS tools FROM at_ev LEFT JOIN (SELECT agent_id, source_instance_id, dedup_key, count(*) AS nt FROM tool GROUP BY ALL) USING (agent_id, source_instance_id, dedup_key) WHERE prompt_turn IS NOT NULL AND {IN} GROUP BY {ROOT}, prompt_turn) "
    f"SELECT g.*, coalesce(turn.start_ms, g.first_ms) AS start_ms, 'prompt ' || turn.turn_id AS preview, turn.user_messages, max(coalesce(normalized_total, 0)) OVER (PARTITION BY g.agent_id, g.source_instance_id, g.root_session_id) AS largest FROM g LEFT JOIN turn ON turn.session_id = g.root_session_id AND turn.turn_id = g.prompt_turn",
    stored=True,
)
def turns(m):
    return usage.turns(_attributed(m), m.turns, m.tools, TWO_YEARS)


@query(f"WITH {EV}, {TREE}, {ATTR} SELECT {ROOT}, count(*) AS calls, count(prompt_turn) AS attributed, count(DISTINCT prompt_turn) AS prompts, CASE WHEN count(prompt_turn) = count(*) THEN 1 WHEN count(prompt_turn) = 0 THEN 3 ELSE 2 END AS status FROM at_ev WHERE {IN} GROUP BY {ROOT}", stored=True)
def turn_coverage(m):
    return usage.turn_coverage(_attributed(m), TWO_YEARS)


@query(f"WITH {EV}, {TREE}, {ATTR} SELECT {ROOT}, {U} FROM at_ev WHERE {IN} AND prompt_turn IS NULL GROUP BY {ROOT}", stored=True)
def unattributed(m):
    return usage.unattributed(_attributed(m), TWO_YEARS)


@query(f"WITH {EV}, {TREE}, {ATTR}, {TOOLS} SELECT {ROOT}, prompt_turn, at_ev.dedup_key, occurred_ms, {MODEL} AS model, coalesce(x.tools, '') AS tools FROM at_ev LEFT JOIN (SELECT dedup_key, string_agg(tool_name, ',' ORDER BY ordinal) AS tools FROM tool GROUP BY 1) x USING (dedup_key) WHERE {IN} AND prompt_turn IS NOT NULL", stored=True)
def turn_calls(m):
    calls = usage.turn_calls(_attributed(m), m.tools, TWO_YEARS)
    return calls.select("agent_id", "source_instance_id", "root_session_id", "prompt_turn", "dedup_key", "occurred_ms", "model", F.array_join("tools", ",").alias("tools"))


@query(f"WITH {EV}, {TOOLS} SELECT agent_id, source_instance_id, dedup_key, tool_name, count(*) AS n FROM tool GROUP BY ALL")
def tool_frequency(m):
    return derive.tool_frequency(m.tools)


# --- derived figures --------------------------------------------------------------


def _local(unit: str) -> str:
    return f"WITH {EV} SELECT CAST(date_trunc('{unit}', timezone('{ZONE}', to_timestamp(occurred_ms // 3600000 * 3600))) AS DATE) AS bucket, count(*) AS requests, CAST(sum(normalized_total_value) AS BIGINT) AS normalized_total FROM ev WHERE {IN} GROUP BY 1"


@query(_local("day"))
def trend_local_day(m):
    return derive.regroup(usage.trend(m.events, TWO_YEARS), "day", ZONE).select("bucket", "requests", "normalized_total")


@query(_local("week"))
def trend_local_week(m):
    return derive.regroup(usage.trend(m.events, TWO_YEARS), "week", ZONE).select("bucket", "requests", "normalized_total")


def _days(m, f=TWO_YEARS):
    return derive.regroup(usage.trend(m.events, replace(f, agent="agent-2", model="brand#11")), "day", "UTC")


DAYS = f"days AS (SELECT CAST(to_timestamp(occurred_ms // 1000) AS DATE) AS bucket, {U} FROM ev WHERE {IN} AND agent_id = 'agent-2' AND normalized_model = 'brand#11' GROUP BY 1), calendar AS (SELECT CAST(d AS DATE) AS bucket FROM range(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 1 DAY) x(d))"


@query(f"WITH {EV}, {DAYS} SELECT bucket, coalesce(requests, 0) AS requests, coalesce(normalized_total, 0) AS normalized_total FROM calendar LEFT JOIN days USING (bucket)")
def gap_fill(m):
    return derive.fill(_days(m), date(1996, 1, 1), date(1998, 1, 1), "day", ["requests", "normalized_total"]).select("bucket", "requests", "normalized_total")


@query(f"WITH {EV}, {DAYS} SELECT bucket, normalized_total, CASE WHEN coalesce(normalized_total, 0) <= 0 THEN 0 WHEN normalized_total * 4 <= top THEN 1 WHEN normalized_total * 2 <= top THEN 2 WHEN normalized_total * 4 <= top * 3 THEN 3 ELSE 4 END AS level FROM calendar LEFT JOIN days USING (bucket), (SELECT max(normalized_total) AS top FROM days)")
def heatmap(m):
    days = derive.fill(_days(m), date(1996, 1, 1), date(1998, 1, 1), "day", [])
    return days.select("bucket", "normalized_total", derive.heat_level(F.col("normalized_total")).alias("level"))


@query(f"WITH {EV}, {DAYS} SELECT bucket, coalesce(requests, 0) AS requests, normalized_total // requests AS average, CASE WHEN cache_read_available = requests AND uncached_input_available = requests AND cache_read + uncached_input > 0 THEN cache_read * 1000000 // (cache_read + uncached_input) END AS cache_hit FROM calendar LEFT JOIN days USING (bucket)")
def daily_table(m):
    days = derive.fill(_days(m), date(1996, 1, 1), date(1998, 1, 1), "day", ["requests"])
    return days.select("bucket", "requests", F.expr("normalized_total div nullif(requests, 0)").alias("average"), E.cache_hit().alias("cache_hit"))


@query(f"WITH {EV}, a AS (SELECT agent_id, CAST(sum(normalized_total_value) AS BIGINT) AS v FROM ev WHERE {IN} GROUP BY 1) SELECT agent_id, v, v * 1000000 // (SELECT CAST(sum(v) AS BIGINT) FROM a) AS share FROM a ORDER BY v DESC, agent_id LIMIT 4")
def shares_top4(m):
    rows = usage.by(m.events, TWO_YEARS, "agent_id").select("agent_id", F.col("normalized_total").alias("v"))
    return derive.top(derive.shares(rows, "v"), "v", 4, "agent_id")


@query(f"WITH {EV}, {DAYS} SELECT bucket, normalized_total FROM days WHERE normalized_total > 0 ORDER BY normalized_total DESC, bucket LIMIT 1")
def most_active_day(m):
    return derive.most_active(_days(m), "normalized_total")


@query(
    f"WITH {EV}, d AS (SELECT project_id AS project, CAST(to_timestamp(occurred_ms // 1000) AS DATE) AS bucket, CAST(sum(tool_value) AS BIGINT) AS v FROM ev WHERE {IN} AND project_id IS NOT NULL GROUP BY 1, 2), w AS (SELECT project, bool_or(v IS NULL) AS u FROM d GROUP BY 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY bucket DESC) AS i FROM d WHERE v > 0), g AS (SELECT project, count(*) AS active_days, count_if(bucket + CAST(i AS INT) = DATE '1998-01-01') AS streak, arg_min(bucket, -v * 100000 + epoch(bucket) // 86400) AS peak_day, max(v) AS peak FROM r GROUP BY 1) "
    "SELECT project, CASE WHEN NOT u THEN coalesce(active_days, 0) END AS active_days, CASE WHEN NOT u THEN coalesce(streak, 0) END AS streak, CASE WHEN NOT u THEN peak_day END AS peak_day, CASE WHEN NOT u THEN peak END AS peak FROM w LEFT JOIN g USING (project)"
)
def project_streak(m):
    days = TWO_YEARS.apply(m.events).where("project_id is not null").groupBy(F.col("project_id").alias("project"), derive.local_bucket(F.col("occurred_ms"), "day", "UTC").alias("bucket")).agg(F.sum("tool_value").alias("v"))
    return derive.project_stats(days, "project", "v", date(1998, 1, 1))


def queries() -> dict[str, Query]:
    from meterlight.plans import more  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from meterlight.plans import more  # noqa: F401

    return dict(SQL)
