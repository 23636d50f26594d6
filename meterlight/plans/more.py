"""Queries of the sources, of whole-table changes and of further derived figures."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.functions import expressions as E
from meterlight.functions import identity, records
from meterlight.operators import attribution, catalogs, derive, merge, pricing, rescan, usage, writes
from meterlight.plans.queries import ALL, EV, IN, KEYS, MODEL, PATH, RATE, ROOT, SPAN, TREE, TURNS, TWO_YEARS, U, ZONE, _attributed, _tree, query
from meterlight.plans.queries import ATTR, DAYS, PROJECTS, TOOLS
from meterlight.plans.tables import save
from meterlight.schema import EVENT_KEY, SESSION_KEY
from meterlight.sources import documents, projection, rollouts, samples, transcripts, wires

NUM = """nm AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s, cents) AS i FROM (SELECT l_orderkey k, CAST(l_linenumber AS BIGINT) n, CAST(l_quantity AS BIGINT) q, l_partkey p, l_suppkey s, CAST(round(l_extendedprice * 100) AS BIGINT) cents, l_returnflag flag, epoch_ms(l_shipdate) day_ms FROM lineitem))"""


def _hash(kind: str, *values: str) -> str:
    return f"sha256('{kind}'" + "".join(f" || chr(0) || {v}" for v in values) + ")"


# --- sources ------------------------------------------------------------------


@query(
    f"WITH {NUM}, c AS (SELECT 's' || k AS session_id, {_hash('claude-code-message', chr(39) + 'm' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || (i // 2)')} AS dedup_key, {_hash('claude-code-prompt', chr(39) + 'p' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || (i - (i - 1) % 3)')} AS turn_id, "
    "day_ms + i * 1000 AS occurred_ms, CASE WHEN q % 4 <> 0 OR s % 5 = 0 THEN 1 ELSE 0 END AS completion_state, i * 2 AS source_revision, q * 10 + s + p % 7 AS input_reported_value, CASE WHEN q % 4 = 0 THEN 0 ELSE q END AS output_value, substr(sha256(upper('/work/p' || (k % 7))), 1, 24) AS project_id FROM nm WHERE s % 11 <> 0 AND p % 13 <> 0 AND p % 17 <> 0) "
    "SELECT *, input_reported_value + output_value AS normalized_total_value, 'model-a' AS normalized_model FROM c QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY completion_state DESC, source_revision DESC) = 1"
)
def claude_calls(m):
    """Lines of one message are one call, by state and line."""
    calls = transcripts.claude_calls(samples.claude(m.numbered)).withColumns({"agent_id": F.lit("claude-code"), "source_instance_id": F.lit("i")})
    names = ["session_id", "dedup_key", "turn_id", "occurred_ms", "completion_state", "source_revision", "input_reported_value", "output_value", "project_id", "normalized_total_value", "normalized_model"]
    return merge.upsert_events(calls, ["line"]).select(*names)


@query(
    f"WITH {NUM}, t AS (SELECT 's' || k AS session_id, {_hash('claude-code-prompt', chr(39) + 'p' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || (i - (i - 1) % 3)')} AS turn_id, i, q, p, s, day_ms + i * 1000 AS ts FROM nm) "
    "SELECT session_id, turn_id, max(ts) FILTER (i % 3 = 1) AS start_ms, max(ts) FILTER (s % 11 <> 0 AND p % 13 <> 0 AND p % 17 <> 0 AND (q % 4 <> 0 OR s % 5 = 0)) AS completed_ms, max('Say ' || q || ' please') FILTER (i % 3 = 1 AND s % 3 <> 0) AS preview, count_if(i % 3 = 1 AND s % 3 <> 0) AS user_messages FROM t GROUP BY 1, 2"
)
def claude_turns(m):
    """Turns end with the last call that counts: lines without whole counters end none."""
    return transcripts.claude_turns(samples.claude(m.numbered)).drop("entity")


@query(
    f"WITH {NUM} SELECT 's' || k AS session_id, CASE WHEN bool_or(s % 11 <> 0 AND (p % 13 = 0 OR p % 17 = 0)) THEN 2 ELSE 1 END AS compatibility, CASE WHEN bool_or(s % 11 <> 0) THEN substr(sha256(upper('/work/p' || (k % 7))), 1, 24) END AS project_id, "
    "min(day_ms + i * 1000) FILTER (i % 3 = 1 OR s % 11 <> 0) AS first_ms, max(day_ms + i * 1000) FILTER (i % 3 = 1 OR s % 11 <> 0) AS last_ms FROM nm GROUP BY k"
)
def claude_sessions(m):
    """A session is partial until its project is known, and incompatible if a call can't be used."""
    return transcripts.claude_tables(samples.claude(m.numbered))["sessions"].select("session_id", "compatibility", "project_id", "first_ms", "last_ms")


@query(
    f"WITH {NUM} SELECT {_hash('claude-code-message', chr(39) + 'm' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || (i // 2)')} AS dedup_key, arg_max('Tool' || (p % 5), i) AS tool_name, max(i * 2) AS source_revision FROM nm WHERE s % 11 <> 0 AND p % 13 <> 0 AND p % 17 <> 0 GROUP BY k, i // 2, s % 2"
)
def claude_tools(m):
    """Tools of the lines of one message come together, of each id the last."""
    return transcripts.claude_tables(samples.claude(m.numbered))["tools"].select("dedup_key", "tool_name", "source_revision")


@query(
    f"WITH {NUM} SELECT {_hash('qwen-code-call', chr(39) + 's' + chr(39) + ' || k', chr(39) + 'a' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || i')} AS dedup_key, {_hash('qwen-code-turn', chr(39) + 's' + chr(39) + ' || k', chr(39) + 'u' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || (i - (i - 1) % 4)')} AS turn_id, "
    "CASE WHEN s % 7 = 0 THEN 'unknown' ELSE 'qwen-x' END AS raw_model, q * 2 AS uncached_input_value, q AS cache_read_value, q AS output_value, s % 5 AS reasoning_value, q * 4 + s % 5 AS normalized_total_value FROM nm WHERE i % 4 <> 1 AND s % 9 <> 0 AND p % 10 <> 0"
)
def qwen_calls(m):
    return transcripts.qwen_calls(samples.qwen(m.numbered)).select("dedup_key", "turn_id", "raw_model", "uncached_input_value", "cache_read_value", "output_value", "reasoning_value", "normalized_total_value")


@query(
    f"WITH {NUM}, c AS (SELECT *, p % 4 AS c, s % 4 AS t FROM nm WHERE p % 19 <> 0) SELECT 's' || k AS session_id, i AS source_revision, q + 10 - CASE WHEN i % 4 IN (0, 2) THEN c ELSE 0 END AS uncached_input_value, q + 20 - CASE WHEN i % 4 IN (0, 1) THEN t ELSE 0 END AS output_value, c AS cache_read_value, t AS reasoning_value, "
    "CASE WHEN c = 0 THEN 0 WHEN i % 4 IN (0, 2) THEN 1 ELSE 2 END AS cache_included, CASE WHEN t = 0 THEN 0 WHEN i % 4 IN (0, 1) THEN 1 ELSE 2 END AS reasoning_included FROM c WHERE NOT (c = t AND c > 0 AND i % 4 IN (1, 2))"
)
def workbuddy_calls(m):
    return transcripts.workbuddy_calls(samples.workbuddy(m.numbered)).select("session_id", "source_revision", "uncached_input_value", "output_value", "cache_read_value", "reasoning_value", "cache_included", "reasoning_included")


@query(
    f"WITH {NUM}, g AS (SELECT *, CASE WHEN s % 6 = 0 THEN 0 ELSE q END AS g FROM nm), r AS (SELECT *, CAST(sum(g) OVER (PARTITION BY k, (i - 1) // 4 ORDER BY i) AS BIGINT) AS t FROM g), w AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY i) AS was FROM r), "
    "u AS (SELECT *, CASE WHEN was IS NULL OR t < was THEN CASE WHEN p % 2 = 0 THEN g ELSE t END WHEN t > was THEN CASE WHEN p % 2 = 0 THEN g ELSE t - was END END AS u FROM w) "
    f"SELECT 's' || k AS session_id, i AS source_revision, u * 7 AS uncached_input_value, u * 3 AS cache_read_value, u AS output_value, u * 11 AS normalized_total_value, 'gpt-test' AS normalized_model, substr({_hash('repository', chr(39) + 'HOST.EXAMPLE/team/p' + chr(39) + ' || (k % 7)')}, 1, 24) AS project_id FROM u WHERE u IS NOT NULL"
)
def codex_calls(m):
    return rollouts.codex_tables(samples.codex(m.numbered))["events"].select("session_id", "source_revision", "uncached_input_value", "cache_read_value", "output_value", "normalized_total_value", "normalized_model", "project_id")


CHAINS = f"WITH RECURSIVE {NUM}, w AS (SELECT *, 's' || k AS session_id, i - (i - 1) % 4 AS t, day_ms + i AS ms FROM nm), b(k, i) AS (SELECT k, i FROM w WHERE i % 4 = 1 UNION ALL SELECT w.k, w.i FROM b JOIN w ON w.k = b.k AND w.i % 4 <> 1 AND s % 7 > 0 AND b.i = CASE WHEN s % 3 = 0 THEN t ELSE w.i - 1 END), c AS (SELECT *, sha256('workbuddy-turn' || chr(0) || 's' || k || chr(0) || 'w' || k || '-' || t) AS turn_id FROM w)"


@query(f"{CHAINS} SELECT session_id, i AS source_revision, CASE WHEN (k, i) IN (SELECT (k, i) FROM b) THEN turn_id END AS turn_id, q * 2 AS normalized_total_value FROM c WHERE i % 4 <> 1")
def workbuddy_chains(m):
    return transcripts.workbuddy_calls(samples.chains(m.numbered)).select("session_id", "source_revision", "turn_id", "normalized_total_value")


@query(f"{CHAINS} SELECT session_id, turn_id, min(ms) FILTER (i = t) AS start_ms, max(ms) FILTER (i > t AND (k, i) IN (SELECT (k, i) FROM b)) AS completed_ms, 'Do ' || min(q) FILTER (i = t) AS preview FROM c GROUP BY ALL")
def workbuddy_turns(m):
    return transcripts.workbuddy_turns(samples.chains(m.numbered)).select("session_id", "turn_id", "start_ms", "completed_ms", "preview")


def _rolled(m):
    return rollouts.codex_tables(samples.rollouts(m.numbered))


ROLLED = f"{NUM}, ro AS (SELECT *, 's' || k AS session_id, 't' || k || '-' || (i - (i - 1) % 3) AS t, day_ms + i * 1000 AS ms, sha256('6:schema=21:codex-logical-call-v2;10:session_id=' || length('s' || k) || ':s' || k || ';4:kind=8:explicit;4:path=13:info.usage_id;5:field=8:usage_id;5:value=' || length('u' || k || '-' || i) || ':u' || k || '-' || i || ';') AS dedup_key FROM nm)"


@query(f"WITH {ROLLED} SELECT dedup_key, session_id, CASE WHEN k % 4 = 1 THEN 's' || (k - 1) END AS parent_session_id, sha256(t) AS turn_id, ms AS occurred_ms, i AS source_revision, q * 7 AS uncached_input_value, q * 3 AS cache_read_value, q * 11 AS normalized_total_value FROM ro")
def codex_events(m):
    return _rolled(m)["events"].select("dedup_key", "session_id", "parent_session_id", "turn_id", "occurred_ms", "source_revision", "uncached_input_value", "cache_read_value", "normalized_total_value")


@query(f"WITH {ROLLED} SELECT session_id, CAST(CASE WHEN k % 4 = 1 THEN 2 ELSE 1 END AS INT) AS session_kind, CASE WHEN k % 4 = 1 THEN 's' || (k - 1) END AS parent_session_id, CAST(k % 4 = 1 AS INT) AS relation_state, CAST(k % 4 = 1 AS INT) AS relation_origin, CAST(CASE WHEN k % 4 = 1 THEN 2 ELSE 1 END AS INT) AS session_role, CASE WHEN k % 4 = 1 THEN sha256('root/w' || k) END AS agent_path_hash, CASE WHEN k % 4 = 1 THEN sha256('w' || k) END AS agent_leaf_hash, '/work/p' || (k % 7) AS project_path, ms AS first_ms FROM ro WHERE i = 1")
def codex_sessions(m):
    return _rolled(m)["sessions"].select("session_id", "session_kind", "parent_session_id", "relation_state", "relation_origin", "session_role", "agent_path_hash", "agent_leaf_hash", "project_path", "first_ms")


@query(f"WITH {ROLLED} SELECT session_id, sha256(t) AS turn_id, min(ms) FILTER (i % 3 <> 2) AS start_ms, min(ms) FILTER (i % 3 = 0) AS completed_ms, 'Ask ' || min(q) FILTER (i % 3 = 1) || ' please' AS preview, CAST(1 AS BIGINT) AS user_messages FROM ro GROUP BY session_id, t")
def codex_turns(m):
    return _rolled(m)["turns"].select("session_id", "turn_id", "start_ms", "completed_ms", "preview", "user_messages")


@query(f"WITH {ROLLED} SELECT dedup_key, CAST(0 AS INT) AS ordinal, 'shell' AS tool_name FROM ro WHERE s % 3 > 0 UNION ALL SELECT dedup_key, CASE WHEN s % 3 > 0 THEN 1 ELSE 0 END, 'spawn_agent' FROM ro WHERE s % 5 = 0")
def codex_tools(m):
    return _rolled(m)["tools"].select("dedup_key", "ordinal", "tool_name")


@query(f"WITH {ROLLED} SELECT session_id AS source_session_id, sha256(t) AS source_turn_id, sha256('c' || k || '-' || i) AS dispatch_id, sha256('w' || k) AS target_hash, CAST(0 AS INT) AS kind, CAST(1 AS INT) AS target_kind, ms AS occurred_ms FROM ro WHERE s % 5 = 0")
def codex_dispatches(m):
    return _rolled(m)["dispatches"].select("source_session_id", "source_turn_id", "dispatch_id", "target_hash", "kind", "target_kind", "occurred_ms")


KIMI = f"""{NUM}, km AS (SELECT *, 's' || k AS session_id, (i - 1) // 2 AS j, sha256('kimi-code-turn' || chr(0) || 't' || k || '-' || ((i - 1) // 2)) AS turn_id, sha256('kimi-code-step-event' || chr(0) || 's' || k || chr(0) || 'st' || k || '-' || i) AS dedup_key, s % 5 > 0 AS fits, CASE WHEN i = 1 THEN 0 ELSE s % 3 END AS kind, lag(p) OVER (PARTITION BY k ORDER BY i) AS task FROM nm)"""


@query(f"WITH {KIMI} SELECT dedup_key, session_id, turn_id, day_ms + i AS occurred_ms, i * 10 + CASE WHEN p % 3 = 0 THEN 7 ELSE 8 END AS source_revision, q AS uncached_input_value, s % 9 AS cache_read_value, p % 30 AS output_value, q + s % 9 + p % 30 AS normalized_total_value, 'kimi-k3-256k' AS normalized_model, CASE WHEN q % 2 = 0 THEN 'kimi-code/k3-256k' END AS route_model_id FROM km WHERE fits")
def kimi_calls(m):
    """A step's end and a usage record of equal counters, in either order."""
    return wires.kimi_tables(samples.kimi(m.numbered))["events"].select("dedup_key", "session_id", "turn_id", "occurred_ms", "source_revision", "uncached_input_value", "cache_read_value", "output_value", "normalized_total_value", "normalized_model", "route_model_id")


@query(
    f"WITH {KIMI}, o AS (SELECT *, count_if(kind = 0) OVER (PARTITION BY k ORDER BY j) AS g FROM km WHERE i % 2 = 1), r AS (SELECT *, count_if(kind = 2 AND task % 2 > 0) OVER (PARTITION BY k, g ORDER BY j) AS lost, first_value(turn_id) OVER (PARTITION BY k, g ORDER BY j) AS prompt FROM o), e AS (SELECT turn_id, max(day_ms + i) AS ms FROM km WHERE fits GROUP BY 1) "
    "SELECT session_id, r.turn_id, day_ms + i AS start_ms, e.ms AS completed_ms, CASE WHEN kind = 0 THEN 'Do ' || q END AS preview, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS user_messages, CASE WHEN kind > 0 AND lost = 0 THEN prompt END AS prompt_origin_turn FROM r LEFT JOIN e ON e.turn_id = r.turn_id"
)
def kimi_turns(m):
    """Turns that tasks and background work open go back to the prompt that began them."""
    return wires.kimi_tables(samples.kimi(m.numbered))["turns"].select("session_id", "turn_id", "start_ms", "completed_ms", "preview", "user_messages", "prompt_origin_turn")


@query(f"WITH {KIMI} SELECT dedup_key, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT & 2147483647 AS INT) AS ordinal, 'Read' AS tool_name FROM (SELECT *, sha256('tc' || k || '-' || i) AS h FROM km) WHERE fits AND s % 3 > 0")
def kimi_tools(m):
    return wires.kimi_tables(samples.kimi(m.numbered))["tools"].select("dedup_key", "ordinal", "tool_name")


@query(f"WITH {KIMI} SELECT session_id, CASE WHEN bool_and(fits) THEN 0 ELSE 2 END AS compatibility, least(min(day_ms + i), min(day_ms) FILTER (i = 1)) AS first_ms, max(day_ms + i) AS last_ms FROM km GROUP BY 1")
def kimi_sessions(m):
    """A session with a usage record that fits no step can't be used for now."""
    return wires.kimi_tables(samples.kimi(m.numbered))["sessions"].select("session_id", "compatibility", "first_ms", "last_ms")


@query(
    f"WITH {NUM}, c AS (SELECT k, n, i, CASE WHEN i % 2 = 0 THEN CASE WHEN s % 9 <= q * 3 AND p % 10 <> 0 THEN q * 3 - s % 9 END WHEN i % 4 = 3 OR s % 9 = 0 THEN CASE WHEN s % 9 <= q * 2 THEN q * 2 - s % 9 + p % 3 END ELSE q * 2 + p % 3 END AS uncached, s % 9 AS h, "
    "CASE WHEN i % 2 = 0 THEN q * 4 ELSE q * 3 + p % 3 + CASE WHEN i % 4 = 1 THEN s % 9 ELSE 0 END END AS total, CASE WHEN i % 2 = 1 AND s % 9 = 0 THEN 2 WHEN i % 2 = 0 OR i % 4 = 3 THEN 1 ELSE 2 END AS cache_included FROM nm) "
    f"SELECT 's' || k AS session_id, {_hash('gemini-cli-call', chr(39) + 's' + chr(39) + ' || k', chr(39) + 'g' + chr(39) + ' || n')} AS dedup_key, uncached AS uncached_input_value, h AS cache_read_value, total AS normalized_total_value, cache_included FROM c WHERE uncached IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, n ORDER BY i DESC) = 1"
)
def gemini_calls(m):
    return documents.gemini_calls(samples.gemini(m.numbered)).select("session_id", "dedup_key", "uncached_input_value", "cache_read_value", "normalized_total_value", "cache_included")


@query(
    f"WITH {NUM} SELECT 's' || k AS session_id, {_hash('opencode-call', chr(39) + 's' + chr(39) + ' || k', chr(39) + 'c' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || i')} AS dedup_key, day_ms + i AS occurred_ms, q + s % 50 + CASE WHEN p % 3 = 0 THEN 0 ELSE p % 5 END + q % 4 AS normalized_total_value, "
    "CASE WHEN i % 3 = 0 OR p % 3 <> 0 THEN 1 ELSE 2 END AS normalized_total_origin, CASE WHEN p % 3 <> 0 THEN 2 ELSE 1 END AS data_quality FROM nm WHERE NOT (i % 3 = 0 AND p % 20 = 0)"
)
def opencode_calls(m):
    return documents.opencode_calls(samples.opencode(m.numbered)).select("session_id", "dedup_key", "occurred_ms", "normalized_total_value", "normalized_total_origin", "data_quality")


@query(
    f"WITH {NUM} SELECT {_hash('zcode-call', chr(39) + 'z' + chr(39) + ' || k || ' + chr(39) + '-' + chr(39) + ' || i')} AS dedup_key, CASE WHEN i % 3 = 0 THEN q * 2 - p % 2 ELSE q * 3 END AS uncached_input_value, CASE WHEN i % 3 = 0 THEN q ELSE q + s % 5 END AS output_value, "
    "q * 4 + s % 5 + CASE WHEN i % 3 = 1 THEN s % 5 + q + p % 2 ELSE 0 END AS normalized_total_value FROM nm WHERE i % 3 < 2"
)
def zcode_calls(m):
    rows = m.numbered.selectExpr(
        "concat('z', k, '-', i) id", "concat('s', k) session_id", "concat('t', i div 2) turn_id", "'Z-1' model_id", "day_ms + i completed_at", "q * 3 input_tokens", "q + s % 5 output_tokens", "s % 5 reasoning_tokens", "q cache_read_input_tokens", "p % 2 cache_creation_input_tokens",
        "cast(null as bigint) provider_total_tokens", "case i % 3 when 0 then q * 4 + s % 5 when 1 then q * 5 + s % 5 * 2 + p % 2 else 1 end computed_total_tokens",
    )
    turns = m.numbered.selectExpr("concat('s', k) session_id", "concat('t', i div 2) turn_id", "concat('u', i) user_message_id", "day_ms started_at")
    return documents.zcode_calls(rows, turns).select("dedup_key", "uncached_input_value", "output_value", "normalized_total_value")


@query(
    f"WITH {NUM}, u AS (SELECT k, i // 2 AS r, day_ms + 100000000000 AS at, q FROM nm WHERE i % 2 = 0) SELECT {_hash('qoder-call', 'CAST(nm.k * 1000 + i AS VARCHAR)')} AS dedup_key, CASE WHEN u.k IS NOT NULL THEN {_hash('qoder-turn', chr(39) + 's' + chr(39) + ' || nm.k', chr(39) + 'r' + chr(39) + ' || (i // 2)')} END AS turn_id, "
    "'ask ' || u.q AS preview, nm.q * 2 - nm.q % 3 AS uncached_input_value, nm.q * 2 + s % 50 AS normalized_total_value, substr(sha256(upper('/work/p' || (nm.k % 7))), 1, 24) AS project_id FROM nm LEFT JOIN u ON u.k = nm.k AND u.r = i // 2 WHERE i % 2 = 1"
)
def qoder_calls(m):
    messages = m.numbered.selectExpr(
        "k * 1000 + i id", "concat('s', k) session_id", "concat('r', i div 2) request_id", "if(i % 2 = 0, 'user', 'assistant') role", "concat('ask  ', q) content", "day_ms + 100000000000 gmt_create",
        "to_json(named_struct('prompt_tokens', q * 2, 'completion_tokens', s % 50, 'cached_tokens', q % 3)) token_info", "to_json(named_struct('key', 'Q-1')) model_info",
    )
    chats = m.orders.selectExpr("concat('s', k) session_id", "'title' session_title", "concat('file:///work/p', k % 7) project_uri", "cast(null as string) preferred_model_info", "cast(null as string) parent_session_id")
    none = messages.where("false").selectExpr("session_id", "request_id", "content extra")
    return documents.qoder_calls(messages, none, chats).select("dedup_key", "turn_id", "preview", "uncached_input_value", "normalized_total_value", "project_id")


@query(
    f"WITH {NUM}, x AS (SELECT k, 'Index ' || q AS name, day_ms + i * 1000 AS ms FROM nm WHERE k % 2 = 0 AND p % 3 > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1) "
    "SELECT 's' || coalesce(x.k, t.k) AS session_id, coalesce(name, t.stored) AS session_name, greatest(x.ms, t.ms) AS name_ms FROM x FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Title' ELSE 'Name ' || o_orderkey END AS stored, o_orderkey * 100000 AS ms FROM orders) t ON t.k = x.k ORDER BY name_ms DESC, session_id LIMIT 100000"
)
def session_names(m):
    threads = m.orders.selectExpr("concat('s', k) id", "case when k % 3 > 0 then concat(' Name \\n', k) end name", "'Title' title", "k * 100000 updated_ms")
    listed = m.numbered.where("k % 2 = 0").selectExpr("i line", f"case when p % 3 = 0 then 'no json' else to_json(named_struct('id', concat('s', k), 'thread_name', concat('Index  ', q), 'updated_at', {samples._AT})) end value")
    return documents.session_names(threads, listed)


@query(
    "SELECT 'f' || (o_orderkey // 4) AS entity, 'a' || (o_orderkey % 4) AS agent, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS session_kind, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS session_role, CASE WHEN o_orderkey % 4 > 0 THEN 'a' || (o_orderkey % 4 - 1) END AS parent FROM orders WHERE o_orderkey // 4 % 5 > 0 AND o_orderkey % 4 < 3"
)
def kimi_agents(m):
    agents = m.orders.selectExpr("concat('f', k div 4) entity", "k div 4 % 5 = 0 odd", "named_struct('key', concat('a', k % 4), 'value', named_struct('type', if(k % 4 = 0, 'main', 'sub'), 'parentAgentId', case k % 4 when 1 then 'a0' when 2 then 'a1' when 3 then 'missing' end)) a")
    states = agents.groupBy("entity", "odd").agg(F.collect_list("a").alias("a")).select("entity", F.to_json(F.struct(F.lit("/w").alias("workDir"), F.when(F.col("odd"), "/x").otherwise("/w").alias("cwd"), F.map_from_entries("a").alias("agents"))).alias("value"))
    return documents.kimi_agents(states).select("entity", "agent", "session_kind", "session_role", "parent")


@query("SELECT conv_id, turn, CASE WHEN c <> '' THEN rtrim(substr(c, 1, 120)) END AS preview FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\p{Cc}\\p{Cf}]+', ' ', 'g')) AS c FROM conversations)")
def prompt_preview(m):
    return m.conversations.select("conv_id", "turn", records.preview(F.col("text")).alias("preview"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, json_type(props, '$.k') IS NULL OR json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'NULL') AS ok FROM events")
def json_counters(m):
    v = records.record(F.col("props"))
    return m.logged.select("event_id", records.counter(v, "$.k").alias("k"), records.counters_ok(v, "$.k").alias("ok"))


# --- names ----------------------------------------------------------------------


@query(
    f"WITH {NUM} SELECT k, i, CASE k % 6 WHEN 0 THEN 'model-a' WHEN 1 THEN 'kimi-k2.5' WHEN 2 THEN 'other/x' || (p % 5) WHEN 3 THEN 'market-b' WHEN 4 THEN 'k20' ELSE NULL END AS canonical_model FROM nm"
)
def canonical_model(m):
    rows = m.numbered.selectExpr("k", "i", "'Agent-1' agent_id", "'prov' provider_id", "case k % 6 when 0 then ' agent-1/PROV/agent-1/Alias-A ' when 1 then 'prov/K2.5' when 2 then concat('other/X', p % 5) when 3 then 'Alias-B' when 4 then 'k20' else '  ' end raw_model")
    spark = rows.sparkSession
    aliases = [spark.createDataFrame([x], "alias string, canonical string") for x in (("alias-a", "model-a"), ("alias-b", "market-b"))]
    return identity.canonical_models(rows, *aliases).select("k", "i", "canonical_model")


@query(
    f"WITH {NUM} SELECT k, i, CASE WHEN s % 11 = 0 THEN NULL WHEN p % 5 = 0 THEN 'wb 1' WHEN p % 5 = 1 THEN 'route-' || (k % 4) WHEN p % 5 = 2 THEN CASE WHEN k % 4 = 0 THEN 'shown zero' ELSE 'raw-x' END WHEN p % 5 = 3 THEN 'named' ELSE 'raw-x' END AS normalized_model, "
    "CASE WHEN s % 11 = 0 THEN 5 WHEN p % 5 < 2 OR p % 5 = 2 AND k % 4 = 0 THEN 2 WHEN q % 2 = 0 THEN 1 ELSE 0 END AS resolution_origin FROM nm"
)
def shown_model(m):
    """By p: a display name that is the raw one in other signs, that is the route in other signs, that the agent's alias of
    a route confirms or doesn't, that is the market's alias, and that nothing confirms."""
    spark = m.numbered.sparkSession
    named = lambda *rows, more="": spark.createDataFrame(list(rows), more + "alias string, canonical string")
    none = "when s % 11 = 0 then null"
    rows = m.numbered.selectExpr(
        "k", "i", f"case {none} when p % 5 = 0 then ' WB-1' when p % 5 = 3 then 'Alias-N' else 'Raw-X' end raw_model", f"case {none} when p % 5 in (1, 2) then concat('Route-', k % 4) end route_model_id",
        f"case {none} when p % 5 = 0 then 'wb 1' when p % 5 = 1 then concat('ROUTE ', k % 4) when p % 5 = 2 then 'Shown Zero' when p % 5 = 4 then 'Else' end display_name", "if(q % 2 = 0, 'P', null) provider_id",
    )
    own = named(("WorkBuddy", "route-0", "shown zero"), ("other", "route-1", "shown zero"), more="agent_id string, ")
    found = identity.shown_models(rows, own, named(("alias-n", "named")), named(("nothing", "nobody")), agent="workbuddy")
    return found.select("k", "i", "normalized_model", "resolution_origin")


@query(
    f"WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'HOST.EXAMPLE/Team/p' || (o_orderkey % 9) WHEN 1 THEN 'HOST.EXAMPLE:8443/Team/p' || (o_orderkey % 9) WHEN 2 THEN 'HOST.EXAMPLE/Team/p' || (o_orderkey % 9) WHEN 3 THEN 'HOST.EXAMPLE/Team/p' || (o_orderkey % 9) END AS repo, '/work/P' || (o_orderkey % 5) AS path FROM orders) "
    f"SELECT k, CASE WHEN k % 7 > 0 THEN path END AS path, CASE WHEN k % 7 > 0 AND repo IS NOT NULL THEN {_hash('repository', 'repo')} END AS repository_hash, CASE WHEN k % 7 > 0 THEN substr(CASE WHEN repo IS NOT NULL THEN {_hash('repository', 'repo')} ELSE sha256(upper(path)) END, 1, 24) END AS id FROM x"
)
def repo_identity(m):
    url = "case k % 6 when 0 then concat('https://user@Host.example/Team/p', k % 9, '.git/') when 1 then concat('https://host.example:8443/Team/p', k % 9) when 2 then concat('git@host.example:Team/p', k % 9, '.GIT') when 3 then concat('ssh://git@host.example/Team/p', k % 9) when 4 then 'ftp://host.example/x' end"
    rows = m.orders.selectExpr("k", f"{url} url", "if(k % 7 > 0, concat('/work/P', k % 5, '//'), 'relative/p') cwd")
    return rows.select("k", identity.project(F.col("cwd"), F.col("url")).alias("x")).select("k", "x.path", "x.repository_hash", "x.id")


@query(f"SELECT o_orderkey AS k, {_hash('turn', chr(39) + 's' + chr(39) + ' || o_orderkey')} AS hash, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT & 2147483647 AS INT) AS ordinal FROM (SELECT *, sha256('s' || o_orderkey) AS h FROM orders)")
def identity_hash(m):
    value = F.concat(F.lit("s"), "k")
    return m.orders.select("k", identity.identity_hash("turn", value).alias("hash"), identity.stable_ordinal(value).alias("ordinal"))


# --- whole-table changes ----------------------------------------------------------


@query(f"WITH {EV}, t AS (SELECT agent_id, source_instance_id, dedup_key, s % 3 AS ordinal, 'tool' || (p % 7) AS tool_name, p, s, cents FROM raw) SELECT agent_id, source_instance_id, dedup_key, ordinal, tool_name FROM t QUALIFY row_number() OVER (PARTITION BY agent_id, source_instance_id, dedup_key, ordinal ORDER BY p DESC, s DESC, cents DESC) = 1")
def tool_upsert(m):
    rows = m.raw.selectExpr(*EVENT_KEY, "arrival_s % 3 ordinal", "concat('tool', arrival_p % 7) tool_name", *projection.ARRIVAL)
    return writes.upsert_tools(rows, projection.ARRIVAL).drop(*projection.ARRIVAL)


@query(f"WITH {EV}, d AS (SELECT agent_id, source_instance_id, 'd' || (k % 64 * 10 + n) AS dispatch_id, session_id, k, p, s, cents FROM raw) SELECT agent_id, source_instance_id, dispatch_id, session_id FROM d QUALIFY row_number() OVER (PARTITION BY agent_id, source_instance_id, dispatch_id ORDER BY p DESC, s DESC, cents DESC, session_id DESC) = 1")
def dispatch_dedup(m):
    rows = m.raw.selectExpr("agent_id", "source_instance_id", "concat('d', cast(substring(session_id, 2) as bigint) % 64 * 10 + cast(split_part(dedup_key, ':', 2) as bigint)) dispatch_id", "session_id", *projection.ARRIVAL)
    return writes.upsert_dispatches(rows, [*projection.ARRIVAL, "session_id"]).drop(*projection.ARRIVAL)


READS = "rd AS (SELECT agent_id, source_instance_id, source_entity_id, p * 100000 + s * 10 + n AS arrival, cents AS position, occurred_ms AS at_ms, CASE WHEN p % 4 = 0 THEN 'io' || (p % 9) END AS error FROM raw)"


@query(f"WITH {EV}, {READS}, g AS (SELECT agent_id, source_instance_id, source_entity_id, max(arrival) AS l, max(arrival) FILTER (error IS NULL) AS o FROM rd GROUP BY ALL), each_read AS (SELECT source_entity_id, agent_id, source_instance_id, arrival, max(position) AS position, max(at_ms) AS at_ms, max(error) AS error FROM rd GROUP BY ALL) "
       "SELECT g.agent_id, g.source_instance_id, g.source_entity_id, a.at_ms AS success_ms, b.error, CASE WHEN b.error IS NOT NULL THEN b.at_ms END AS error_ms FROM g LEFT JOIN each_read a ON a.source_entity_id = g.source_entity_id AND a.agent_id = g.agent_id AND a.arrival = g.o LEFT JOIN each_read b ON b.source_entity_id = g.source_entity_id AND b.agent_id = g.agent_id AND b.arrival = g.l")
def cursor_upsert(m):
    arrival = "arrival_p * 100000 + arrival_s * 10 + cast(split_part(dedup_key, ':', 2) as bigint)"
    reads = m.raw.selectExpr("agent_id", "source_instance_id", "source_entity_id", f"{arrival} arrival", "arrival_c position", "occurred_ms at_ms", "case when arrival_p % 4 = 0 then concat('io', arrival_p % 9) end error")
    one = reads.groupBy(*writes.ENTITY, "arrival").agg(F.max("position").alias("position"), F.max("at_ms").alias("at_ms"), F.max("error").alias("error"))
    return writes.upsert_cursors(one).drop("position")


@query(f"WITH {EV} SELECT agent_id, source_instance_id, count(*) AS n FROM ev WHERE NOT (agent_id = 'agent-1' AND source_instance_id = 'agent-1:1') GROUP BY ALL")
def instance_reset(m):
    return writes.reset_instance(m.events, "agent-1", "agent-1:1").groupBy("agent_id", "source_instance_id").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT 'events' AS name, agent_id, count(*) AS n, CAST(sum(source_revision) AS BIGINT) AS v FROM ev WHERE agent_id <> 'agent-2' GROUP BY ALL UNION ALL SELECT 'cursors', agent_id, count(*), CAST(sum(CASE WHEN agent_id = 'agent-2' AND b % 2 = 0 THEN 7 ELSE 1 END) AS BIGINT) FROM (SELECT DISTINCT agent_id, source_instance_id, source_entity_id, k // 64 AS b FROM ev) GROUP BY ALL")
def clear_baseline(m):
    at = m.events.select(*writes.ENTITY).distinct()
    ends = at.where("cast(substring(source_entity_id, 2) as bigint) % 2 = 0").withColumn("position", F.lit(7))
    out = writes.clear_to_baseline({"events": m.events, "cursors": at.withColumn("position", F.lit(1))}, ends, "agent-2")
    kept = [rows.groupBy(F.lit(name).alias("name"), "agent_id").agg(F.count("*").alias("n"), F.sum(c).cast("bigint").alias("v")) for name, rows, c in (("events", out["events"], "source_revision"), ("cursors", out["cursors"], "position"))]
    return kept[0].union(kept[1])


@query(f"WITH {EV}, i AS (SELECT agent_id, source_instance_id, CAST(min(k) % 3 AS INT) AS level FROM ev GROUP BY ALL), o AS (SELECT agent_id, source_instance_id, CAST(p % 4 AS INT) AS l, 'c' || (p % 8) AS c FROM ev WHERE agent_id <> 'agent-3' AND p % 100 < 50), g AS (SELECT agent_id, source_instance_id, max(l) AS l FROM o GROUP BY ALL), w AS (SELECT o.agent_id, o.source_instance_id, g.l, min(c) AS c FROM o JOIN g ON g.agent_id = o.agent_id AND g.source_instance_id = o.source_instance_id AND g.l = o.l GROUP BY ALL) "
       "SELECT i.agent_id, i.source_instance_id, CASE WHEN w.l > level THEN c ELSE 'old' END AS compatibility_code, greatest(level, coalesce(w.l, level)) AS compatibility_level FROM i LEFT JOIN w USING (agent_id, source_instance_id)")
def compatibility_update(m):
    k = "cast(substring(session_id, 2) as bigint)"
    instances = m.events.groupBy("agent_id", "source_instance_id").agg((F.min(F.expr(k)) % 3).cast("int").alias("compatibility_level"), F.lit("old").alias("compatibility_code"))
    seen = m.events.where("agent_id <> 'agent-3' and source_revision % 100 < 50").selectExpr("agent_id", "source_instance_id", "cast(source_revision % 4 as int) level", "concat('c', source_revision % 8) code")
    return writes.raise_compatibility(instances, seen)


@query(f"WITH {EV}, e AS (SELECT agent_id, source_instance_id, bool_or(k % 50 = 1) AS a FROM ev WHERE source_revision % 2 = 0 GROUP BY ALL), c AS (SELECT agent_id, source_instance_id, agent_id = 'agent-4' AS b FROM (SELECT DISTINCT agent_id, source_instance_id FROM ev)) SELECT agent_id, source_instance_id, e.agent_id IS NOT NULL AS has_derived, coalesce(a, false) OR b AS requires_rebuild FROM c LEFT JOIN e USING (agent_id, source_instance_id)")
def parser_state(m):
    events = m.events.where("source_revision % 2 = 0").withColumn("parser_version", F.expr("if(cast(substring(session_id, 2) as bigint) % 50 = 1, 'v1', 'v2')"))
    cursors = m.events.select("agent_id", "source_instance_id").distinct().withColumn("parser_version", F.expr("if(agent_id = 'agent-4', null, 'v2')"))
    return writes.parser_state(events, cursors, "v2")


@query(f"WITH {EV} SELECT DISTINCT source_instance_id, source_entity_id FROM ev WHERE agent_id = 'agent-3'")
def entities_with_events(m):
    return writes.entities_with_events(m.events, "agent-3")


@query(f"WITH {EV}, {TURNS}, st AS (SELECT * REPLACE ('new ' || turn_id AS turn_id) FROM turn WHERE o % 3 = 0 AND o % 2 = 0), s2 AS (SELECT * FROM turn WHERE o % 3 = 0 AND o % 2 = 1), staged AS (SELECT * FROM st UNION ALL SELECT * FROM s2) "
       "SELECT agent_id, source_instance_id, session_id, turn_id, start_ms, CASE WHEN starts_with(turn_id, 'new ') THEN 'x' ELSE 'y' END AS preview FROM staged UNION ALL SELECT agent_id, source_instance_id, session_id, turn_id, start_ms, 'prompt ' || turn_id FROM turn WHERE o // 64 NOT IN (SELECT o // 64 FROM staged)", stored=True)
def staged_turns(m):
    o = "cast(substring(session_id, 2) as bigint)"
    rows = m.turns.withColumn("source_entity_id", F.expr(f"concat('e', {o} div 64)"))
    rows = save(rows, "rows")
    staged = rows.where(f"{o} % 3 = 0").withColumns({"turn_id": F.expr(f"if({o} % 2 = 0, concat('new ', turn_id), turn_id)"), "preview": F.expr(f"if({o} % 2 = 0, 'x', 'y')")})
    return writes.staged_turns(rows, staged).select(*SESSION_KEY, "turn_id", "start_ms", "preview")


@query(f"WITH {EV}, {TOOLS}, t AS (SELECT *, split_part(dedup_key, ':', 1)::BIGINT AS k FROM tool), st AS (SELECT DISTINCT agent_id, source_instance_id, dedup_key FROM t WHERE k % 3 = 0) SELECT agent_id, source_instance_id, dedup_key, ordinal, tool_name FROM t WHERE k % 3 > 0 UNION ALL SELECT agent_id, source_instance_id, dedup_key, 1, 'staged' FROM st", stored=True)
def staged_tools(m):
    staged = m.tools.where("cast(split_part(dedup_key, ':', 1) as bigint) % 3 = 0").select(*EVENT_KEY).distinct().withColumns({"ordinal": F.lit(1), "tool_name": F.lit("staged")})
    return writes.staged_children(m.tools, staged, list(EVENT_KEY))


_RESCANNED = "(agent_id = 'agent-1' OR source_instance_id = 'agent-2:0')"


@query(
    f"WITH {EV}, {TURNS}, st AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN dedup_key ELSE 'new:' || dedup_key END AS dedup_key, CASE WHEN agent_id = 'agent-1' THEN agent_id ELSE 'agent-9' END AS agent_id) FROM ev WHERE k % 3 = 0 AND p % 4 > 0 AND {_RESCANNED}), old AS (SELECT * FROM ev WHERE source_instance_id <> 'agent-2:0'), "
    "hit AS (SELECT x.source_instance_id, x.dedup_key, e.pico, CASE WHEN e.dedup_key = x.dedup_key THEN 0 WHEN e.event_id = x.event_id THEN 1 ELSE 2 END AS rank, e.dedup_key AS src FROM st x JOIN old e ON e.source_instance_id = x.source_instance_id AND e.pricing_status <> 0 AND (e.dedup_key = x.dedup_key OR e.source_entity_id = x.source_entity_id AND (e.event_id = x.event_id OR e.p = x.p)) QUALIFY row_number() OVER (PARTITION BY x.source_instance_id, x.dedup_key ORDER BY rank, src) = 1), "
    "kept AS (SELECT * FROM old e WHERE NOT EXISTS (SELECT 1 FROM st x WHERE x.source_instance_id = e.source_instance_id AND (x.dedup_key = e.dedup_key OR x.source_entity_id = e.source_entity_id AND (x.event_id = e.event_id OR x.p = e.p))) AND NOT (agent_id = 'agent-1' AND k // 64 % 2 = 0 AND p <= k // 64 % 7 * 300 AND NOT EXISTS (SELECT 1 FROM st x WHERE x.source_entity_id = e.source_entity_id AND x.p = e.p))) "
    "SELECT 'event' AS name, st.agent_id, st.source_instance_id, st.dedup_key AS key, h.pico AS estimated_cost, st.p % 2 AS n FROM st LEFT JOIN hit h ON h.source_instance_id = st.source_instance_id AND h.dedup_key = st.dedup_key UNION ALL SELECT 'event', agent_id, source_instance_id, dedup_key, pico, s % 4 FROM kept "
    f"UNION ALL SELECT 'turn', CASE WHEN agent_id = 'agent-1' THEN agent_id ELSE 'agent-9' END, source_instance_id, turn_id, NULL, 1 FROM turn WHERE {_RESCANNED} AND o % 3 = 0 AND o // 64 % 2 = 0 UNION ALL SELECT 'turn', agent_id, source_instance_id, turn_id, NULL, 0 FROM turn WHERE source_instance_id <> 'agent-2:0' AND NOT (agent_id = 'agent-1' AND o // 64 % 2 = 0)",
    stored=True,
)
def staged_rescan(m):
    """The instances of one agent, and one that goes over to another agent, are read again; their
    cursors hold the even entities, and every second staged event has a tool."""
    block, of = "cast(substring(source_entity_id, 2) as bigint)", "cast(substring(session_id, 2) as bigint)"
    none = lambda **more: {c: F.lit(None).cast(kind) for c, kind in more.items()}
    lacks = {"project_path": "string", "repository_hash": "string", "project_id": "string", "session_name": "string", "name_ms": "bigint"}
    entity = {"source_entity_id": F.expr(f"concat('e', {of} div 64)")}
    events = m.events.withColumns(none(repository_hash="string"))
    sessions = m.sessions.withColumns(entity | none(**lacks) | {"compatibility": F.lit(0), "first_ms": F.lit(0), "last_ms": F.lit(0)})
    turns = save(m.turns.withColumns(entity), "turn_rows")
    sent = projection.dispatches(turns, m.sessions).withColumns({"dispatch_id": F.sha2(F.concat_ws("/", *m.dispatches.columns), 256), "source_entity_id": F.expr("concat('e', cast(substring(source_session_id, 2) as bigint) div 64)")})
    cursors = events.select(*writes.ENTITY).distinct().withColumns({"position": F.lit(1), "high_water": F.expr(f"{block} % 7 * 300")})
    instances = events.select("agent_id", "source_instance_id").distinct().selectExpr("*", "2 compatibility_level", "'old' compatibility_code", "true requires_rescan", "'v1' accepted_parser_version")
    made = save(attribution.attribute(turns, sessions, sent), "made")
    stored = {"instances": instances, "events": events, "tools": m.tools, "sessions": sessions, "turns": turns, "dispatches": sent, "attributions": made, "cursors": cursors}
    moved = F.expr("if(agent_id = 'agent-1', agent_id, 'agent-9')")
    read = {t: rows.where(_RESCANNED).withColumn("agent_id", moved) for t, rows in stored.items()}
    bare = read["events"].where(f"{of} % 3 = 0 and source_revision % 4 > 0").withColumns({"dedup_key": F.expr(f"if({of} % 2 = 0, dedup_key, concat('new:', dedup_key))"), "estimated_cost": F.lit(None).cast("decimal(38,15)"), "pricing_status": F.lit(0), "pricing_missing": F.lit(1)})
    again = read["turns"].where(f"{of} % 3 = 0 and {block} % 2 = 0").withColumn("preview", F.lit("read again"))
    staged = read | {"events": bare, "tools": bare.where("source_revision % 2 = 1").select(*EVENT_KEY, F.lit(1).alias("ordinal"), F.lit("staged").alias("tool_name")), "turns": again, "cursors": read["cursors"].where(f"{block} % 2 = 0")}
    wanted = read["instances"].selectExpr("agent_id", "source_instance_id", "0 compatibility_level", "cast(null as string) compatibility_code", "'v2' parser_version")
    out = rescan.rescan(stored, staged, wanted)
    tools = out["tools"].groupBy(*EVENT_KEY).agg(F.count("*").alias("n"))
    told = out["events"].join(tools, list(EVENT_KEY), "left").select(F.lit("event").alias("name"), "agent_id", "source_instance_id", F.col("dedup_key").alias("key"), "estimated_cost", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return told.unionByName(out["turns"].select(F.lit("turn").alias("name"), "agent_id", "source_instance_id", F.col("turn_id").alias("key"), F.lit(None).cast("decimal(38,15)").alias("estimated_cost"), F.expr("cast(preview = 'read again' as bigint)").alias("n")))


@query(f"WITH {EV}, names AS (SELECT {KEYS}, max('n' || (p % 10)) AS name, max(p) AS ms FROM ev WHERE p % 3 = 0 GROUP BY ALL), old AS (SELECT {KEYS}, CASE WHEN min(k) % 4 > 0 THEN min(k) % 2000 END AS ms FROM ev GROUP BY ALL) SELECT {KEYS}, CASE WHEN n.ms IS NOT NULL AND (old.ms IS NULL OR old.ms <= n.ms) THEN name ELSE 'old' END AS session_name, CASE WHEN n.ms IS NOT NULL AND (old.ms IS NULL OR old.ms <= n.ms) THEN n.ms ELSE old.ms END AS name_ms FROM old LEFT JOIN names n USING ({KEYS})", stored=True)
def name_sync(m):
    names = m.events.where("source_revision % 3 = 0").groupBy(*SESSION_KEY).agg(F.max(F.expr("concat('n', source_revision % 10)")).alias("session_name"), F.max("source_revision").alias("name_ms"))
    k = F.min(F.expr("cast(substring(session_id, 2) as bigint)"))
    old = m.events.groupBy(*SESSION_KEY).agg(F.lit("old").alias("session_name"), F.when(k % 4 > 0, k % 2000).alias("name_ms"))
    return merge.sync_names(old, names)


@query(f"WITH {EV}, {TREE}, {ATTR} SELECT * FROM attr", stored=True)
def turn_attribution_update(m):
    """Every seventh order's sessions were roots before, and have their parents now."""
    rows, links = save(m.turns, "turn_rows"), save(m.sessions, "session_rows")
    sent = save(projection.dispatches(rows, links), "sent")
    moved = F.expr("cast(substring(session_id, 2) as bigint) % 7 = 0")
    old = links.withColumn("parent_session_id", F.when(~moved, F.col("parent_session_id"))).withColumn("relation_state", F.when(moved, 0).otherwise(F.col("relation_state")))
    stored = save(attribution.attribute(rows, old, sent), "stored")
    return attribution.reattribute(stored, rows, links, sent, links.where(moved).select(*SESSION_KEY))


def _changed(m) -> DataFrame:
    """Models of the events have custom rates; each third event puts one for its model."""
    milli = lambda n: (n / 1000).cast("decimal(18,9)").alias("input_rate")
    known = m.events.where("normalized_model is not null")
    stored = known.groupBy(F.col("normalized_model").alias("model")).agg(milli(F.count("*") % 1000))
    put = known.where("source_revision % 3 = 0 and normalized_model > 'brand#3'").select(F.concat(F.lit(" "), F.upper("normalized_model")).alias("model"), milli(F.col("source_revision") % 1000), F.struct("occurred_ms", "dedup_key").alias("arrival"))
    return writes.change_overrides(stored, put, restore=[" Brand#22"])


@query(f"WITH {EV}, k AS (SELECT * FROM ev WHERE normalized_model IS NOT NULL), p AS (SELECT normalized_model AS model, max_by(source_revision % 1000, (occurred_ms, dedup_key)) AS m FROM k WHERE source_revision % 3 = 0 AND normalized_model > 'brand#3' GROUP BY 1), st AS (SELECT normalized_model AS model, count(*) % 1000 AS m FROM k WHERE normalized_model <> 'brand#22' GROUP BY 1) SELECT model, CAST(coalesce(p.m, st.m) AS INT) AS input_milli FROM st FULL JOIN p USING (model)", stored=True)
def override_changes(m):
    return _changed(m).select("model", (F.col("input_rate") * 1000).cast("int").alias("input_milli"))


@query(f"WITH {EV} SELECT agent_id, source_instance_id, dedup_key, CASE WHEN k % 2 = 0 THEN pico WHEN normalized_model = 'brand#11' THEN pico END AS estimated_cost, CASE WHEN k % 2 = 0 OR normalized_model = 'brand#11' THEN pricing_status ELSE 0 END AS pricing_status FROM ev", stored=True)
def price_bind(m):
    """Half the events have lost their price; those of one model are bound again."""
    lost = F.expr("cast(substring(session_id, 2) as bigint) % 2 = 1")
    bare = m.events.withColumns({"estimated_cost": F.when(~lost, F.col("estimated_cost")), "pricing_status": F.when(lost, 0).otherwise(F.col("pricing_status")), "pricing_missing": F.when(lost, 1).otherwise(F.col("pricing_missing"))})
    return writes.bind_unpriced(bare, m.rates, models=["Brand#11 "]).select(*EVENT_KEY, "estimated_cost", "pricing_status")


@query(f"WITH {EV} SELECT CASE WHEN normalized_model IN ('brand#11', 'brand#12') THEN 'brand#99' WHEN normalized_model = 'brand#13' THEN 'brand#98' ELSE normalized_model END AS model, count(*) AS n, 0 AS custom FROM ev GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('brand#11', 1, 1), ('brand#12', 1, 1), ('brand#98', 1, 1), ('brand#21', 1, 1)) x")
def model_rename(m):
    spark = m.events.sparkSession
    aliases = [spark.createDataFrame(x, "alias string, canonical string") for x in ([("brand#11", "brand#99"), ("brand#12", "brand#99")], [("brand#13", "brand#98")])]
    events = m.events.withColumn("provider_id", F.lit(None).cast("string"))
    renamed, overrides = writes.rename_models(events, m.rates.where("model in ('brand#11', 'brand#12', 'brand#13', 'brand#21')"), *aliases)
    a = renamed.groupBy(F.col("normalized_model").alias("model")).agg(F.count("*").alias("n")).withColumn("custom", F.lit(0))
    return a.unionByName(overrides.groupBy("model").agg(F.count("*").alias("n")).withColumn("custom", F.lit(1)))


@query("SELECT 'part-' || p_partkey AS model, CAST(min(round(p_retailprice * 100)) AS BIGINT) AS input_cents, CASE WHEN p_partkey % 3 = 1 THEN 1000 END AS long_threshold FROM part GROUP BY p_partkey")
def catalog_build(m):
    """A market of parts: qualified keys come second, and only one tier counts."""
    rows = m.orders.sparkSession.read.parquet(m.path + "/part.parquet")
    tier = "named_struct('threshold', 1000L, 'input', p_retailprice * 2, 'output', p_retailprice * 4)"
    market = rows.selectExpr("concat('Part-', p_partkey) model", "p_retailprice input", "cast(null as double) cached", "cast(null as double) write", "p_retailprice * 3 output", f"case p_partkey % 3 when 0 then array() when 1 then array({tier}) else array({tier}, {tier}) end tiers")
    other = market.withColumns({"model": F.concat(F.lit("a/"), "model"), "input": F.col("input") + 1})
    return writes.catalog_rates(market.unionByName(other)).select("model", F.round(F.col("input_rate") * 100).cast("bigint").alias("input_cents"), "long_threshold")


@query(f"WITH {EV}, v AS (SELECT DISTINCT 'a' || (p % 200) AS alias, 'm' || (p % CASE WHEN p % 200 < 50 THEN 3 ELSE 200 END) AS canonical, 's' || (s % 4) AS source FROM ev) SELECT alias, min(canonical) AS canonical FROM v GROUP BY 1 HAVING count(DISTINCT canonical) = 1 AND count(DISTINCT source) >= 2")
def alias_votes(m):
    p = "source_revision"
    return writes.voted_aliases(m.events.selectExpr(f"concat('A', {p} % 200) alias", f"concat('m', {p} % if({p} % 200 < 50, 3, 200)) canonical", "concat('s', arrival_s % 4) source"), least=2)


@query(
    "WITH f AS (SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part), one AS (SELECT 'gpt-' || (k // 2) AS model, CASE WHEN k % 2 = 0 THEN 'openai' ELSE 'azure' END AS origin, c, k % 5 AS t FROM f WHERE k % 3 > 0), "
    "a AS (SELECT model, 'models.dev:' || origin || '/' || model AS rule_id, c AS input_cents, CASE WHEN t = 1 THEN 1000 END AS long_threshold FROM one WHERE t IN (0, 1, 4) QUALIFY row_number() OVER (PARTITION BY model ORDER BY origin DESC) = 1), "
    "two AS (SELECT 'gpt-' || (k // 2) AS model, CASE WHEN k % 2 = 0 THEN '' ELSE 'openai/' END AS route, c + 1 AS c, k % 5 AS t FROM f WHERE k % 7 > 0 AND k % 6 <> 5), "
    "b AS (SELECT model, 'litellm:' || route || model, c, CASE WHEN t = 4 THEN 128000 END FROM two WHERE model NOT IN (SELECT model FROM one) OR model IN (SELECT model FROM one WHERE origin = 'openai') QUALIFY row_number() OVER (PARTITION BY model ORDER BY route) = 1) "
    "SELECT * FROM a UNION ALL SELECT * FROM b WHERE model NOT IN (SELECT model FROM a)"
)
def ranked_rules(m):
    """Two sources price parts: models of two parts each, some known to one source alone, under
    other origins, in other modes or with tiers that don't fit."""
    spark = m.orders.sparkSession
    parts = spark.read.parquet(m.path + "/part.parquet").selectExpr("p_partkey k", "cast(round(p_retailprice * 100) as bigint) c", "concat('gpt-', p_partkey div 2) model")
    money = lambda cents: f"cast(cast({cents} as decimal(18,9)) / 100 as decimal(18,9))"
    none = "cast(null as decimal(18,9))"
    tier = lambda i, o: f"named_struct('kind', 'context', 'threshold', 1000L, 'input', {money(i)}, 'output', {money(o)}, 'cached', {none}, 'write', {none})"
    first = parts.where("k % 3 > 0").selectExpr("concat(if(k % 2 = 0, 'OpenAI/', 'azure/'), model) key", f"{money('c')} input", f"{none} cached", f"{none} write", f"{money('c * 3')} output",
        f"case k % 5 when 1 then array({tier('c * 2', 'c * 6')}) when 2 then array({tier('c', 'c * 3')}, {tier('c * 2', 'c * 6')}) when 3 then array({tier('c - 1', 'c * 3')}) end tiers")
    low = f"named_struct('threshold', 128000L, 'input', {money('c + 1')} * 2, 'output', {money('c * 3')} * 2)"
    second = parts.selectExpr("concat(if(k % 2 = 0, '', 'openai/'), model) key", "if(k % 7 = 0, 'other', 'openai') provider", "if(k % 6 = 5, 'embedding', 'chat') mode", f"{money('c + 1')} input", f"{none} cached", f"{none} write", f"{money('c * 3')} output", f"case when k % 5 = 4 then array({low}) end tiers")
    rules = catalogs.market_rules(save(first, "first"), save(second, "second"), spark.createDataFrame([], "alias string, canonical string"))["rules"]
    return rules.select("model", "rule_id", F.round(F.col("input_rate") * 100).cast("bigint").alias("input_cents"), "long_threshold")


@query(
    f"WITH {EV}, v AS (SELECT DISTINCT 'a' || (p % 200) AS alias, 'm' || CASE WHEN p % 200 < 50 THEN k % 3 WHEN p % 200 < 120 AND k % 2 = 1 THEN 7 WHEN p % 200 < 120 THEN 6 ELSE p % 200 END AS canonical, 's' || (s % 4) AS source, k % 2 AS h, k % 3 AS g FROM ev WHERE k % 2 = 0 OR p % 200 > 60), "
    "o AS (SELECT alias, min(canonical) AS c, string_agg(DISTINCT source, ',' ORDER BY source) AS src FROM v WHERE h = 0 GROUP BY 1 HAVING count(DISTINCT canonical) = 1), n AS (SELECT alias, min(canonical) AS c, string_agg(DISTINCT source, ',' ORDER BY source) AS src FROM v WHERE h = 1 OR g = 1 AND alias > 'a12' GROUP BY 1 HAVING count(DISTINCT canonical) = 1) "
    "SELECT alias, CASE WHEN o.alias IS NULL THEN 'added' WHEN n.alias IS NULL THEN 'removed' WHEN o.c <> n.c THEN 'retargeted' ELSE 'evidence' END AS change FROM (SELECT alias FROM o UNION SELECT alias FROM n) LEFT JOIN o USING (alias) LEFT JOIN n USING (alias) WHERE o.c IS DISTINCT FROM n.c OR o.src IS DISTINCT FROM n.src"
)
def alias_update(m):
    """Aliases that the events of even orders and those of later ones give, and how they changed."""
    p, k = "source_revision", "cast(substring(session_id, 2) as bigint)"
    canonical = f"concat('m', case when {p} % 200 < 50 then {k} % 3 when {p} % 200 < 120 and {k} % 2 = 1 then 7 when {p} % 200 < 120 then 6 else {p} % 200 end)"
    said = m.events.where(f"{k} % 2 = 0 or {p} % 200 > 60").selectExpr(f"concat('A', {p} % 200) alias", f"{canonical} canonical", "concat('s', arrival_s % 4) source", f"{k} % 2 h", f"{k} % 3 g")
    old, new = (catalogs.alias_catalog(said.where(x))[0] for x in ("h = 0", "h = 1 or (g = 1 and alias > 'A12')"))
    return catalogs.alias_changes(old, new)


# --- details and figures -------------------------------------------------------------


@query(f"WITH {EV}, {TREE}, {ATTR} SELECT count(*) AS calls, count(prompt_turn) AS attributed, count(DISTINCT CASE WHEN prompt_turn IS NOT NULL THEN agent_id || chr(31) || source_instance_id || chr(31) || root_session_id || chr(31) || prompt_turn END) AS prompts, CASE WHEN count(*) = 0 THEN 0 WHEN count(prompt_turn) = count(*) THEN 1 WHEN count(prompt_turn) = 0 THEN 3 ELSE 2 END AS status FROM at_ev WHERE {IN}", stored=True)
def turn_coverage_overall(m):
    return usage.turn_coverage_overall(_attributed(m), TWO_YEARS)


@query(f"WITH {EV}, {TREE}, own AS (SELECT ev.*, depth FROM ev JOIN tree USING ({KEYS}) WHERE {IN} AND root_session_id = 's64' AND agent_id = 'agent-1' AND source_instance_id = 'agent-1:1') SELECT 'root' AS part, NULL AS session_id, NULL AS model, count(*) AS requests FROM own HAVING count(*) > 0 UNION ALL SELECT 'session_models', session_id, {MODEL}, count(*) FROM own GROUP BY ALL UNION ALL SELECT 'models', NULL, {MODEL}, count(*) FROM own GROUP BY ALL "
       f"UNION ALL SELECT 'sessions', t.session_id, NULL, count(o.dedup_key) FROM tree t LEFT JOIN own o ON o.session_id = t.session_id WHERE t.root_session_id = 's64' AND t.agent_id = 'agent-1' AND t.source_instance_id = 'agent-1:1' GROUP BY ALL", stored=True)
def root_detail(m):
    parts = usage.root_detail(m.events, m.sessions, _tree(m), TWO_YEARS, ("agent-1", "agent-1:1", "s64"))
    none = F.lit(None).cast("string")
    out = [rows.select(F.lit(name).alias("part"), F.col("session_id") if "session_id" in rows.columns else none.alias("session_id"), F.col("model") if "model" in rows.columns else none.alias("model"), "requests") for name, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"WITH {EV}, {TREE}, below AS (WITH RECURSIVE d AS (SELECT {KEYS} FROM every_one WHERE session_id = 's66' AND agent_id = 'agent-1' UNION SELECT c.agent_id, c.source_instance_id, c.session_id FROM every_one c JOIN d ON c.agent_id = d.agent_id AND c.source_instance_id = d.source_instance_id AND c.parent_session_id = d.session_id WHERE c.relation_state = 1) SELECT * FROM d) SELECT {MODEL} AS model, count(*) AS requests FROM ev JOIN below USING ({KEYS}) WHERE {IN} GROUP BY 1", stored=True)
def subtree_models(m):
    """Usage below a session that is no root."""
    f = replace(TWO_YEARS, root_agent="agent-1", root_instance="agent-1:1", root_session="s66")
    return usage.by(m.events, f, "model", session_rows=m.sessions).select("model", "requests")


@query(f"WITH {EV}, d AS (SELECT project_id AS project, CAST(to_timestamp(occurred_ms // 1000) AS DATE) AS bucket, CAST(sum(tool_value) AS BIGINT) AS v FROM ev WHERE {IN} AND project_id IS NOT NULL AND session_id LIKE 's%7' GROUP BY 1, 2), k AS (SELECT project, bool_or(v IS NOT NULL) AS known FROM d GROUP BY 1) "
       "SELECT k.project, CAST(c.d AS DATE) AS bucket, coalesce(d.v, CASE WHEN known THEN 0 END) AS v FROM k CROSS JOIN range(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 1 DAY) c(d) LEFT JOIN d ON d.project = k.project AND d.bucket = CAST(c.d AS DATE)")
def project_gap_fill(m):
    days = TWO_YEARS.apply(m.events).where("project_id is not null and session_id like 's%7'").groupBy(F.col("project_id").alias("project"), derive.local_bucket(F.col("occurred_ms"), "day", "UTC").alias("bucket")).agg(F.sum("tool_value").alias("v"))
    return derive.fill_known(days, date(1996, 1, 1), date(1998, 1, 1), "day", "project", ["v"])


@query(f"WITH {EV} SELECT agent_id, CAST(sum(pico) FILTER (pricing_status IN (1, 2)) AS BIGINT) AS cost, count(*) FILTER (pricing_status = 1) AS priced, count(*) FILTER (pricing_status = 2) AS partly_priced, count(*) FILTER (pricing_status = 0) AS unpriced, coalesce(bit_or(pricing_missing), 0) AS missing FROM ev WHERE {IN} GROUP BY 1")
def pricing_merge(m):
    """Prices by hour, merged by agent."""
    hours = TWO_YEARS.apply(m.events).groupBy("agent_id", E.hour_bucket().alias("bucket_ms")).agg(*E.pricing())
    return derive.merge_pricing(hours, "agent_id")


@query(f"WITH {EV}, a AS (SELECT agent_id, CAST(sum(normalized_total_value) AS BIGINT) AS total, min(occurred_ms) AS f, max(occurred_ms) AS l FROM ev WHERE {IN} GROUP BY 1) SELECT agent_id, (2 * total + d) // (2 * d) AS average FROM (SELECT *, date_diff('day', CAST(timezone('{ZONE}', to_timestamp(f // 1000)) AS DATE), CAST(timezone('{ZONE}', to_timestamp(l // 1000)) AS DATE)) + 1 AS d FROM a)")
def daily_average(m):
    rows = usage.by(m.events, TWO_YEARS, "agent_id")
    return rows.select("agent_id", derive.daily_average(F.col("normalized_total"), F.col("first_ms"), F.col("last_ms") + 1, ZONE).alias("average"))


@query(f"WITH {EV}, a AS (SELECT agent_id, {MODEL} AS model, CAST(sum(tool_value) AS BIGINT) AS v FROM ev WHERE {IN} GROUP BY 1, 2) SELECT agent_id, model, v, CASE WHEN (SELECT bool_and(v IS NOT NULL) FROM a) AND (SELECT sum(v) FROM a) > 0 THEN v * 1000000 // (SELECT CAST(sum(v) AS BIGINT) FROM a) END AS share FROM a")
def model_shares(m):
    rows = usage.by(m.events, TWO_YEARS, "agent_id", "model").select("agent_id", "model", F.col("tool").alias("v"))
    return derive.shares(rows, "v")


@query(f"WITH {EV}, {TREE}, {PROJECTS} SELECT project, row_number() OVER (ORDER BY last_ms DESC, lower(coalesce(path, project)), project) AS recent, row_number() OVER (ORDER BY normalized_total DESC NULLS LAST, lower(coalesce(path, project)), project) AS tokens, row_number() OVER (ORDER BY lower(coalesce(path, project)), project) AS name FROM prj", stored=True)
def project_order(m):
    rows = save(usage.projects(m.events, _tree(m), TWO_YEARS), "projects")
    a, b, c = (derive.ordered(rows, by).select("project", F.col("rank").alias(by)) for by in ("recent", "tokens", "name"))
    return a.join(b, "project").join(c, "project")


@query(
    f"WITH {EV}, a AS (SELECT agent_id, {MODEL} AS model, CAST(sum(pico) FILTER (pricing_status > 0) AS HUGEINT) AS x, count(*) FILTER (pricing_status = 1) AS whole, count(*) FILTER (pricing_status = 2) AS part, count(*) FILTER (pricing_status = 0) AS none FROM ev WHERE {IN} GROUP BY 1, 2) "
    "SELECT agent_id, model, CASE WHEN whole + part = 0 THEN '未计价' WHEN x IS NULL THEN '—' WHEN x <= 0 THEN '$0.00' WHEN x >= 10000000000 THEN '$' || ((x + 5000000000) // 1000000000000) || '.' || printf('%02d', CAST((x + 5000000000) // 10000000000 % 100 AS BIGINT)) ELSE '$0.' || printf('%04d', CAST((x + 50000000) // 100000000 AS BIGINT)) END AS shown FROM a"
)
def price_text(m):
    """Prices of agents and models as they are shown."""
    rows = TWO_YEARS.apply(m.events).groupBy("agent_id", E.model().alias("model")).agg(*E.pricing())
    return rows.select("agent_id", "model", derive.shown_price(F.col("cost"), E.pricing_coverage()).alias("shown"))

