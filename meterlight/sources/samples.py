"""Logs of each source made from TPC-H-like rows, as (entity, line, value): inputs of the
source queries. Entities are orders; lines follow (line number, part, supplier, cents)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlight.sources.projection import base_rows


def numbered(spark, sf_dir: str) -> DataFrame:
    """k, n, q, p, s, cents, flag, day_ms, and the number i of the row in its order, from 1."""
    rows = base_rows(spark, sf_dir).drop("brand", "p_size")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("n", "p", "s", "cents")).cast("bigint"))


def _lines(rows: DataFrame, value: str, line: str = "i") -> DataFrame:
    return rows.selectExpr("concat('o', k) entity", f"{line} line", f"{value} value").where("value is not null")


_AT = "date_format(timestamp_millis(day_ms + i * 1000), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def claude(rows: DataFrame) -> DataFrame:
    """A prompt before every third call, and a tool in each call's line; the session is named in the first line alone. Some
    lines are not JSON, lack a counter or have one that isn't whole."""
    prompt = f"""to_json(named_struct('type', 'user', 'sessionId', if(i = 1, concat('s', k), null), 'timestamp', {_AT}, 'promptId', concat('p', k, '-', i), 'isSidechain', s % 3 = 0,
      'message', named_struct('role', 'user', 'content', concat(' Say  ', q, '\\n\\t please '))))"""
    call = f"""case when s % 11 = 0 then '{{broken' else regexp_replace(to_json(named_struct('type', 'assistant', 'timestamp', {_AT}, 'cwd', concat('/work/p', k % 7, '/'), 'message', named_struct('role', 'assistant', 'id', concat('m', k, '-', i div 2), 'model', ' Model-A', 'stop_reason', if(s % 5 = 0, 'end', null), 'content', array(named_struct('type', 'tool_use', 'id', concat('t', k, '-', s % 2), 'name', concat('Tool', p % 5))),
      'usage', named_struct('input_tokens', q * 10, 'cache_read_input_tokens', s, 'cache_creation_input_tokens', if(p % 13 = 0, null, p % 7), 'output_tokens', if(q % 4 = 0, 0, q))))), if(p % 17 = 0, '"input_tokens":([0-9]+)', 'no such'), '"input_tokens":$1.5') end"""
    users = _lines(rows.where("i % 3 = 1"), prompt, "i * 2 - 1")
    return users.union(_lines(rows, call, "i * 2"))


def qwen(rows: DataFrame) -> DataFrame:
    value = f"""case when i % 4 = 1 then to_json(named_struct('type', 'user', 'uuid', concat('u', k, '-', i), 'sessionId', concat('s', k), 'timestamp', {_AT}))
      else to_json(named_struct('type', 'assistant', 'uuid', concat('a', k, '-', i), 'sessionId', concat('s', k), 'timestamp', {_AT}, 'model', if(s % 7 = 0, null, 'qwen-x'), 'usageMetadata',
        named_struct('promptTokenCount', q * 3, 'candidatesTokenCount', q + s % 5, 'thoughtsTokenCount', s % 5, 'cachedContentTokenCount', if(s % 9 = 0, q * 4, q), 'totalTokenCount', q * 4 + s % 5 + if(p % 10 = 0, 1, 0)))) end"""
    return _lines(rows, value)


def workbuddy(rows: DataFrame) -> DataFrame:
    """Cache (p % 4) and reasoning (s % 4) lie in input and output, or beside them, by i."""
    cache, thought = "p % 4", "s % 4"
    total = f"(q + 10) + (q + 20) + case i % 4 when 0 then 0 when 1 then {cache} when 2 then {thought} else {cache} + {thought} end"
    value = f"""to_json(named_struct('id', concat('w', k, '-', i), 'timestamp', day_ms + i, 'type', 'message', 'role', 'assistant', 'sessionId', concat('s', k), 'providerData', named_struct('model', 'WB-1', 'usage',
      named_struct('inputTokens', q + 10, 'totalTokens', {total} + if(p % 19 = 0, 100, 0)), 'rawUsage', named_struct('completion_tokens', q + 20, 'cached_tokens', {cache}, 'completion_tokens_details', named_struct('reasoning_tokens', {thought})))))"""
    return _lines(rows, value)


def chains(rows: DataFrame) -> DataFrame:
    """A prompt before every three calls; calls follow the record before them, or the prompt
    (s % 3 = 0), or none that is there (s % 7 = 0)."""
    parent = "case when s % 7 = 0 then 'none' when s % 3 = 0 then concat('w', k, '-', i - (i - 1) % 4) else concat('w', k, '-', i - 1) end"
    value = f"""case when i % 4 = 1 then to_json(named_struct('id', concat('w', k, '-', i), 'timestamp', day_ms + i, 'type', 'message', 'role', 'user', 'sessionId', concat('s', k), 'content', concat(' Do  ', q)))
      else to_json(named_struct('id', concat('w', k, '-', i), 'parentId', {parent}, 'timestamp', day_ms + i, 'type', 'message', 'role', 'assistant', 'sessionId', concat('s', k), 'providerData', named_struct('model', 'WB-1', 'usage', named_struct('inputTokens', q, 'outputTokens', q, 'totalTokens', q * 2)))) end"""
    return _lines(rows, value)


def codex(rows: DataFrame) -> DataFrame:
    """Cumulative counters that grow by q * 10 and q; they start anew after every fourth call
    of an order, stand still where s % 6 = 0, and the last call's own come where p % 2 = 0."""
    own = Window.partitionBy("k", F.expr("(i - 1) div 4")).orderBy("i")
    grown = rows.withColumn("g", F.expr("if(s % 6 = 0, 0, q)")).withColumn("sum", F.sum("g").over(own))
    meta = f"""to_json(named_struct('timestamp', {_AT}, 'type', 'session_meta', 'payload', named_struct('id', concat('s', k), 'cwd', concat('/work/p', k % 7), 'git', named_struct('repository_url', concat('https://Host.example/team/p', k % 7, '.git')))))"""
    context = f"""to_json(named_struct('timestamp', {_AT}, 'type', 'turn_context', 'payload', named_struct('model', 'openai/GPT-Test-2026-07-01')))"""
    value = f"""to_json(named_struct('timestamp', {_AT}, 'type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct(
      'last_token_usage', if(p % 2 = 0, named_struct('input_tokens', g * 10, 'cached_input_tokens', g * 3, 'output_tokens', g, 'reasoning_output_tokens', 0L, 'total_tokens', g * 11), null),
      'total_token_usage', named_struct('input_tokens', sum * 10, 'cached_input_tokens', sum * 3, 'output_tokens', sum, 'reasoning_output_tokens', 0L, 'total_tokens', sum * 11)))))"""
    first = grown.where("i = 1")
    return _lines(first, meta, "-1L").union(_lines(first, context, "0L")).union(_lines(grown, value))


def rollouts(rows: DataFrame) -> DataFrame:
    """A session for each order, every fourth a subagent of the one before; turns of three calls
    with a prompt, tools before calls, and spawned agents."""
    at = lambda kind, payload: f"to_json(named_struct('timestamp', {_AT}, 'type', '{kind}', 'payload', {payload}))"
    turn, sub = "concat('t', k, '-', i - (i - 1) % 3)", "k % 4 = 1"
    meta = f"named_struct('id', concat('s', k), 'cwd', concat('/work/p', k % 7), 'parent_thread_id', if({sub}, concat('s', k - 1), null), 'agent_path', if({sub}, concat('Root\\\\W', k, '/'), null), 'source', named_struct('subagent', if({sub}, named_struct('depth', 1), null)))"
    call = "named_struct('type', 'function_call', 'name', {}, 'call_id', concat('c', k, '-', i), 'arguments', to_json(named_struct('task_name', concat('/Root/W', k))))"
    usage = "named_struct('input_tokens', q * 10, 'cached_input_tokens', q * 3, 'output_tokens', q, 'reasoning_output_tokens', 0L, 'total_tokens', q * 11)"
    parts = [
        ("i = 1", 0, at("session_meta", meta)), ("i % 3 = 1", 1, at("turn_context", f"named_struct('turn_id', {turn}, 'model', 'gpt-test')")),
        ("i % 3 = 1", 2, at("event_msg", "named_struct('type', 'user_message', 'message', concat('  Ask ', q, '\\n please '))")),
        ("s % 3 > 0", 3, at("response_item", call.format("'shell'"))), ("s % 5 = 0", 4, at("response_item", call.format("'spawn_agent'"))),
        ("true", 5, at("event_msg", f"named_struct('type', 'token_count', 'info', named_struct('usage_id', concat('u', k, '-', i), 'last_token_usage', {usage}))")),
        ("i % 3 = 0", 6, at("event_msg", f"named_struct('type', 'task_complete', 'turn_id', {turn})")),
    ]
    # One pass over the rows: each makes the lines that it has.
    lines = ", ".join(f"if({when}, named_struct('line', i * 10L + {place}, 'value', {value}), null)" for when, place, value in parts)
    made = rows.selectExpr("concat('o', k) entity", f"explode(array({lines})) x").where("x is not null")
    return made.select("entity", "x.line", "x.value")


def kimi(rows: DataFrame) -> DataFrame:
    """A session for each order and a turn for every two calls, which a prompt, background work or
    the notice of a task opens; some tasks were never started, some usage records differ."""
    at = "day_ms + i"
    line = lambda kind, fields: f"to_json(named_struct('type', '{kind}', 'time', {at}, {fields}))"
    event = lambda kind, fields: line("context.append_loop_event", f"'event', named_struct('type', '{kind}', 'turnId', concat('t', k, '-', (i - 1) div 2), {fields})")
    usage = lambda more: f"'usage', named_struct('inputOther', q, 'inputCacheRead', s % 9, 'inputCacheCreation', 0L, 'output', p % 30 + {more})"
    step, record = "concat('st', k, '-', i)", line("usage.record", f"'usageScope', 'turn', 'model', 'kimi-code/k3-256k', {usage('if(s % 5 = 0, 1000, 0)')}")
    prompt, task = line("turn.prompt", "'origin', 'user', 'input', array(named_struct('type', 'text', 'text', concat(' Do  ', q)))"), "concat('k', k, '-', i {})"
    notice = line("turn.prompt", f"'origin', named_struct('kind', if(s % 3 = 1, 'background_task', 'task'), 'taskId', {task.format('- 1')})")
    parts = [
        ("i = 1", 0, "to_json(named_struct('type', 'metadata', 'protocol_version', '1.5', 'created_at', day_ms))"), ("i = 1 or (i % 2 = 1 and s % 3 = 0)", 1, prompt), ("i > 1 and i % 2 = 1 and s % 3 > 0", 1, notice),
        ("true", 2, event("step.begin", f"'uuid', {step}")), ("q % 2 = 0", 3, line("llm.request", "'model', 'K3-256k'")), ("p % 2 = 0", 4, line("task.started", f"'info', named_struct('taskId', {task.format('')})")),
        ("s % 3 > 0", 5, event("tool.call", f"'stepUuid', {step}, 'toolCallId', concat('tc', k, '-', i), 'name', 'Read'")), ("p % 3 = 0", 6, record), ("true", 7, event("step.end", f"'uuid', {step}, 'messageId', 'm', {usage(0)}")), ("p % 3 > 0", 8, record),
    ]
    lines = ", ".join(f"if({when}, named_struct('line', i * 10L + {place}, 'value', {value}), null)" for when, place, value in parts)
    made = rows.selectExpr("concat('o', k) entity", "concat('session_s', k, '/agents/main/wire.jsonl') path", f"explode(array({lines})) x").where("x is not null")
    return made.select("entity", "path", "x.line", "x.value")


def gemini(rows: DataFrame) -> DataFrame:
    """Documents by order: lists of messages with tokens in official or older names."""
    official = "named_struct('promptTokenCount', q * 3, 'candidatesTokenCount', q, 'cachedContentTokenCount', s % 9, 'totalTokenCount', q * 4 + if(p % 10 = 0, 1, 0), 'input', null, 'output', null, 'cached', null, 'tool', null, 'total', null)"
    older = "named_struct('promptTokenCount', null, 'candidatesTokenCount', null, 'cachedContentTokenCount', null, 'totalTokenCount', null, 'input', q * 2, 'output', q, 'cached', s % 9, 'tool', p % 3, 'total', q * 3 + p % 3 + if(i % 4 = 1, s % 9, 0))"
    cast = "struct<promptTokenCount:bigint,candidatesTokenCount:bigint,cachedContentTokenCount:bigint,totalTokenCount:bigint,input:bigint,output:bigint,cached:bigint,tool:bigint,total:bigint>"
    message = f"named_struct('at', i, 'id', concat('g', n), 'timestamp', {_AT}, 'model', 'Gemini-X', 'tokens', if(i % 2 = 0, cast({official} as {cast}), cast({older} as {cast})))"
    documents = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.expr(message))).alias("messages"))
    return documents.select(F.concat(F.lit("o"), "k").alias("entity"), F.lit(1).cast("bigint").alias("line"), F.to_json(F.struct(F.concat(F.lit("s"), "k").alias("sessionId"), "messages")).alias("value"))


def opencode(rows: DataFrame) -> DataFrame:
    """Exported rows (id, session_id, data)."""
    data = """to_json(named_struct('role', 'assistant', 'modelID', 'OC-1', 'providerID', 'prov', 'time', named_struct('completed', day_ms + i), 'tokens', named_struct('input', q, 'output', s % 50, 'reasoning', if(p % 3 = 0, null, p % 5),
      'total', if(i % 3 = 0, q + s % 50 + if(p % 3 = 0, 0, p % 5) + q % 4 + if(p % 20 = 0, 1, 0), null), 'cache', named_struct('read', q % 4, 'write', 0L))))"""
    return rows.selectExpr("concat('c', k, '-', i) id", "concat('s', k) session_id", f"{data} data")
