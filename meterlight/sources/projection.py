"""The model's tables made from TPC-H-like tables, with integer arithmetic only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.operators import merge, pricing
from meterlight.schema import METRICS

AGENT = "concat('agent-', (k div 64) % 5)"
INSTANCE = f"concat({AGENT}, ':', (k div 64) % 3)"
#: Value of each metric; q is the quantity, p the part and s the supplier.
VALUES = {
    "input_reported": "q * 1000 + p % 997",
    "uncached_input": "q * 1000 + p % 997 - (q * 1000 + p % 997) * (s % 4) div 8",
    "cache_read": "(q * 1000 + p % 997) * (s % 4) div 8",
    "cache_write": "p % 50",
    "output": "q * 37 + s % 11",
    "reasoning": "(q * 37 + s % 11) div 4",
    "tool": "s % 3",
    "reported_total": "q * 1037 + p % 997 + s % 11",
    "normalized_total": "q * 1037 + p % 997 + s % 11",
}


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders with their part's brand and size, under short names."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").selectExpr(
        "l_orderkey k", "cast(l_linenumber as bigint) n", "cast(l_quantity as bigint) q", "l_partkey p", "l_suppkey s", "cast(round(l_extendedprice * 100) as bigint) cents",
        "l_returnflag flag", "unix_date(cast(l_shipdate as date)) * 86400000L day_ms", "p_brand brand", "p_size",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of events, with keys that repeat."""
    b = "(k div 64)"
    out = [
        f"{AGENT} agent_id", f"{INSTANCE} source_instance_id", "concat('s', k) session_id", "concat('t', k, ':', n div 3) turn_id", "concat(k, ':', n) dedup_key",
        f"concat('e', {b}) source_entity_id", "concat('v', k, ':', n % 3, ':', p) event_id", "p source_revision", "case flag when 'R' then 0 when 'A' then 1 else 2 end completion_state",
        f"case when {b} % 6 = 0 then null else concat('p', {b} % 12) end project_id",
        rf"case when {b} % 6 = 0 then null when k % 3 = 0 then concat('/work/p', {b} % 12) when k % 3 = 1 then concat(r'C:\work\p', {b} % 12) else concat(r'C:\u\.codex\worktrees\p', {b} % 12) end project_path",
        "day_ms + n * 3600000 + (p % 3600) * 1000 occurred_ms", "case when p_size % 17 = 0 then null else lower(brand) end normalized_model",
        "1 cache_included", "p arrival_p", "s arrival_s", "cents arrival_c",
    ]
    for i, m in enumerate(METRICS):
        gone, unknown = f"(k + n + {i}) % 13 = 0", f"(k + n + {i}) % 17 = 0"
        out += [f"case when {gone} or {unknown} then null else {VALUES[m]} end {m}_value", f"case when {gone} then 0 when {unknown} then 6 else 1 end {m}_origin"]
    return base_rows(spark, sf_dir).selectExpr(*out)


ARRIVAL = ["arrival_p", "arrival_s", "arrival_c"]


def rates(spark: SparkSession) -> DataFrame:
    """Rates of 25 models, some of them incomplete; three have none."""
    i = "(id div 5) * 5 + id % 5"
    return spark.range(25).where("id % 8 <> 7").selectExpr(
        "concat('brand#', id div 5 + 1, id % 5 + 1) model", f"cast(({i} + 1) / 10 as decimal(18,9)) input_rate", f"case when id % 4 = 0 then null else cast(({i} + 1) / 100 as decimal(18,9)) end cached_rate",
        f"case when id % 5 = 0 then null else cast(({i} + 1) / 8 as decimal(18,9)) end write_rate", f"cast(({i} + 1) / 2 as decimal(18,9)) output_rate",
        "case when id % 3 = 0 then 20000 end long_threshold", "cast(2 as decimal(9,6)) long_input", "cast(1.5 as decimal(9,6)) long_output",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest inside each block of 64 orders; some sessions have no row."""
    parent = "(k % 64 > 0 and k % 7 <> 0)"
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey k").where("k % 11 <> 0").selectExpr(
        f"{AGENT} agent_id", f"{INSTANCE} source_instance_id", "concat('s', k) session_id", f"case when {parent} then concat('s', k - k % 64 + (k % 64 - 1) div 3) end parent_session_id",
        f"cast({parent} as int) relation_state", f"cast({parent} as int) + 1 session_kind", "cast(k % 4 as int) session_role", "case when k % 2 = 0 then 4 else 1 end relation_origin",
        "concat('leaf', k) agent_leaf_hash", "concat('path', k) agent_path_hash",
    )


def turns(events: DataFrame) -> DataFrame:
    """A turn for each run of three lines of an order."""
    number = "cast(split_part(turn_id, ':', 2) as bigint)"
    order = "cast(substring(session_id, 2) as bigint)"
    grouped = events.groupBy("agent_id", "source_instance_id", "session_id", "turn_id").agg(F.min("occurred_ms").alias("start_ms"), F.max("occurred_ms").alias("last"), F.count("*").alias("user_messages"))
    return grouped.selectExpr(
        "agent_id", "source_instance_id", "session_id", "turn_id", "start_ms", f"case when {order} % 10 = 3 then null else last + 86400000 * 20 end completed_ms", "concat('prompt ', turn_id) preview", "user_messages",
        f"case when {number} > 0 and {order} % 5 = 0 then concat('t', {order}, ':', {number} - 1) end prompt_origin_turn",
    )


def dispatches(turn_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Calls from the first turn of a parent to the first and second turns of a child;
    every ninth child has two calls for its first turn."""
    child = turn_rows.join(session_rows.select("agent_id", "source_instance_id", "session_id", "parent_session_id").where("parent_session_id is not null"), ["agent_id", "source_instance_id", "session_id"])
    number, order = "cast(split_part(turn_id, ':', 2) as bigint)", "cast(substring(session_id, 2) as bigint)"
    first = child.where(f"{number} < 2").selectExpr(
        "agent_id", "source_instance_id", "parent_session_id source_session_id", "concat('t', substring(parent_session_id, 2), ':0') source_turn_id", f"cast({number} as int) kind", f"1 - cast({number} as int) target_kind",
        f"concat(case when {number} = 0 then 'leaf' else 'path' end, substring(session_id, 2)) target_hash", f"start_ms - 1000 * ({order} % 3) occurred_ms", f"{order} k",
    )
    return first.drop("k").union(first.where("k % 9 = 0 and kind = 0").drop("k"))


def tools(events: DataFrame) -> DataFrame:
    """Up to three tools of each event, in order."""
    return events.where("arrival_s % 4 > 0").selectExpr("agent_id", "source_instance_id", "dedup_key", "arrival_s", "explode(sequence(1, cast(arrival_s % 4 as int))) ordinal").selectExpr(
        "agent_id", "source_instance_id", "dedup_key", "ordinal", "concat('tool', (arrival_s + ordinal * ordinal) % 3) tool_name"
    )


@dataclass(frozen=True)
class Model:
    raw: DataFrame
    events: DataFrame
    sessions: DataFrame
    turns: DataFrame
    tools: DataFrame
    dispatches: DataFrame
    rates: DataFrame
    orders: DataFrame
    numbered: DataFrame
    conversations: DataFrame
    logged: DataFrame
    path: str


def load(spark: SparkSession, sf_dir: str, stored: bool = False) -> Model:
    """All tables; events are merged and priced, and kept where ``stored`` says that
    a query reads them more than once."""
    from meterlight.plans.tables import save
    from meterlight.sources import samples

    raw, of = raw_events(spark, sf_dir), rates(spark)
    events = pricing.estimate(merge.upsert_events(raw, ARRIVAL), of)
    events = save(events, "events") if stored else events
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    session_rows, turn_rows = sessions(spark, sf_dir), turns(events)
    return Model(raw, events, session_rows, turn_rows, tools(events), dispatches(turn_rows, session_rows), of, read("orders").selectExpr("o_orderkey k"), samples.numbered(spark, sf_dir), read("conversations"), read("events"), sf_dir)
