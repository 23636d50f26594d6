"""Kimi's wire logs: steps and usage records, and the prompts that turns go back to."""

import json
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlight.functions.identity import identity_hash
from meterlight.plans import queries
from meterlight.sources import wires

SF, START = "/root/testdata/sf0.001", 1_754_012_800_000
#: Counters of the published samples.
USAGE = {"inputOther": 10, "inputCacheRead": 4, "inputCacheCreation": 2, "output": 7}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["kimi_calls", "kimi_turns", "kimi_tools", "kimi_sessions"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    want = sorted(map(str, got.fetchall()))
    assert want and sorted(str(tuple(r)) for r in queries.queries()[name](spark, SF).select(*columns).collect()) == want


def meta(version="1.4"):
    return {"type": "metadata", "protocol_version": version, "created_at": START}


def line(kind, time, **more):
    return {"type": kind, "time": START + time} | more


def prompt(text="ask", time=100, origin="user", kind="turn.prompt"):
    return line(kind, time, origin=origin, input=[{"type": "image_url"}, {"type": "text", "text": text}])


def event(kind, time, step, turn, **more):
    return line("context.append_loop_event", time, event={"type": kind, "turnId": turn} | ({"stepUuid": step} if kind == "tool.call" else {"uuid": step}) | more)


def begin(step="step-1", turn="turn-1", time=200):
    return event("step.begin", time, step, turn)


def end(step="step-1", turn="turn-1", time=300, **more):
    return event("step.end", time, step, turn, usage=USAGE | more, messageId="m")


def tool(id_="tool-1", step="step-1", turn="turn-1", name="Read"):
    return event("tool.call", 220, step, turn, toolCallId=id_, name=name)


def usage(time=301, scope="turn", **more):
    return line("usage.record", time, usageScope=scope, model="kimi-code/k3-256k", usage=USAGE | more)


def step(turn, time, ends=True):
    return [begin(f"step-{turn}", turn, time), end(f"step-{turn}", turn, time + 80), usage(time + 81)][: 3 if ends else 1]


def message(kind, time, **more):
    return line("context.append_message", time, message={"role": "user", "origin": {"kind": kind} | more})


def goal(id_, time):
    return line("goal.create", time, **({"goalId": id_} if id_ else {}))


REQUEST, RESUMED = line("llm.request", 210, model="k3-256k"), {"name": "goal_continuation"}


def tables(spark, *files):
    rows = [(f"f{n}", f"/x/session_s{n}/agents/main/wire.jsonl", i + 1, r if isinstance(r, str) else json.dumps(r)) for n, file in enumerate(files) for i, r in enumerate(file)]
    return wires.kimi_tables(spark.createDataFrame(rows, "entity string, path string, line long, value string").repartition(3))


def turns(spark, *files):
    """By file and turn: (whether it is another's, messages, preview, origin)."""
    names = sorted({r["event"]["turnId"] for file in files for r in file if isinstance(r, dict) and "event" in r})
    hashes = {x[1]: x[0] for x in spark.createDataFrame([(n,) for n in names], "n string").select("n", identity_hash("kimi-code-turn", F.col("n"))).collect()}
    return {(r["entity"], hashes[r["turn_id"]]): (r["user_messages"], r["preview"], hashes.get(r["prompt_origin_turn"])) for r in tables(spark, *files)["turns"].collect()}


def test_call_of_a_step_and_its_usage(spark):
    steer = prompt("private", 250, kind="turn.steer")
    files = (
        [meta(), prompt("  " + "界" * 116 + " x tail "), begin(), REQUEST, tool(), tool(), tool("other", "step-2"), steer, end(), usage(), usage(scope="session")],
        [meta("1.5"), prompt(), begin(), REQUEST, usage(), tool(), end()],
    )
    got = tables(spark, *files)
    calls = {r["entity"]: r for r in got["events"].collect()}
    assert {e: (r["line"], r["input_reported_value"], r["uncached_input_value"], r["cache_read_value"], r["cache_write_value"], r["output_value"], r["normalized_total_value"], r["raw_model"], r["normalized_model"], r["route_model_id"]) for e, r in calls.items()} == {
        e: (at, 16, 10, 4, 2, 7, 23, "k3-256k", "kimi-k3-256k", "kimi-code/k3-256k") for e, at in (("f0", 10), ("f1", 7))
    }
    assert calls["f0"]["session_id"] == "s0" and calls["f0"]["completion_state"] == 1 and calls["f0"]["occurred_ms"] == START + 300
    assert sorted((r["entity"], r["tool_name"], r["dedup_key"] == calls[r["entity"]]["dedup_key"]) for r in got["tools"].collect()) == [("f0", "Read", True), ("f1", "Read", True)]
    first = next(r for r in got["turns"].collect() if r["entity"] == "f0")
    assert first["user_messages"] == 2 and first["preview"] == "[图片] " + "界" * 115 and first["start_ms"] == START + 100 and first["completed_ms"] == START + 300
    assert {r["compatibility"] for r in got["sessions"].collect()} == {0}


def test_what_makes_no_call(spark):
    files = [
        [meta("2.0"), prompt(), begin(), end(), usage()], [meta(), prompt(), begin(), end(), usage(output=8)], [meta("1.5"), prompt(), begin(), usage(output=8), end()],
        [meta(), prompt(), begin(), end(), end(), usage()], [meta(), begin(), usage(), usage(), end()], [meta(), begin(), end(), begin("step-2"), usage()], [meta(), begin(), end(), prompt(), usage()],
        [meta(), begin(), "{broken", end("step-2"), usage()], [meta(), begin(), usage(), end(output=1 << 63)], [prompt(), begin(), end(), usage()],
    ]
    got = tables(spark, *files)
    assert got["events"].count() == 0 and got["tools"].count() == 0
    assert {r["entity"]: r["compatibility"] for r in got["sessions"].collect()} == {f"f{n}": 0 if n == 5 else 2 for n in range(10)}
    # A third record waits again; one that is not whole takes the one before it away.
    got = tables(spark, [meta(), begin(), usage(), usage(), usage(), end()], [meta(), begin(), usage(), usage(output=-1), end(), usage()])
    assert sorted((r["entity"], r["line"]) for r in got["events"].collect()) == [("f0", 6), ("f1", 6)]
    none = tables(spark, [meta()])
    assert [none[x].count() for x in ("events", "turns", "tools", "sessions")] == [0, 0, 0, 1]


def test_turns_go_back_to_the_prompt_of_a_goal_a_task_or_background_work(spark):
    task = {"kind": "task", "taskId": "task-1"}
    started = line("task.started", 220, info={"taskId": "task-1"})
    back = {"kind": "background_task", "taskId": "task-1"}
    files = [
        [meta("1.5"), prompt("first"), begin("s", "user"), started, end("s", "user"), usage(), prompt("x", 400, task), *step("task", 420), prompt("second", 600), *step("second", 620)],
        [meta(), prompt(), begin("s", "user"), goal("g", 210), end("s", "user"), usage(), message("system_trigger", 400, **RESUMED), message("injection", 410), *step("auto", 420), line("goal.clear", 510), message("system_trigger", 600, **RESUMED), *step("orphan", 620)],
        [meta(), prompt(), *step("user", 200), prompt("x", 400, back, "turn.steer"), message("background_task", 410), *step("background", 420)],
        [meta(), prompt(), *step("user", 200), prompt("x", 400, back, "turn.steer"), message("background_task", 410), *step("user", 420)],
        [meta(), prompt(), begin("s", "user"), goal("g", 210), end("s", "user"), usage(), goal("h", 350), message("system_trigger", 400, **RESUMED), *step("conflict", 420), line("goal.clear", 510), prompt("again", 520), begin("r", "recovery", 600), goal("i", 610), end("r", "recovery", 700), usage(701), message("system_trigger", 800, **RESUMED), *step("auto", 820)],
    ]
    image = "[图片] "
    assert turns(spark, *files) == {
        ("f0", "user"): (1, image + "first", None), ("f0", "task"): (0, None, "user"), ("f0", "second"): (1, image + "second", None),
        ("f1", "user"): (1, image + "ask", None), ("f1", "auto"): (0, None, "user"), ("f1", "orphan"): (0, None, None),
        ("f2", "user"): (1, image + "ask", None), ("f2", "background"): (0, None, "user"), ("f3", "user"): (1, image + "ask", None),
        ("f4", "user"): (1, image + "ask", None), ("f4", "conflict"): (0, None, None), ("f4", "recovery"): (1, image + "again", None), ("f4", "auto"): (0, None, "recovery"),
    }


def test_goals_before_their_step_and_conflicts(spark):
    started = lambda time: line("task.started", time, info={"taskId": "t"})
    notice = prompt("x", 400, {"kind": "task", "taskId": "t"})
    resumed, back = message("system_trigger", 400, **RESUMED), message("background_task", 410)
    files = [
        [meta(), prompt(), goal("g", 150), *step("a", 200), resumed, *step("b", 420)],  # the goal waits for the prompt's step
        [meta(), goal("g", 50), prompt(), *step("a", 200), resumed, *step("b", 420)],  # a goal of no prompt
        [meta(), prompt(), goal("g", 150), *step("a", 200), resumed, resumed, *step("b", 420)],  # continued twice
        [meta(), prompt(), goal("g", 150), *step("a", 200), resumed, back, *step("b", 420), back, *step("c", 600)],  # agreeing; then a chain
        [meta(), prompt(), begin("s", "a"), started(210), prompt("y", 300), begin("u", "b"), started(310), notice, *step("c", 420)],  # started by two prompts
        [meta(), prompt(), begin("s", "a"), started(210), notice, *step("b", 420), notice, *step("c", 600)],  # a task is told of once
        [meta(), prompt(), *step("a", 200), back, prompt("y", 500), *step("b", 520)],  # a prompt ends what went before
    ]
    got = {k: v[2] for k, v in turns(spark, *files).items()}
    want = {("f0", "b"): "a", ("f1", "b"): None, ("f2", "b"): None, ("f3", "b"): "a", ("f3", "c"): "a", ("f4", "c"): None, ("f5", "b"): "a", ("f5", "c"): None, ("f6", "b"): None}
    assert {k: got[k] for k in want} == want


def plain_pairs(file):
    """Lines that complete calls, read one after the other."""
    step_, waiting, offered, out = None, None, None, []
    for n, r in enumerate(file, 1):
        if r["type"] == "turn.prompt":
            step_ = waiting = offered = None
        elif r["type"] == "usage.record":
            if waiting is not None:
                out += [n] * (waiting == r["usage"])
                waiting = None
            else:
                offered = r["usage"] if step_ and offered is None else None
        elif r["event"]["type"] == "step.begin":
            step_, waiting, offered = (r["event"]["uuid"], r["event"]["turnId"]), None, None
        else:
            if step_ != (r["event"]["uuid"], r["event"]["turnId"]):
                waiting = offered = step_ = None
                continue
            if offered is None:
                waiting = r["event"]["usage"]
            else:
                out += [n] * (offered == r["event"]["usage"])
                waiting = None
            step_ = offered = None
    return out


def test_random_files_pair_as_read_in_order(spark):
    rng = random.Random(5)
    files = []
    for _ in range(30):
        make = lambda: rng.choice([lambda: begin(rng.choice("aaab"), "t"), lambda: begin("a", "t"), lambda: end(rng.choice("aaab"), "t"), lambda: end("a", "t", output=rng.choice([7, 7, 8])), usage, usage, lambda: usage(output=rng.choice([7, 8])), prompt][: rng.choice([6, 7, 8])])()
        files.append([make() for _ in range(120)])
    got = {(r["entity"], r["line"] - 1) for r in tables(spark, *[[meta(), *f] for f in files])["events"].collect()}
    want = {(f"f{n}", at) for n, f in enumerate(files) for at in plain_pairs(f)}
    assert got == want and len(want) > 150
