"""Source parsers on literal lines, the streaming commit, snapshots and queries against SQL."""

import json
import random
from datetime import UTC, date, datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlight.functions import identity, records
from meterlight.operators import derive, writes
from meterlight.plans import queries
from meterlight.sources import documents, lines, transcripts
from meterlight.streaming import commit
from meterlight.streaming.store import Store

SF = "/root/testdata/sf0.001"
SMALL = ["claude_calls", "codex_calls", "gemini_calls", "canonical_model", "repo_identity", "cursor_upsert", "model_rename", "cycle_cut", "subtree_models"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    want = sorted(map(str, got.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.queries()[name](spark, SF).select(*columns).collect()) == want


def test_every_query_but_streams_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def file_of(spark, rows, entity="f"):
    return spark.createDataFrame([(entity, i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "entity string, line long, value string")


def assistant(usage, **more):
    return {"type": "assistant", "timestamp": "2026-07-16T00:00:01Z", "message": {"role": "assistant", "id": "m1", "model": "Claude-X", "usage": usage} | more}


def test_streamed_message_is_one_call_and_wrong_counters_are_none(spark):
    usage = {"input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 2, "output_tokens": 7}
    rows = [
        {"type": "user", "sessionId": "s", "timestamp": "2026-07-16T00:00:00Z", "promptId": "p", "message": {"role": "user", "content": [{"type": "text", "text": "Look \n at"}, {"type": "image"}]}},
        assistant(usage | {"output_tokens": 0}), assistant(usage), "{not json", "[1]", assistant({k: v for k, v in usage.items() if k != "output_tokens"}), assistant(usage | {"input_tokens": 1.5}), assistant(usage | {"input_tokens": -1}),
        assistant(usage | {"input_tokens": (1 << 63) - 1}), assistant(usage | {"input_tokens": 1 << 64}), assistant(usage, model="<synthetic>", error="x"),
    ]
    got = transcripts.claude_calls(file_of(spark, rows)).orderBy("line").collect()
    assert [(r["line"], r["input_reported_value"], r["normalized_total_value"], r["completion_state"], r["session_id"]) for r in got] == [(2, 16, 16, 0, "s"), (3, 16, 23, 1, "s")]
    assert got[0]["dedup_key"] == got[1]["dedup_key"] and got[0]["normalized_model"] == "claude-x" and got[0]["tool_origin"] == 0
    turn = transcripts.claude_turns(file_of(spark, rows)).collect()
    assert [(t["preview"], t["user_messages"], t["start_ms"]) for t in turn] == [("Look at [图片]", 1, 1784160000000)]


def test_claude_sessions_turns_and_tools(spark):
    usage = {"input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 2, "output_tokens": 7}
    at = lambda n: f"2026-07-16T00:00:{n:02}Z"
    user = lambda n, id_, content, **more: {"type": "user", "timestamp": at(n), "promptId": id_, "message": {"role": "user", "content": content}} | more
    tool = lambda id_, name: {"type": "tool_use", "id": id_, "name": name}
    reply = lambda n, content, of="m1", **more: assistant(usage | more.pop("usage", {}), id=of, content=content, **more) | {"timestamp": at(n)}
    rows = [
        user(0, "p1", "First", sessionId="s", cwd="/work/p"), reply(1, [tool("t1", "Bash"), tool("t1", "Again"), tool(None, "x"), "text"], usage={"output_tokens": 0}), reply(2, [tool("t2", "Read"), tool("t1", "Bash2")]),
        user(3, "p1", [{"type": "tool_result", "content": "x"}, {"type": "text", "text": "more"}]), user(4, "p1", [{"type": "text", "text": " "}]), user(5, "p1", "aside", isSidechain=True), user(6, "p2", [{"type": "image"}], cwd="relative"),
        reply(7, [tool("t3", "None")], of="m2", usage={"input_tokens": None}), user(8, "p1", "Second time"), {"type": "ai-title", "timestamp": at(9), "aiTitle": " A  title "}, {"type": "ai-title", "timestamp": at(10), "aiTitle": ""},
        reply(11, "done", of="m3"), {"type": "summary", "timestamp": at(12)}, "{broken",
    ]
    made = transcripts.claude_tables(file_of(spark, rows))
    base = 1784160000000
    turns = {r["preview"]: (r["start_ms"] - base, r["completed_ms"] and r["completed_ms"] - base, r["user_messages"]) for r in made["turns"].collect()}
    assert turns == {"First": (0, 11000, 1), "[图片]": (6000, None, 1)}
    session = made["sessions"].collect()[0]
    assert (session["session_id"], session["compatibility"], session["project_path"], session["session_name"], session["name_ms"] - base, session["first_ms"] - base, session["last_ms"] - base) == ("s", 2, "/work/p", "A title", 9000, 0, 11000)
    assert sorted((r["tool_name"], r["source_revision"]) for r in made["tools"].collect()) == [("Bash2", 3), ("Read", 3)]
    assert made["events"].count() == 3 and {r["project_path"] for r in made["events"].collect()} == {"/work/p"}
    bare = transcripts.claude_tables(file_of(spark, [{"type": "user", "sessionId": "s", "message": {"role": "user", "content": "no prompt id"}}, assistant(usage, model="<synthetic>", error="x") | {"sessionId": "s"}]))
    assert [(r["compatibility"], r["project_id"]) for r in bare["sessions"].collect()] == [(1, None)] and not bare["turns"].count()
    assert not any(t.count() for t in transcripts.claude_tables(file_of(spark, rows).limit(0)).values())
    assert [tuple(r) for r in transcripts.claude_titles(file_of(spark, rows)).collect()] == [("s", "A title", base + 9000)]


def test_turns_follow_chains_of_parents(spark):
    """Branches, orphans, long chains and late parents, by brute force."""
    rng = random.Random(6)
    rows, want = [], []
    for entity in ("a", "b"):
        turn = members = None
        for line in range(1, 400):
            id_ = f"{entity}{line}"
            if rng.random() < 0.02:
                rows.append((entity, line, id_, None, True))
                turn, members = id_, {id_}
            else:
                parent = rng.choice([f"{entity}{line - 1}"] * 40 + [f"{entity}{max(1, line - rng.randrange(1, 9))}", f"{entity}{line + 1}", None, "none"])
                rows.append((entity, line, id_ if rng.random() < 0.98 else None, parent, False))
                if turn and rows[-1][2] and parent in members:
                    members.add(id_)
            want.append((entity, line, bool(turn and rows[-1][2] in members)))
    frame = spark.createDataFrame(rows, "entity string, line long, id string, parent_id string, starts boolean").repartition(3)
    assert sorted(map(tuple, transcripts.chained(frame).select("entity", "line", "belongs").collect())) == want
    assert 100 < sum(w[2] for w in want) < len(want)


def test_documents_with_totals_by_model(spark):
    message = {"id": "a", "timestamp": "2026-07-16T00:00:00Z", "model": "G", "tokens": {"promptTokenCount": 100, "candidatesTokenCount": 20, "cachedContentTokenCount": 40, "thoughtsTokenCount": 5, "toolUsePromptTokenCount": 7, "totalTokenCount": 125}}
    document = {"sessionId": "s", "messages": [message, message | {"id": "b", "tokens": message["tokens"] | {"totalTokenCount": 126}}]}
    stats = {"session_id": "s", "timestamp": "2026-07-16T00:00:00Z", "type": "result", "stats": {"models": {"M": {"tokens": {"prompt": 10, "candidates": 3, "cached": 4}}}}}
    got = {r["raw_model"]: (r["uncached_input_value"], r["normalized_total_value"], r["cache_included"]) for r in documents.gemini_calls(file_of(spark, [document, stats])).collect()}
    assert got == {"G": (60, 125, 1), "M": (6, 13, 1)}


def test_names_urls_and_times(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).head()[0]
    lit = lambda x: F.lit(x).cast("string")
    assert value(records.uuid7_ms(lit("019812e8-7000-7abc-8def-0123456789ab"))) == int("019812e87000", 16)
    assert value(records.uuid7_ms(lit("019812e8-7000-4abc-8def-0123456789ab"))) is None
    assert value(records.iso_ms(lit("2026-07-16T00:00:00"))) is None and value(records.iso_ms(lit("2026-07-16T02:00:00.5+02:00"))) == 1784160000500
    assert value(records.preview(lit("a" * 200))) == "a" * 120 and value(records.preview(lit(" \t"))) is None
    text, internal = records.without_reminder(lit("<system-reminder>x</system-reminder> "))
    assert value(internal) and value(text) == ""
    assert value(identity.repository(lit("git@Host:team/x.git"))) == "HOST/team/x" and value(identity.repository(lit("ftp://h/x"))) is None
    assert value(identity.project_path(lit("C:\\a\\"))) == "C:\\a" and value(identity.project_path(lit("/"))) == "/" and value(identity.project_path(lit("a/b"))) is None
    assert value(identity.dated_model(lit("openai/GPT-5-20260701"))) == "gpt-5"


def test_periods_and_prices(spark):
    assert derive.period("all", "UTC", date(2026, 7, 16), 1784073600000)[0] == datetime(2026, 7, 15, tzinfo=UTC)
    assert derive.pinned_day(date(2026, 8, 1), date(2026, 7, 1), date(2026, 7, 11)) == date(2026, 7, 10)
    rows = spark.createDataFrame([("0", 1), ("0.0012", 1), ("3.456", 2), (None, 3), ("1234567.005", 1), (None, 1), (None, 0), ("0.00995", 2)], "a string, c int").select(derive.shown_price(F.col("a").cast("decimal(38,15)"), F.col("c")).alias("x"))
    assert [r[0] for r in rows.collect()] == ["$0.00", "$0.0012", "$3.46", "未计价", "$1234567.01", "—", "—", "$0.0100"]
    day = 86_400_000
    averages = spark.createDataFrame([(5, 0, 2 * day), (3, 0, 2 * day), (7, 0, 3 * day)], "t long, a long, b long").select(derive.daily_average(F.col("t"), F.col("a"), F.col("b"), "UTC"))
    assert [r[0] for r in averages.collect()] == [3, 2, 2]


def test_files_that_arrive_are_merged_once(spark, tmp_path):
    folder, checkpoint = (str(tmp_path / x) for x in ("in", "checkpoint"))
    store = Store(spark, str(tmp_path / "table"))
    Path(folder).mkdir()
    usage = {"input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 2, "output_tokens": 0}

    def run(name, rows):
        Path(folder, name).write_text("\r\n".join(json.dumps(r) for r in rows) + "\n")
        commit.tail(spark, folder, transcripts.claude_calls, store, checkpoint, agent="a", instance="i").awaitTermination()

    assert commit.change_mark(store) is None and commit.stored(store) is None
    run("one.jsonl", [assistant(usage)])
    mark = commit.change_mark(store)
    run("two.jsonl", [assistant(usage | {"output_tokens": 7}), assistant(usage, id="m2")])
    assert commit.change_mark(store) > mark
    run("empty.jsonl", [])
    got = sorted((r["normalized_total_value"], r["completion_state"]) for r in commit.stored(store).collect())
    assert got == [(16, 0), (23, 1)]
    again = transcripts.claude_calls(lines.read_lines(spark, folder))
    store.commit(commit.named(again, "a", "i"))  # calls that come again are the same calls
    assert sorted((r["normalized_total_value"], r["completion_state"]) for r in commit.stored(store).collect()) == got


def test_files_found_and_changed(spark, tmp_path):
    for folder, name in (("active", "a.jsonl"), ("old", "a.jsonl"), ("old", "b.jsonl")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(folder + "\n")
    found = lines.discovered(spark, str(tmp_path / "active"), str(tmp_path / "old"))
    assert [(r["name"], "active" in r["path"]) for r in found.collect()] == [("a.jsonl", True), ("b.jsonl", False)]
    stamps = spark.createDataFrame(found.collect(), found.schema)
    assert lines.changed(found, stamps).count() == 0
    assert lines.changed(found, stamps.where("name = 'a.jsonl'")).count() == 1
    with pytest.raises(Exception):
        lines.discovered(spark, str(tmp_path / "gone")).count()


def test_backup_and_restore(spark, tmp_path):
    folder = str(tmp_path / "backup")
    tables = {"a": spark.range(5).selectExpr("id", "if(id = 2, null, id) x"), "b": spark.range(0).selectExpr("id")}
    writes.backup(spark, tables, folder)
    back = writes.restore(spark, folder)
    assert back["a"].count() == 5 and back["b"].count() == 0
    with pytest.raises(Exception):
        writes.backup(spark, tables, folder)
    spark.range(4).selectExpr("id", "id x").write.mode("overwrite").parquet(f"{folder}/a")
    with pytest.raises(ValueError):
        writes.restore(spark, folder)


def test_shown_models_count_where_something_confirms_them(spark):
    names = "n int, raw_model string, route_model_id string, display_name string, provider_id string"
    rows = [
        (0, "Raw", None, None, None), (1, "Raw", None, None, "P"), (2, "Raw", None, "raw", None), (3, "GLM-5.1", None, "glm 5.1", None), (4, "x", "GLM-5.1", "glm 5.1", "P"), (5, "x", "r1", "Shown", None), (6, "x", "r2", "Shown", None),
        (7, None, None, None, "P"), (8, " ", None, "Shown", None), (9, "x", "--", "..", None), (10, "r1", None, "Shown", None), (11, "x", "other", "Else", None),
    ]
    own = spark.createDataFrame([(" WorkBuddy", "R1", "shown"), ("else", "r2", "shown")], "agent_id string, alias string, canonical string")
    none = spark.createDataFrame([], "alias string, canonical string")
    got = identity.shown_models(spark.createDataFrame(rows, names), own, none, none, agent="workbuddy").orderBy("n").collect()
    assert [(r["normalized_model"], r["resolution_origin"]) for r in got] == [
        ("raw", 0), ("raw", 1), ("raw", 0), ("glm 5.1", 2), ("glm-5.1", 2), ("shown", 2), ("x", 0), (None, 5), (None, 5), ("--", 2), ("shown", 2), ("x", 0),
    ]


def test_qoder_prompts_and_their_ends(spark):
    at = lambda n: f"2026-07-16T00:00:{n:02}Z"
    rows = [
        {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": at(5), "message": {"content": " One\n two "}}, {"type": "assistant", "timestamp": at(7)}, {"type": "assistant", "timestamp": at(6)},
        {"type": "user", "uuid": "u2", "timestamp": at(9), "message": {"content": [{"type": "image"}]}}, {"type": "assistant", "timestamp": at(8)}, "{broken",
    ]
    got = transcripts.qoder_cli_turns(file_of(spark, [{"type": "assistant", "timestamp": at(1)}, *rows])).orderBy("start_ms").collect()
    base = 1784160000000
    assert [(r["session_id"], r["preview"], r["start_ms"] - base, r["completed_ms"] and r["completed_ms"] - base) for r in got] == [("s", "One two", 5000, 7000), ("s", "[图片]", 9000, None)]
    assert not transcripts.qoder_cli_turns(file_of(spark, rows).limit(0)).count()
