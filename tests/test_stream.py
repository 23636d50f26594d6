"""Stores under several sources, writers and readers, and files that grow."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterlight.sources import growing, lines, transcripts
from meterlight.streaming import commit
from meterlight.streaming.store import ARRIVAL, Store, source_id

USAGE = {"input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 2, "output_tokens": 7}


def call(id_, output=7):
    return json.dumps({"type": "assistant", "sessionId": "s", "timestamp": "2026-07-16T00:00:01Z", "message": {"role": "assistant", "id": id_, "model": "m", "usage": USAGE | {"output_tokens": output}}})


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def totals(store):
    return sorted((r["normalized_total_value"], r["completion_state"]) for r in commit.stored(store).collect())


def test_two_sources_and_a_new_checkpoint_keep_each_others_batches(spark, tmp_path, store):
    def run(name, checkpoint):
        commit.tail(spark, str(tmp_path / name), transcripts.claude_calls, store, str(tmp_path / checkpoint), agent="a", instance="i").awaitTermination()

    for name, id_ in (("one", "m1"), ("two", "m2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text(call(id_) + "\n")
        run(name, f"{name}-checkpoint")
    assert totals(store) == [(23, 1)] * 2
    mark = commit.change_mark(store)
    run("one", "one-checkpoint")
    assert commit.change_mark(store) == mark
    run("one", "another-checkpoint")  # the same calls again, from batch 0
    assert commit.change_mark(store) > mark and totals(store) == [(23, 1)] * 2


def test_a_repeated_batch_changes_nothing(spark, store):
    rows = spark.range(3).withColumn("x", F.lit(1))
    assert store.commit({"t": rows}, "s", 0) and not store.commit({"t": rows.union(rows)}, "s", 0)
    assert store.read("t").count() == 3
    assert store.commit({"t": rows}, "other", 0) and store.commit({"t": rows}, "s", 1)
    assert [r[0] for r in store.read("t").groupBy(ARRIVAL).count().orderBy(ARRIVAL).select(ARRIVAL).collect()] == [1, 2, 3]


def test_a_crash_between_tables_shows_nothing(spark, store, monkeypatch):
    store.commit({"a": spark.range(1), "b": spark.range(1)}, "s", 0)

    def fail(self, table, rows, *partitioned, stage=Store.stage):
        if table == "b":
            raise RuntimeError("lost")
        return stage(self, table, rows, *partitioned)

    with monkeypatch.context() as m:
        m.setattr(Store, "stage", fail)
        with pytest.raises(RuntimeError):
            store.commit({"a": spark.range(5), "b": spark.range(5)}, "s", 1)
    assert store.read("a").count() == store.read("b").count() == 1
    assert store.commit({"a": spark.range(5), "b": spark.range(5)}, "s", 1)
    assert store.read("a").count() == store.read("b").count() == 6
    assert store.vacuum(keep=1, older_than_ms=0) == 1  # what the crash left
    assert store.read("a").count() == 6


def test_several_writers_lose_nothing(spark, store):
    staged = [store.stage("t", spark.range(1).withColumn("writer", F.lit(i))) for i in range(8)]
    threads = [threading.Thread(target=store.publish, args=({"t": name}, f"s{i}", 0)) for i, name in enumerate(staged)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["writer"] for r in store.read("t").collect()) == list(range(8))
    assert store.numbers() == list(range(1, 9))


def test_readers_keep_their_version_and_compaction_keeps_rows(spark, store):
    for i in range(4):
        store.commit({"t": spark.range(i, i + 2).withColumn("v", F.lit(i))}, "s", i)
    seen = store.manifest()
    reader = store.read("t", seen)
    want = sorted(map(tuple, reader.collect()))
    assert commit.compact(Store(spark, store.folder)) == ["t"]
    assert len(store.manifest().tables["t"]) == 1 and sorted(map(tuple, store.read("t").select(reader.columns).collect())) == want
    store.commit({"t": spark.range(9, 10).withColumn("v", F.lit(9))}, "s", 4)
    assert sorted(map(tuple, store.read("t", seen).collect())) == want == sorted(map(tuple, reader.collect()))
    assert store.read("t").count() == 9 and store.read("t").agg(F.max(ARRIVAL)).head()[0] == 6
    old = seen.tables["t"]
    assert not store.publish({"t": None}, instead={"t": old})  # another compaction was first
    assert store.vacuum(keep=1, older_than_ms=0) == 4 and store.read("t").count() == 9


def test_ids_stay_with_checkpoints(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert source_id(spark, a) == source_id(spark, a) != source_id(spark, b)


def test_growing_files_equal_a_full_read(spark, tmp_path, store):
    folder = tmp_path / "in"
    folder.mkdir()
    file = folder / "a.jsonl"

    def run():
        commit.follow(spark, str(folder), transcripts.claude_calls, store, str(tmp_path / "checkpoint"), agent="a", instance="i").awaitTermination()
        read = store.read("lines")
        if read is None:
            return
        now = sorted(map(tuple, growing.current_lines(read, ARRIVAL).select("path", "line", "value").collect()))
        whole = [(str(p), i + 1, t.removesuffix("\r")) for p in sorted(folder.glob("*.jsonl")) for i, t in enumerate(p.read_bytes().decode().split("\n")[:-1])]
        assert now == whole

    file.write_text('{"type": "user"')
    run()  # no complete line yet
    assert commit.stored(store) is None
    file.write_text(f'{{"type": "user", "note": "é"}}\r\n{call("m1", 0)}\n{call("m2")[:40]}')
    run()
    assert totals(store) == [(16, 0)]
    with file.open("a") as f:
        f.write(call("m2")[40:] + "\n" + call("m1") + "\n\n")
    (folder / "b.jsonl").write_text(call("m3") + "\n")
    run()
    assert totals(store) == [(23, 1)] * 3
    mark = commit.change_mark(store)
    run()
    assert totals(store) == [(23, 1)] * 3 and commit.change_mark(store) <= mark + 1
    file.write_text('{"type": "user", "note": "é"}\r\n' + call("m4") + "\n")  # truncated
    run()
    file.write_text(call("m5") + "\n" + call("m6") + "\n" + call("m7") + "\n" * 3)  # replaced
    run()
    assert totals(store) == [(23, 1)] * 7  # calls stay when their lines are gone
    commit.compact(store)
    with file.open("a") as f:
        f.write(call("m8") + "\n")
    run()
    assert totals(store) == [(23, 1)] * 8


def test_large_files_are_read_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "PART_BYTES", 50)
    monkeypatch.setattr(growing, "PIECE", 7)
    monkeypatch.setattr(growing, "LONGEST_LINE", 120)
    texts = ["x" * n for n in (3, 0, 49, 50, 51, 0, 0, 120, 121, 1, 7)]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(texts) + "\nrest")
    reader = growing.Reader(str(tmp_path), ".jsonl")
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    got = [row for p in parts for row in reader.read(p)]
    starts = [sum(len(t) + 1 for t in texts[:i]) for i in range(len(texts))]
    assert [(r[1], r[2]) for r in got] == [(s, t) for s, t in zip(starts, texts) if len(t) <= 120] and len(parts) > 5
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    path.write_text("other\n")
    assert [row for p in parts for row in reader.read(p)] == []
    (tmp_path / "long.jsonl").write_text("y" * (growing.FIRST_LINE + 1) + "\nz\n")
    assert list(reader.latestOffset()) == [str(path)]


def test_lines_of_both_readers_agree(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("one\r\ntwo\n\nthree\n")
    reader = growing.Reader(str(tmp_path), ".jsonl")
    rows = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    read = spark.createDataFrame(rows, growing.SCHEMA).withColumn("n", F.lit(1))
    got = growing.current_lines(read, "n").select("line", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, lines.read_lines(spark, str(tmp_path)).select("line", "value").collect()))
    assert Path(rows[0][0]).name == "a.jsonl"
