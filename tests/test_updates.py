"""Changes of a part give what a rebuild of the whole tables gives."""

import random

from meterlight.operators import attribution, merge

TURNS = "agent_id string, source_instance_id string, session_id string, turn_id string, start_ms long, completed_ms long, prompt_origin_turn string"
SESSIONS = "agent_id string, source_instance_id string, session_id string, parent_session_id string, relation_state int, relation_origin int, session_role int, agent_leaf_hash string, agent_path_hash string"
SENT = "agent_id string, source_instance_id string, source_session_id string, source_turn_id string, kind int, target_kind int, target_hash string, occurred_ms long"


def rows_of(rng, n, count):
    """A session's row, turns and dispatches; parents may be missing or make cycles."""
    name, parent = f"s{n}", f"s{rng.randrange(count + 3)}"
    linked = rng.random() < 0.8
    session = ("a", "i", name, parent if linked else None, int(linked and rng.random() < 0.9), rng.choice([1, 4]), rng.choice([1, 2, 2, 3]), f"leaf{n}", f"path{n}")
    turns = [("a", "i", name, f"t{i}", i * 1000 + rng.randrange(900), i * 1000 + 950 if rng.random() < 0.8 else None, f"t{i - 1}" if i and rng.random() < 0.3 else None) for i in range(rng.randrange(1, 4))]
    sent = [("a", "i", name, t[3], kind, 1 - kind, f"{('leaf', 'path')[kind]}{rng.randrange(count)}", t[4] - rng.randrange(900)) for t in turns for kind in (0, 1) for _ in range(4)]
    return [session], turns, sent


def test_changed_sessions_are_attributed_as_by_a_rebuild(spark):
    rng, count = random.Random(3), 60
    held = {n: rows_of(rng, n, count) for n in range(count)}
    frames = lambda: [spark.createDataFrame([r for x in held.values() for r in x[at]], schema) for at, schema in ((1, TURNS), (0, SESSIONS), (2, SENT))]
    result = lambda df: sorted(map(str, df.select(*attribution.TURN, "origin_session_id", "origin_turn_id", "origin", "state").collect()))
    before = attribution.attribute(*frames())
    was = result(before)
    changed = rng.sample(range(count + 3), 6)
    for n in changed:
        if n % 3 == 0:
            held.pop(n, None)
        else:
            held[n] = rows_of(rng, n, count)
    keys = spark.createDataFrame([("a", "i", f"s{n}") for n in changed], "agent_id string, source_instance_id string, session_id string")
    want = result(attribution.attribute(*frames()))
    assert result(attribution.reattribute(before, *frames(), keys)) == want != was


def test_touched_paths_are_reconciled_as_by_a_rebuild(spark):
    rng, schema = random.Random(4), "n long, project_path string, repository_hash string, project_id string"
    make = lambda n: (n, rng.choice(["/a", "/A", "/b", "/B", "/c", "/d", None]), rng.choice([None, None, "1" * 64, "2" * 64, "not a hash"]), "old")
    stored = merge.reconcile_projects(spark.createDataFrame([make(n) for n in range(8)], schema))
    for batch in range(3):
        new = spark.createDataFrame([make(n + 10 * (batch + 1)) for n in range(3)], schema)
        every = spark.createDataFrame(stored.collect(), schema).unionByName(new)
        stored = merge.reconcile_touched(every, new.select("project_path"))
        assert sorted(map(str, stored.collect())) == sorted(map(str, merge.reconcile_projects(every).select(*every.columns).collect()))
