"""Catalogs from ranked sources: golden cases of each rule, and updates that are refused."""

from decimal import Decimal

import pytest

from meterlight.operators import catalogs as C


def rows_of(frame, *names):
    return sorted(tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in frame.select(*names or frame.columns).collect())


def price(key, i, o, cached=None, write=None, tiers=None):
    d = lambda x: None if x is None else Decimal(str(x))
    tiers = None if tiers is None else [("context" if len(t) < 6 else t[5], t[0], *[d(x) for x in (*t[1:5], *[None] * 4)[:4]]) for t in tiers]
    return key, d(i), d(cached), d(write), d(o), tiers


def other(key, provider, i, o, mode="chat", cached=None, tiers=None):
    d = lambda x: None if x is None else Decimal(str(x))
    return key, provider, mode, d(i), d(cached), None, d(o), None if tiers is None else [(t[0], d(t[1]), d(t[2])) for t in tiers]


@pytest.fixture
def made(spark):
    first = [
        price(" OpenAI/GPT-One ", 1, 2), price("zz/gpt-one-alias", 3, 4), price("a/plain", 1, 1), price("no-provider", 1, 1), price("a/free", None, 1), price(None, 1, 1),
        price("a/tier", 1, 2, 0.5, None, [(200, 2, 6, 1, None)]), price("a/zero", 0, 1, tiers=[(200, 0, 2)]),
        price("a/none", 1, 1, tiers=[]), price("a/two", 1, 1, tiers=[(1, 1, 1), (2, 1, 1)]), price("a/kind", 1, 1, tiers=[(1, 1, 1, None, None, "other")]), price("a/part", 1, 1, tiers=[(1, 1, None)]),
        price("a/less", 2, 1, tiers=[(1, 1, 1)]), price("a/much", 1, 1, tiers=[(1, 101, 1)]), price("a/lack", 1, 1, 1, None, [(1, 2, 2)]), price("a/cache", 1, 1, 1, None, [(1, 2, 2, 3, None)]), price("a/write", 1, 1, None, 1, [(1, 2, 2, None, 3)]),
    ]
    second = [
        other("gpt-one", "openai", 9, 9), other("gpt-two", "openai", 5, 6), other("openai/gpt-two", "openai", 7, 8), other("gpt-three", "OpenAI", 1, 2, tiers=[(128000, 2, 3)]), other("openai/gpt-four", "openai", 1, 1, mode=" "),
        other("gpt-five", "openai", 1, 1, mode="embedding"), other("x/y/gpt-six", "openai", 1, 1), other("azure/gpt-seven", "openai", 1, 1), other("gpt-eight", "azure", 1, 1), other("claude-z", "openai", 1, 1),
        other("gpt-nine", "openai", 1, 1, cached=1, tiers=[(1, 2, 2)]), other("gpt-ten", "openai", None, 1), other("claude-known", "anthropic", 1, 1), other("plain", "xai", 1, 1),
    ]
    first.append(price("rival/claude-known", None, None))
    aliases = spark.createDataFrame([("zz/gpt-one-alias", "gpt-one")], "alias string, canonical string")
    kept = spark.createDataFrame([("gpt-one", Decimal(3), None, None, Decimal(4), None, None, None), ("gpt-two", Decimal(5), None, None, Decimal(7), None, None, None)], C.RATES)
    return C.market_rules(spark.createDataFrame(first, C.FIRST), spark.createDataFrame(second, C.SECOND), aliases, kept)


def test_rules_by_rank(made):
    rules = {r[0]: r[1:] for r in rows_of(made["rules"], "model", "rule_id", "input_rate", "output_rate", "long_threshold", "long_input", "long_output")}
    assert rules == {
        "gpt-one": ("models.dev:zz/gpt-one-alias", 3, 4, None, None, None), "plain": ("models.dev:a/plain", 1, 1, None, None, None),
        "tier": ("models.dev:a/tier", 1, 2, 200, 2, 3), "zero": ("models.dev:a/zero", 0, 1, 200, 1, 2),
        "gpt-two": ("litellm:gpt-two", 5, 6, None, None, None), "gpt-three": ("litellm:gpt-three", 1, 2, 128000, 2, 1.5), "gpt-four": ("litellm:openai/gpt-four", 1, 1, None, None, None),
    }


def test_what_is_left_out_and_why(made):
    assert rows_of(made["disagreements"]) == [("gpt-one",)]
    assert rows_of(made["shadowed"]) == [("gpt-one",), ("gpt-two",)] and rows_of(made["differences"]) == [("gpt-two",)]
    assert sorted(made["excluded"].collect(), key=str) == sorted([("claude-z", "openai", "claude-z"), ("gpt-eight", "azure", None), ("plain", "xai", "plain")], key=str)
    one, ratio = "requires exactly one complete context tier", "tier rates are not valid proportional multipliers"
    assert rows_of(made["unsupported"]) == sorted([
        *[("models.dev", f"a/{k}", one) for k in ("none", "two", "kind", "part")], ("models.dev", "a/less", ratio), ("models.dev", "a/much", ratio), ("models.dev", "a/lack", "base and tier disagree on cache_read availability"),
        ("models.dev", "a/cache", "cache_read tier multiplier differs from input"), ("models.dev", "a/write", "cache_write tier multiplier differs from input"), ("litellm", "gpt-nine", "requires exactly one complete tier without cache tier fields"),
    ])


def test_empty_sources(spark):
    none = [spark.createDataFrame([], s) for s in (C.FIRST, C.SECOND, "alias string, canonical string", C.RATES)]
    assert all(not x.count() for x in C.market_rules(*none).values())


def test_aliases_with_their_evidence(spark):
    models = spark.createDataFrame([("OpenAI/gpt-a",), ("x/m",), ("y/m",), (None,)], "key string")
    listed = spark.createDataFrame([("azure", "gpt-a", "openai/gpt-a"), ("x", "x/m", None), ("azure", "unknown", None), (None, "gpt-a", None)], "provider string, key string, id string")
    second = spark.createDataFrame([("gpt-a",), ("m2",), ("router/m2",), ("router/gpt-a",), ("router/none",), ("azure/gpt-a",), (None,), ("router/",)], "key string")
    evidence, unmapped = C.alias_evidence(models, listed, second)
    assert rows_of(unmapped) == [("router/",), ("router/none",)]
    aliases, conflicts = C.alias_catalog(evidence.unionByName(spark.createDataFrame([("m2", "m3", "litellm"), (None, "m", "litellm")], evidence.schema)))
    both, a, b = sorted(C.SOURCES), [C.SOURCES[0]], [C.SOURCES[1]]
    assert {r[0]: tuple(r[1:]) for r in aliases.collect()} == {
        "gpt-a": ("gpt-a", both, True), "openai/gpt-a": ("gpt-a", a, False), "azure/gpt-a": ("gpt-a", both, True), "azure/openai/gpt-a": ("gpt-a", a, False), "m": ("m", a, False), "x/m": ("m", a, False), "y/m": ("m", a, False),
        "router/m2": ("m2", b, False), "router/gpt-a": ("gpt-a", b, False),
    }
    assert [tuple(r) for r in conflicts.collect()] == [("m2", ["m2", "m3"], b)]
    reviewed = spark.createDataFrame([("global", "x/m", "m"), ("agent:q", "y/m", "mm"), ("global", "zz", "m")], "scope string, alias string, canonical string")
    assert rows_of(C.reviewed_conflicts(aliases, reviewed), "scope", "alias", "reviewed_canonical", "market_canonical") == [("agent:q", "y/m", "mm", "m")]
    with pytest.raises(ValueError, match="provider/name"):
        C.alias_evidence(spark.createDataFrame([("a/b/c",)], "key string"), listed, second)


def test_updates_need_leave(spark):
    schema = "alias string, canonical string, sources array<string>"
    current = spark.createDataFrame([("same", "m", ["a"]), ("gone", "m", ["a"]), ("moved", "m", ["a"]), ("seen", "m", ["a"])], schema)
    new = spark.createDataFrame([("same", "m", ["a"]), ("moved", "n", ["b"]), ("seen", "m", ["a", "b"]), ("new", "m", ["a"])], schema)
    changes = C.alias_changes(current, new)
    assert rows_of(changes) == [("gone", "removed"), ("moved", "retargeted"), ("new", "added"), ("seen", "evidence")]
    for allow, told in (((), "1 removed, 1 retargeted"), (("removed",), "1 retargeted"), (("retargeted",), "1 removed")):
        with pytest.raises(ValueError, match=f"refused: {told}$"):
            C.accepted(new, changes, allow)
    assert C.accepted(new, changes, ("removed", "retargeted")) is new
    with pytest.raises(ValueError, match="1 evidence$"):
        C.accepted(new, changes, ("removed", "retargeted"), free=("added",))
    with pytest.raises(ValueError, match="2 in conflict"):
        C.accepted(new, changes, ("removed", "retargeted"), [new.limit(2), new.limit(0)])
    rule = lambda model, rate, long=None, id_="r": (id_, model, Decimal(rate), None, None, Decimal(1), 9 if long else None, long, long)
    frame = lambda *rules: spark.createDataFrame(list(rules), "rule_id string, " + C.RATES)
    old, fresh = frame(rule("a", 1), rule("b", 1), rule("c", 1), rule("d", 1)), frame(rule("a", 1), rule("b", 2), rule("c", 1, id_="q"), rule("e", 1, Decimal(2)))
    assert rows_of(C.rule_changes(old, fresh)) == [("b", "changed"), ("c", "changed"), ("d", "removed"), ("e", "added")]
    pairs = spark.createDataFrame([("x", "a"), ("y", "none"), ("z", "a"), ("z", "b"), ("A", "b"), ("p/q", "b"), ("b", "b"), (None, "a")], "alias string, priced_as string")
    assert sorted(map(tuple, C.check_references(pairs, fresh).collect()), key=str) == sorted([("y", "none", "no rule"), ("z", "a", "repeated"), ("z", "b", "repeated"), ("A", "b", "ill-formed"), ("p/q", "b", "ill-formed"), ("b", "b", "ill-formed"), (None, "a", "ill-formed")], key=str)
