import json

import pytest
from pyspark.sql import functions as F

from meterlight.functions import records
from meterlight.functions.identity import project_path
from meterlight.sources import documents, transcripts


def nodes(plan):
    """All operators of an optimized plan."""
    found, rest = [], [plan]
    while rest:
        node = rest.pop()
        found.append(node)
        children = node.children()
        rest += [children.apply(i) for i in range(children.length())]
    return found


def plan_of(df):
    return nodes(df._jdf.queryExecution().optimizedPlan())


def lines_of(spark, rows):
    return spark.createDataFrame([("e", i, json.dumps(r)) for i, r in enumerate(rows, 1)], "entity string, line long, value string").repartition(2)


@pytest.mark.parametrize("parse", [transcripts.claude_calls, transcripts.qwen_calls, documents.gemini_calls])
def test_lines_are_parsed_once_and_sorted_without_their_records(spark, parse):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = plan_of(parse(lines_of(spark, [{"type": "user"}])))
    texts = [n.simpleString(10000) for n in plan]
    assert sum("parse_json" in t.lower() or "parsejson" in t.lower() for t in texts) == 1
    if parse is not documents.gemini_calls:  # a document goes on with its messages
        kinds = [n.schema().json() for n in plan if n.nodeName() == "Window"]
        assert kinds and not any("variant" in k for k in kinds)


def test_strings_are_read_as_before(spark):
    texts = ['{"a": "x"}', ' \t\r\n{"a": "x y"}', "[]", '"a"', "{broken", '{"a": "  "}', '{"a": "a\\u0085b"}', '{"a": "\\u00a0"}', '{"a": 5}', '{"a": " é "}', '{"a": "x\\n"}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", records.record(F.col("t")).alias("v"))
    got = [tuple(r) for r in rows.select(F.col("v").isNotNull(), records.bounded(F.col("v"), "$.a", 3)).orderBy("i").collect()]
    assert got == [(True, "x"), (True, "x y"), (False, None), (False, None), (False, None), (True, None), (True, None), (True, "\u00a0"), (True, None), (True, " é "), (True, None), (False, None)]


def test_numbers_tell_absent_from_wrong(spark):
    row = spark.range(1).select(F.parse_json(F.lit('{"a": 3, "b": null, "c": -2, "d": 1.5, "e": "4", "f": 9223372036854775808}')).alias("v"))
    assert row.select(records.numbers(F.col("v"), *[f"$.{x}" for x in "abcdefg"])).head()[0] == [3, None, -1, -1, -1, -1, None]


def test_paths(spark):
    paths = ["/", "//", "/a/b//", "C:\\", "C:/x/", "/:", "\\\\host\\share\\", "\\\\host", "relative", "/a\u0001", "\\\\h\u0001\\s", ""]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(project_path(F.col("p"))).collect()]
    assert got == ["/", "/", "/a/b", "C:\\", "C:/x", "/:", "\\\\host\\share", None, None, None, None, None]


def test_totals_by_model_stand_beside_messages(spark):
    message = {"id": "m", "timestamp": "2026-01-01T00:00:00Z", "model": "G", "tokens": {"input": 4, "output": 2, "cached": 1, "total": 6}}
    document = {"sessionId": "s", "startTime": "2026-01-01T00:00:01Z", "messages": [message, {"tokens": {"input": "4"}}], "stats": {"models": {"X": {"tokens": {"prompt": 9, "candidates": 3, "cached": 2}}, "Y": {"input": 5, "output": 1}}}}
    got = {r["raw_model"]: (r["uncached_input_value"], r["normalized_total_value"], r["cache_included"]) for r in documents.gemini_calls(lines_of(spark, [document])).collect()}
    assert got == {"G": (3, 6, 1), "X": (7, 12, 1), "Y": (5, 6, 0)}
