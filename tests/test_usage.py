"""Usage queries against their SQL on the smallest tables, and golden numbers."""

from datetime import UTC, date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from meterlight.operators import derive, pricing
from meterlight.operators.filters import UsageFilter
from meterlight.plans import queries

SF = "/root/testdata/sf0.001"
SMALL = ["overview", "overview_empty_range", "models", "session_tree", "session_cycles", "session_merge", "turn_attribution", "price_frozen", "project_streak", "trend_local_week"]


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


def test_cycles_of_all_sessions_by_brute_force(spark, tmp_path):
    keys = [*range(60), *range(600, 640), 1001, 1003]
    path = str(tmp_path)
    for table in ("lineitem", "part", "conversations", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(1).write.parquet(f"{path}/{table}.parquet")
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{path}/orders.parquet")
    up = {k: k - k % 10 + (k % 10 + 1) % 4 if k % 10 < 4 else k - 1 for k in keys}
    want = set()
    for k in keys:
        at = up[k]
        for _ in keys:
            if at == k:
                want.add(f"s{k}")
            at = up.get(at, -1)
    assert {r["session_id"] for r in queries.queries()["session_cycles"](spark, path).collect()} == want
    assert any(int(s[1:]) >= 500 for s in want) and "s1001" not in want


RATES = "model string, input_rate string, cached_rate string, write_rate string, output_rate string, long_threshold long, long_input string, long_output string"
EVENT = "normalized_model string, cache_included int, input_reported_value long, uncached_input_value long, cache_read_value long, cache_write_value long, output_value long"


def test_prices(spark):
    rates = spark.createDataFrame([("claude-sonnet-4-6", "3", "0.3", None, "15", None, None, None), ("m", "1", "0.5", "2", "4", 100, "2", "1.5")], RATES)
    rates = rates.selectExpr("model", *[f"cast({c} as decimal(18,9)) {c}" for c in ("input_rate", "cached_rate", "write_rate", "output_rate")], "long_threshold", *[f"cast({c} as decimal(9,6)) {c}" for c in ("long_input", "long_output")])
    rows = [(" Claude-Sonnet-4-6", 1, 16, 10, 4, 2, 7), ("m", 1, 101, None, 1, 0, 2), ("other", 1, 1, 1, 1, 1, 1)]
    got = [(r["estimated_cost"], r["pricing_status"], r["pricing_missing"]) for r in pricing.estimate(spark.createDataFrame(rows, EVENT), rates).orderBy("input_reported_value").collect()]
    assert got == [(None, 0, 1), (Decimal("0.0001362"), 2, 32), (Decimal("0.000213"), 1, 0)]


def test_filters_refuse_what_makes_no_sense():
    start, end = datetime(2026, 1, 1, tzinfo=UTC), datetime(2026, 1, 2, tzinfo=UTC)
    for bad in ({"start": end, "end": start}, {"limit": 0}, {"limit": 1001}, {"offset": -1}, {"project": "p", "unidentified_project": True}, {"root_agent": "a"}):
        with pytest.raises(ValueError):
            UsageFilter(**{"start": start, "end": end} | bad)
    assert UsageFilter(start, end, agent="  ").agent is None


def test_periods():
    assert derive.period("7d", "Europe/Berlin", date(2026, 7, 16)) == (datetime(2026, 7, 9, 22, tzinfo=UTC), datetime(2026, 7, 16, 22, tzinfo=UTC))
    with pytest.raises(ValueError):
        derive.custom_period(datetime(2026, 3, 29, 2), datetime(2026, 3, 30), "Europe/Berlin")
    assert derive.granularity(datetime(2026, 1, 1), datetime(2026, 1, 4), True) == "hour"
