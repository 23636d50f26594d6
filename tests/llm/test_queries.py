"""Queries of the subpackage against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from meterlight.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    want = sorted(map(str, got.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.queries()[name](spark, SF).select(*columns).collect()) == want
