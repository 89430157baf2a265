"""Queries with SQL against DuckDB, over a whole small corpus."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"

from nearvote.llm.queries import QUERIES, SQL  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    order = [want.columns.index(c) for c in names]
    assert sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect())))
