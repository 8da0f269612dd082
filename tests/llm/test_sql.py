"""Queries that SQL can express, against it."""

import duckdb
import pytest

from frameloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert (got == want).all().all()
