"""Queries with SQL give the rows that DuckDB gives; the others are held against brute force in test_operators."""

import os

import duckdb
import pytest
from lorebase.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = normal(QUERIES[name](spark, SF).toPandas()), normal(db.sql(ORACLE_SQL[name]).df())
    assert got.equals(want)
