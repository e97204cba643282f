"""Every query with an SQL text gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E
from check_queries import rows_of
from trafficlens.plans import registry


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, folder, sql, name):
    df = E.queries()[name](spark, folder)
    result = sql.execute(E.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, folder, name):
    assert E.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_sql_text_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
