"""Every registered query against its comparison SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    ours = rows_of(df.collect(), df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ours == rows_of(cursor.fetchall(), columns)
