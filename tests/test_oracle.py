import os

import duckdb
import pytest
from partloom.plans import oracle, oracle_pool, oracle_sheets
from partloom.plans.queries import QUERIES

SQL = oracle.SQL | oracle_sheets.SQL | oracle_pool.SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    assert rows == sorted(repr(tuple(r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
