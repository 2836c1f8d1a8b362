"""Each query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from codeweft.plans import data, reference, reference_sql

SQL = data.SQL | reference_sql.SQL


def _plain(v):
    if v is None or v != v:
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def tables():
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    df = (data.QUERIES | reference.QUERIES)[name](spark, SMALL)
    got = tables.sql(SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert _rows(df.collect(), df.columns) == _rows(got.fetchall(), got.columns)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_" for n in (3, 4, 5, 6)} <= {k[:3] for k in entry.queries()}
