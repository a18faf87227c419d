"""Every query against its SQL on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, db, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    rel = db.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    expected = rel.select(*[f'"{c}"' for c in columns]).fetchall()
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert expected, "an empty result checks nothing"


def test_entry(spark):
    assert entry(spark).count() > 0
