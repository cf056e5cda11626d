"""Every query with an SQL twin against that twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

DIR = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for file in os.listdir(DIR):
        out.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DIR}/{file}'")
    return out


def plain(x):
    return tuple(x) if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, con, name):
    found = entry_points.queries()[name](spark, DIR)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in found.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
