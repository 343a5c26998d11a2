"""Every query with an SQL twin, in both engines, on the smallest given tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.columns, ours.collect()) == rows_of(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
