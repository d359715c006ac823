"""Every registered query against DuckDB, on the smallest given tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tallywright.workload import operators, reports

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**operators.QUERIES, **reports.QUERIES}
ORACLE = {**operators.ORACLE, **reports.ORACLE}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return f"{type(value).__name__} {value}"


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[plain(row[i]) for i in order] for row in data])


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= spark_entry.queries().items()
    assert ORACLE.items() <= spark_entry.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert table(result.columns, result.collect()) == table(columns, cursor.fetchall())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
