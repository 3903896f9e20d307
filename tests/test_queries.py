"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_results import normal
from workbench.oracle import ORACLE
from workbench.queries import QUERIES
from workbench.views import TABLES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    result = queries()[name](spark, FOLDER)
    relation = db.sql(oracle_sql()[name])
    assert sorted(result.columns) == sorted(relation.columns)
    assert normal(result.columns, result.collect()) == normal(relation.columns, relation.fetchall())


def test_every_query_is_checked_or_approximate():
    assert set(QUERIES) - set(ORACLE) == {"distinct_approx"}
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_approximate_distinct_is_close(spark):
    exact = {r.column_name: r.distinct_count for r in queries()["distinct_exact"](spark, FOLDER).collect()}
    for row in queries()["distinct_approx"](spark, FOLDER).collect():
        assert abs(row.distinct_count - exact[row.column_name]) <= max(1, 0.2 * exact[row.column_name])


def test_entry(spark):
    assert entry(spark).count() > 0
