"""Every registered query against its SQL at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import TABLES, same_rows
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    frame = queries()[name](spark, SF_DIR).toPandas()
    assert same_rows(frame, db.execute(oracle_sql()[name]).df())


def test_entry(spark):
    assert entry(spark).count() > 0
