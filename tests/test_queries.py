"""Every registered query against its SQL, whole results."""

import pytest

import __spark_entry__ as entry
from cloakframe.plans import QUERIES
from oracle import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    columns, rows = spark_rows(entry.queries()[name](spark, FOLDER))
    assert (columns, rows) == sql_rows(duck, entry.oracle_sql()[name])


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["mismatches"] == 0 and row["checked"] == 150
