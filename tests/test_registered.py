import pytest

import __spark_entry__ as registered
import compare
from lexivane.workloads import duck_sql, spark_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.tables(FOLDER)


def test_every_query_has_sql():
    assert set(spark_queries.QUERIES) == set(duck_sql.SQL)
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(spark_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, FOLDER, name) is None


def test_entry_has_rows(spark):
    assert registered.entry(spark).limit(1).count() == 1
