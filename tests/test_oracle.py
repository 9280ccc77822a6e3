"""Every registered query against its SQL."""

import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(df.collect()) > 0
    else:
        assert oracle.compare(df, con, sql) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["db_id", "table_name", "column_name", "c_id", "id", "contents"]
    assert df.limit(1).count() == 1
