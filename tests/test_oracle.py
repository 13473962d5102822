"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import check, duck

import __spark_entry__ as entry

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    outcome, _, _ = check(spark, con, SF_DIR, QUERIES[name], SQL.get(name))
    assert outcome in ("match", "rows-only"), outcome


def test_entry(spark):
    df = entry.entry(spark)
    assert {"category", "group_name"} <= set(df.columns) and df.count() > 0
