"""Every query against its SQL on the smallest data."""

import pytest

from check_queries import connect, differences
from keyrhythm.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)
