import os

import pytest

from lectern.plans import core_queries, reference_queries
from tests.sqlcheck import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES = reference_queries.QUERIES | core_queries.QUERIES
SQL = reference_queries.SQL | core_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
