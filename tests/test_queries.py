from __future__ import annotations

import pytest

from memloom.plans import all_queries
from tests.oracle import connect, expected, rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    columns, want = expected(con, ORACLE[name])
    assert sorted(found.columns) == columns
    assert rows(found) == want


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
