"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import oracle
from shiftwise.plans import all_queries, all_sql

SF = f"{oracle.TESTDATA}/sf{os.environ.get('ORACLE_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, con, name):
    problem, _ = oracle.compare(con, all_queries()[name](spark, SF), all_sql()[name])
    assert not problem


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_runs(spark, name):
    df = all_queries()[name](spark, SF)
    assert len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert rows and {"label", "feature", "check", "value", "drift"} == set(rows[0].asDict())
