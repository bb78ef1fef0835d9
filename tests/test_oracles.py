"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, difference

from catalog.all import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_same_table(spark, con, name):
    df = REGISTRY.queries[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert difference(df, con, REGISTRY.sql[name]) is None


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())
