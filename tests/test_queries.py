"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in SQL:
        assert compare.difference(df, duck, SQL[name]) is None
    else:
        df.count()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "value", "result"] and df.count() > 0
