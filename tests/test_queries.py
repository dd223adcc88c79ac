"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect
from checks.oracle import oracle_sql
from souk.registry import QUERIES
from tests.conftest import SMALL
from tests.helpers import plan_text

# Python workers and cross products have no place in any plan.
UNWANTED = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
            "CartesianProduct", "BroadcastNestedLoopJoin")
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_comparison_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SMALL)
    text = plan_text(df)
    assert not [word for word in UNWANTED if word in text]
    assert compare(df, con, ORACLE[name]) == ""


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["intervention", "count", "total_revenue_at_risk"]
    assert df.count() > 0
