"""Every query of the engine against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

from helpers import SMALL, same_rows
from loomquery import queries as engine


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_sql(spark, duck, name):
    same_rows(engine.queries()[name](spark, SMALL), duck.sql(engine.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    df = engine.queries()["pq_filter_and"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan or "GreaterThan(l_quantity" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[-1]
