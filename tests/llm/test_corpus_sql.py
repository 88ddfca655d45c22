"""The corpus queries that SQL expresses, against it, and the others' shape."""

from __future__ import annotations

import pytest

from helpers import SMALL, same_rows
from loomquery.llm import queries as corpus


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(corpus.queries()[name](spark, SMALL), duck.sql(corpus.oracle_sql()[name]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op7_merkle", "op8_url_rules"])
def test_native_plans_have_no_python(spark, name):
    plan = corpus.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
