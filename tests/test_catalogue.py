"""Every registered query of the engine's own operators against DuckDB."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.plans import extended  # noqa: F401  (registers its queries)
from granary.plans.catalogue import QUERIES, SQL
from granary.sources import claims

from .sqlcompare import DATA, compare, connect

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        compare(spark, con, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_pushdown_and_pruning(spark):
    """The flagship reads the columns it needs and filters in the scan."""
    plan = QUERIES["agg_basic"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_comment" not in plan and "l_orderkey" not in plan
    top = QUERIES["sort_topk"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_row_by_row_python(spark, name):
    if name.startswith(("claims_",)):
        return
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_claims_queries_run_over_the_default_panel(spark):
    rows = claims.enrolled_member_months(claims.simulate_claims_panel(spark))
    months = rows.count()
    assert QUERIES["claims_rollup"](spark, str(DATA)).agg(F.sum("member_months")).first()[0] == months
    assert QUERIES["claims_trend"](spark, str(DATA)).agg(F.sum("member_months")).first()[0] == months
    assert QUERIES["claims_rollup"](spark, str(DATA)).count() > 1000
