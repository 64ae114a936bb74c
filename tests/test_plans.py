"""Plan checks: filters reach the scans, scans read only needed columns, and the
SQL-checked queries keep all work in the JVM (no Python evaluation nodes)."""

import contextlib
import io

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


@pytest.fixture(autouse=True)
def no_cached_relations(spark):
    # A cached copy of the same view would replace the scans in the plan.
    spark.catalog.clearCache()


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_filters_pushed_into_scans(spark):
    p = plan_of(E.queries()["filter_compose"](spark, SF_SMALL))
    assert "EqualTo(c_mktsegment,BUILDING)" in p
    assert "EqualTo(p_type,PROMO)" in p
    assert "GreaterThanOrEqual(o_orderdate," in p


def test_column_pruning(spark):
    p = plan_of(E.queries()["sales_by_category"](spark, SF_SMALL))
    line_scan = [ln for ln in p.splitlines() if ln.startswith("ReadSchema: struct<l_orderkey")][0]
    assert "l_quantity" not in line_scan and "l_shipdate" not in line_scan


def test_month_partitions_pruned(spark):
    p = plan_of(E.queries()["partitioned_sales_range"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(year" in p


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_python_in_sql_checked_plans(spark, name):
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p
