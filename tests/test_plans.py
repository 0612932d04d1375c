"""Plans of the day reports: the day is a bound on the stored time and reaches the scan."""

import re

import pytest

from tradewake.plans.queries import QUERIES
from tradewake.sources import driver_tables

SF = "/root/testdata/sf0.001"

OF_EVENTS = (
    "active_of_day hourly_active hourly_active_compare order_amount_hour hourly_amount_compare sql_active_total "
    "sql_active_by_hour sql_amount_by_hour realtime_hours_dau realtime_hours_amount"
).split()
OF_ORDERS = "order_amount_total sql_amount_total".split()
OF_SALES = "sale_search_page sale_search_total age_terms gender_terms age_share gender_share sale_breakdowns".split()


def plan_of(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, column", [(n, "ts") for n in OF_EVENTS] + [(n, "o_orderdate") for n in OF_ORDERS])
def test_day_reaches_the_scan(spark, name, column):
    pushed = re.findall(r"PushedFilters: \[([^\n]*)", plan_of(spark, name))
    assert any(f"GreaterThanOrEqual({column}" in p and f"LessThan({column}" in p for p in pushed)


@pytest.mark.parametrize("name", ["realtime_hours_dau", "realtime_hours_amount"])
def test_hours_of_two_days_come_from_one_scan(spark, name):
    assert plan_of(spark, name).count("FileScan") == 1


def test_amounts_read_no_customers(spark):
    for name in ("order_amount_day", "order_amount_total", "sql_amount_total"):
        assert "customer.parquet" not in plan_of(spark, name)


def test_day_bounds_the_orders_of_sales(spark):
    heads = driver_tables.order_heads(spark, SF, ("1997-10-08", "1997-10-08"))
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", OF_SALES)
def test_lines_meet_a_days_orders_where_they_lie(spark, name):
    """Neither all orders nor all lines are shuffled, and lines are named after the join."""
    plan = plan_of(spark, name)
    assert "orders.parquet" not in plan
    lines = plan.index("lineitem.parquet")
    above = plan[:lines].splitlines()[-8:]
    assert any("BroadcastHashJoin [l_orderkey" in line for line in plan.splitlines())
    assert not any("Exchange hashpartitioning(l_orderkey" in line for line in above)
