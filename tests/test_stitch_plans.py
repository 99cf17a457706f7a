"""Stitching works each of its tables out once: its plans read written tables and send none of them through the driver."""

import pytest

from quire import catalog


@pytest.mark.parametrize("name", ["contents_pages", "contents_articles", "contents_doubts", "page_led_articles"])
def test_plans_stay_small(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan and plan.count("Scan parquet") < 40
