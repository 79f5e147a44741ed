"""Plan checks: no row-at-a-time Python, top-k without a full sort, date
windows pushed into the scan on the canonical layout, basket fold is the
only Python stage."""

import pytest

from __spark_entry__ import queries
from storepulse.operators import sales
from storepulse.plans.catalog import QUERIES as CATALOG
from storepulse.session import shared_dir
from storepulse.sources.retail import materialize_retail
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in CATALOG if not k.startswith("stream_") and not k.endswith("_report")))
def test_no_python_udf_in_plan(spark, key):
    p = plan(queries()[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    if not any(x in key for x in ("frequently_bought", "associations", "behavior_pairs")):
        assert "MapInPandas" not in p and "PythonMapInArrow" not in p


def test_top_k_is_take_ordered(spark):
    p = plan(queries()["top_selling_products"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_canonical_layout_pushes_date_window(spark, retail):
    canon = materialize_retail(retail, shared_dir(spark, "canonical"))
    df = sales.top_selling_products(canon, "2001-08-02", 10, 365)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("GreaterThanOrEqual(transaction_date") >= 2  # transactions AND items scans
    base = sales.top_selling_products(retail, "2001-08-02", 10, 365)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, base.collect()))


def test_bucketed_layout_joins_without_shuffle(spark, retail):
    canon = materialize_retail(retail, shared_dir(spark, "bucketed"), buckets=4, table_prefix="plan_test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from storepulse.operators.common import sold_lines
        text = sold_lines(canon, None)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text, text
        df = sales.top_selling_products(canon, "2001-08-02", 10, 365)
        base = sales.top_selling_products(retail, "2001-08-02", 10, 365)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, base.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_basket_rows_are_aggregated_before_products_and_baskets(spark, retail):
    """Item rows are counted per (basket, product) before products are joined,
    and per (basket, name) before they are clustered by basket."""
    from storepulse.operators import basket
    p = basket.basket_rows(retail, None)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" :+-") for x in p.splitlines()]
    counted = next(i for i, x in enumerate(lines) if x.startswith("Aggregate [transaction_id") and "product_id" in x.split("]")[0])
    named = next(i for i, x in enumerate(lines) if x.startswith("Aggregate [transaction_id") and "name_id" in x.split("]")[0])
    assert named < counted, p
    assert any("sum(c" in x for x in lines[:counted]), p
