"""A task's share of item rows, cells and pairs does not grow with the input."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import queries
from storepulse.operators import basket, category, common, sales
from tests.conftest import SF_SMALL
from tests.test_plans import plan

RANKINGS = ["top_selling_products", "popular_products_for_promotion", "popular_products_by_category",
            "popular_products_by_category_filtered", "product_growth_by_category", "popular_products_view",
            "popular_products_view_range", "popular_products_view_range_growth", "top_products_range",
            "top_products_range_filtered", "category_performance"]


@pytest.mark.parametrize("key", RANKINGS)
def test_lines_are_dealt_by_number(spark, retail, monkeypatch, key):
    """Item rows go to partitions in proportion to their number, and are not
    aggregated before that."""
    monkeypatch.setattr(common, "TASK_ROWS", 250)
    n = -(-retail["sales_transaction_items"].count() // 250)
    lines = plan(queries()[key](spark, SF_SMALL)).splitlines()
    dealt = [k for k, x in enumerate(lines) if "Exchange hashpartitioning(transaction_id" in x and f", {n}), REPARTITION_BY_NUM" in x]
    assert dealt
    scan = next(k for k, x in enumerate(lines) if "l_orderkey" in x and "FileScan" in x)
    assert not any("Aggregate" in x for x in lines[max(k for k in dealt if k < scan):scan])


def test_traffic_is_dealt_by_number(spark, retail, monkeypatch):
    """The rows whose distinct transactions the manager report counts."""
    from storepulse.operators import traffic
    held = []
    monkeypatch.setattr(common, "TASK_ROWS", 250)
    monkeypatch.setattr(traffic, "reuse", lambda df: held.append(plan(df)) or common.reuse(df))
    traffic.customer_traffic(retail, "2001-08-02", "day", "1995-01-01", "2001-08-01")
    n = -(-retail["sales_transaction_items"].count() // 250)
    assert held[0].count(f", {n}), REPARTITION_BY_NUM") == 2


def test_a_task_s_share_of_lines(spark, retail, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 250)
    parts = common.line_parts(retail)
    sizes = common.lines_by_transaction(retail, None, parts).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == parts > 20 and max(sizes) < 2 * 250


def test_any_number_of_partitions_gives_the_same_rows(spark, retail, monkeypatch):
    def rows():
        as_of, days = "2001-08-02", 2500
        found = [sales.top_selling_products(retail, as_of, 10, days), category.category_performance(retail, as_of, days),
                 category.popular_products_by_category(retail, as_of, None, 10, days, "growth_rate"),
                 basket.frequently_bought_together(retail, as_of, days)]
        return [sorted(map(tuple, df.collect())) for df in found]

    want = rows()
    monkeypatch.setattr(common, "TASK_ROWS", 500)
    assert rows() == want


def test_basket_rows_cells_and_pairs_are_dealt_by_number(spark, retail, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 500)
    n = common.line_parts(retail)
    rows = basket.basket_rows(retail, None)
    assert rows.rdd.getNumPartitions() == n > 8
    text = plan(basket.frequently_bought_together_where(retail, None))
    assert "REPARTITION_BY_NUM" in text and "Exchange hashpartitioning(a" in text


def test_pairs_in_hand_are_few():
    """Pairs of a wide cell: the arrays of a worker stay far below the former
    two hundred MB."""
    names = 6_000
    pdf = pd.DataFrame({"transaction_id": np.ones(names, np.int64), "low": 0, "high": 0, "mine": 0,
                        "name_id": np.arange(names), "c": 1})
    tracemalloc.start()
    try:
        total = sum(len(a) for a, _, _ in basket._cells([pdf]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == names * (names - 1) // 2
    assert peak < 20 << 20
