"""Pair counting in two passes, over cells of baskets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storepulse.operators import basket
from tests.micro import item, make, product, ts


def cells_frame(rng, wide, blocks):
    """A wide basket and a small one, dealt to cells as the operator does."""
    rows = [(1, n, int(rng.integers(1, 4)), blocks) for n in range(wide)] + [(2, n, int(rng.integers(1, 4)), 1) for n in range(3)]
    out = []
    for tx, n, c, nb in rows:
        mine = n * 7 % nb
        out += [(tx, min(mine, o), max(mine, o), mine, n, c) for o in range(nb)]
    return rows, pd.DataFrame(sorted(out), columns=["transaction_id", "low", "high", "mine", "name_id", "c"])


@pytest.mark.parametrize("blocks", [1, 4])
def test_cells_of_a_wide_basket(monkeypatch, blocks):
    rows, pdf = cells_frame(np.random.default_rng(7), 40, blocks)
    brute = {}
    for tx in (1, 2):
        names = sorted(n for t, n, c, _ in rows if t == tx for _ in range(c))
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                brute[a, b] = brute.get((a, b), 0) + 1

    def found(sizes):
        got = {}
        for a, b, w in basket._cells(pdf[k:k + 13] for k in range(0, len(pdf), 13)):  # cells go on from batch to batch
            sizes.append(len(a))
            for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
                got[x, y] = got.get((x, y), 0) + z
        return got

    assert found([]) == brute
    monkeypatch.setattr(basket, "PAIRS", 7)  # a cell is cut between rows
    sizes = []
    assert found(sizes) == brute and len(sizes) > 20 and max(sizes) <= 7 + 40


def wide_basket_tables(spark, names):
    """A basket of many names and small ones that repeat some of its pairs."""
    small = [(t, p) for t in range(2, 8) for p in (5, 11, 17 + t % 2)]
    items = spark.range(names).selectExpr("1L AS transaction_id", "id AS product_id").unionByName(
        spark.createDataFrame(small, "transaction_id long, product_id long"))
    r = make(spark, sales_transactions=[(t, ts("2024-03-01 10:00:00"), 100) for t in range(1, 8)])
    r["products"] = spark.range(names).selectExpr(
        "id", "concat('P', id) AS name", "'s' AS sku", "1L AS category_id", "1L AS supplier_id", "5L AS current_stock", "2L AS reorder_level",
        "9L AS max_stock_level", "1L AS cost_cents", "true AS is_active")
    r["sales_transaction_items"] = items.selectExpr(
        "transaction_id", "product_id", "1L AS quantity", "1L AS unit_cents", "1L AS total_cents", "0L AS discount_cents", "CAST(NULL AS BIGINT) AS promotion_id")
    return r


def test_a_basket_of_20000_names_spreads_over_tasks(spark, monkeypatch):
    """Its cells are many and of bounded size; few of its pairs pass the
    hashed counts, and the rows are exact."""
    r = wide_basket_tables(spark, 2_000)
    monkeypatch.setattr(basket, "WIDE", 100)
    got = basket.frequently_bought_together_where(r, None).collect()
    want = {("P11", "P5"): 7, ("P17", "P5"): 4, ("P11", "P17"): 4, ("P18", "P5"): 4, ("P11", "P18"): 4}
    assert {(x["product_a"], x["product_b"]): x["frequency"] for x in got} == want
    assert {x["support"] for x in got} == {1.0, round(4 / 7, 3)}
    cells = basket.cells_of(basket.basket_rows(r, None))
    every = 2_000 * 1_999 // 2 + 18

    def passed(buckets):
        return basket.pair_counts(cells, basket.possible_pairs(cells, 3, buckets), buckets).agg(F.sum("w")).first()[0]

    assert passed(1 << 22) < every / 10  # two million pairs in four million counts
    assert basket.pair_counts(cells, None, 0).agg(F.sum("w")).first()[0] == every
    monkeypatch.setattr(basket, "WIDE", 1024)
    size = basket.cells_of(basket.basket_rows(wide_basket_tables(spark, 20_000), None)).groupBy("transaction_id", "low", "high").count()
    top = size.agg(F.max("count"), F.count("*")).first()
    assert top[0] < 3 * 1024 and top[1] > 200


def test_hashed_counts_are_merged_over_tasks(spark):
    """A pair that is frequent only over all tasks is not lost."""
    r = make(spark, products=[product(p) for p in range(6)], sales_transactions=[(t, ts("2024-03-01 10:00:00"), 100) for t in range(12)],
             sales_transaction_items=[item(t, p) for t in range(12) for p in (t % 3, 3 + t % 3)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = basket.frequently_bought_together_where(r, None, buckets=1 << 10).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(x["product_a"], x["product_b"]): x["frequency"] for x in got} == {("P0", "P3"): 4, ("P1", "P4"): 4, ("P2", "P5"): 4}
