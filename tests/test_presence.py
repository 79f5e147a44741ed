"""Bitmaps of products with any fact row, and the plans that use them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storepulse.operators import inventory
from storepulse.operators.presence import add_rows, bitmap_of, with_presence
from storepulse.session import shared_dir
from storepulse.sources.retail import load_retail, materialize_retail
from tests.micro import item, make, product, ts

AS_OF = "2024-03-31"


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "product_id long")


def test_flags_equal_a_semi_join(spark):
    held = [0, 1, 2, 7, 8, 32767, 32768, 32769, 65536, 65537, 10**12, 10**12 + 9, None, 7]
    asked = sorted({v + d for v in held if v is not None for d in (-1, 0, 1, 8)} - {-1})
    r = {"inventory_movements": ids(spark, held)}
    got = with_presence(ids(spark, asked), r, "inventory_movements", "flag").collect()
    assert {x["product_id"] for x in got if x["flag"]} == {v for v in held if v is not None} and len(got) == len(asked)
    empty = with_presence(ids(spark, asked), {"inventory_movements": ids(spark, [])}, "inventory_movements", "flag")
    assert empty.filter("flag").count() == 0 and empty.count() == len(asked)


def test_new_rows_extend_a_stored_bitmap(spark):
    stored = bitmap_of(ids(spark, [1, 40_000]))
    both = add_rows(stored, ids(spark, [2, 40_000, 70_000]))
    got = with_presence(ids(spark, range(0, 80_000, 1)), {"inventory_movements": ids(spark, []), "moved_products": both}, "inventory_movements", "flag")
    assert [x["product_id"] for x in got.filter("flag").orderBy("product_id").collect()] == [1, 2, 40_000, 70_000]


@pytest.fixture(scope="module")
def tables(spark):
    old, new = ts("2024-01-01 10:00:00"), ts("2024-03-20 10:00:00")
    return make(
        spark, products=[product(p, stock=5) for p in range(1, 7)],
        sales_transactions=[(1, old, 100), (2, new, 100)],
        sales_transaction_items=[item(1, 1), item(2, 2, 3), item(1, 3), item(2, 3, 5), item(99, 4, 2)],  # 99: no transaction
        inventory_movements=[(1, "inbound", 4, old), (2, "inbound", 6, new), (5, "outbound", 2, new)])


@pytest.mark.parametrize("layout", ["views", "canonical"])
def test_products_with_only_old_rows(spark, tables, layout):
    r = materialize_retail(tables, shared_dir(spark, "presence")) if layout == "canonical" else tables
    crit = {x["product_name"]: x for x in inventory.critical_inventory(r, AS_OF).collect()}
    assert [crit[f"P{p}"]["sales_last_30_days"] for p in range(1, 7)] == [None, 3, 5, 2, 0, 0]
    assert [crit[f"P{p}"]["inbound_last_30_days"] for p in range(1, 7)] == [None, 6, 0, 0, 0, 0]
    stock = {x["product_name"]: x["projected_daily_demand"] for x in inventory.restock_recommendations(r, AS_OF).collect()}
    assert stock == {"P2": 3.0, "P3": 5.0, "P4": 1.0, "P5": 1.0, "P6": 1.0}  # P1: all sales old
    sup = inventory.supplier_performance(r, AS_OF).collect()
    assert [(x["products_supplied"], x["delivery_count"], x["total_delivered"]) for x in sup] == [(5, 1, 6)]


def test_only_the_window_is_scanned(spark, retail):
    folder = shared_dir(spark, "presence-plan")
    materialize_retail(retail, folder)
    r = load_retail(spark, folder)
    asked = dt.datetime(2001, 8, 2)
    for query, column in ((inventory.critical_inventory, "transaction_date"), (inventory.restock_recommendations, "transaction_date"),
                          (inventory.supplier_performance, "movement_date"), (inventory.critical_inventory, "movement_date")):
        text = query(r, asked)._jdf.queryExecution().executedPlan().toString()
        facts = [x for x in text.splitlines() if "FileScan" in x and "quantity:bigint" in x]  # items, movements
        dated = [x for x in facts if f"GreaterThanOrEqual({column}," in x]
        assert len(dated) == 1 and all("GreaterThanOrEqual(" in x for x in facts), text
        assert "transaction_id" not in text  # no join of the facts


def test_bitmap_is_combined_before_the_shuffle(spark, retail):
    text = bitmap_of(retail["inventory_movements"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("bitmap_construct_agg") >= 1 and "partial_bitmap_construct_agg" in text
    assert bitmap_of(retail["inventory_movements"]).agg(F.sum(F.bitmap_count("bits"))).first()[0] == \
        retail["inventory_movements"].agg(F.count_distinct("product_id")).first()[0]
