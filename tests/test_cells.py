"""Hourly cells: rows equal to the direct forms, no fact scan, refresh."""

import datetime as dt

import pytest

from oracles.compare import canonical
from storepulse.operators import cells, sales, traffic
from storepulse.plans.catalog import CELL_FORMS
from storepulse.session import shared_dir
from storepulse.sources.retail import materialize_retail
from tests.micro import item, make, product


def same(a, b):
    return canonical([tuple(x) for x in a.collect()], a.columns) == canonical([tuple(x) for x in b.collect()], b.columns)


@pytest.fixture(scope="module")
def stored(spark, retail):
    canon = materialize_retail(retail, shared_dir(spark, "cells-facts"))
    folder = shared_dir(spark, "cells")
    cells.store(canon, folder)
    return cells.HourCells(canon, spark.read.parquet(folder))


@pytest.mark.parametrize("form", sorted(CELL_FORMS))
def test_no_fact_is_scanned(stored, form):
    text = CELL_FORMS[form](stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_tx" in text and "total_cents" not in text and "transaction_id" not in text, text


@pytest.mark.parametrize("start, end", [
    ("1996-03-05 10:17:00", "1996-09-17 21:40:30"), ("1996-03-05 10:00:00", "1996-03-05 10:30:00"), ("1996-03-05 10:00:00", "1996-03-05 09:00:00"),
    ("1990-01-01 00:00:00", "2030-01-01 00:00:00")])
def test_ranges_that_cut_an_hour_are_exact(stored, start, end):
    assert same(cells.sales_trend(stored.window(start, end)), sales.sales_trend_range(stored.r, start, end))
    assert same(cells.avg_items_per_transaction(stored.window(start, end)), sales.avg_items_per_transaction_range(stored.r, start, end))
    assert same(cells.customer_traffic(stored, None, "week", start, end), traffic.customer_traffic(stored.r, None, "week", start, end))


def test_only_changed_months_are_rewritten(spark, tmp_path):
    at = lambda m, d, h, s=0: dt.datetime(2024, m, d, h, 5, s)
    tx = [(1, at(1, 31, 23), 100), (2, at(2, 1, 0), 200), (3, at(2, 29, 23, 59), 300), (4, at(3, 1, 0), 400)]
    items = [item(1, 1), item(2, 1, 2), item(2, 2, 3), item(4, 1)]  # transaction 3 has no items
    folder = str(tmp_path / "cells")
    old = make(spark, products=[product(1), product(2)], sales_transactions=tx, sales_transaction_items=items)
    cells.store(old, folder)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*.parquet")}
    new = make(spark, products=[product(1), product(2)], sales_transactions=[*tx, (5, at(2, 10, 4), 900), (6, at(1, 1, 1), 7)],
               sales_transaction_items=[*items, item(5, 1, 9)])
    cells.refresh(new, folder, "2024-02-10", "2024-02-29")
    held = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*.parquet")}
    kept = {p for p in files if held.get(p) == files[p]}
    assert {p.parent.name for p in kept} == {"month=2024-01", "month=2024-03"}
    got = {x["date"].isoformat(): x["transaction_count"] for x in
           cells.sales_trend(cells.HourCells(new, spark.read.parquet(folder)).window("2024-01-01", "2024-04-01")).collect()}
    assert got == {"2024-01-31": 1, "2024-02-01": 1, "2024-02-10": 1, "2024-02-29": 1, "2024-03-01": 1}  # January was not asked for
    cells.refresh(new, folder, "2024-01-01", "2024-01-02")
    again = cells.HourCells(new, spark.read.parquet(folder))
    assert same(cells.sales_trend(again.window("2024-01-01", "2024-04-01")), sales.sales_trend_range(new, "2024-01-01", "2024-04-01"))
    assert same(cells.avg_items_per_transaction(again.window("2024-01-01", "2024-04-01")), sales.avg_items_per_transaction_range(new, "2024-01-01", "2024-04-01"))
