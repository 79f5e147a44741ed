"""Edge cases on hand-made frames."""

import datetime as dt
import itertools
from collections import Counter

import numpy as np
import pandas as pd

from storepulse.operators import basket, category, forecast, inventory, sales, traffic, trends
from tests.micro import item, make, product, ts

AS_OF = "2024-03-10 12:00:00"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_empty_inputs(spark):
    r = make(spark)
    assert sales.sales_trend(r, AS_OF, 30).count() == 0
    dash = rows(sales.todays_dashboard(r, AS_OF))
    assert dash == [{"todays_transactions": 0, "todays_revenue": 0.0, "avg_transaction_value": 0.0,
                     "data_timestamp": ts(AS_OF)}]
    assert sales.transaction_behavior(r, AS_OF, 30).count() == 0  # GROUP BY a constant on no rows
    assert traffic.customer_traffic(r, AS_OF, "day").count() == 0
    assert sales.hourly_kpis(sales.hourly_sales(r, AS_OF)).count() == 0


def test_null_supplier_zero_stock_and_no_sales(spark):
    r = make(spark, products=[product(1, stock=0, supplier_id=None), product(2, stock=25, reorder=20),
                              product(3, stock=90)])
    low = rows(inventory.low_stock_products(r))
    assert [(x["product_name"], x["stock_status"], x["supplier_name"]) for x in low] == [
        ("P1", "Out of Stock", None), ("P2", "Low", "Sup 1")]
    usage = {x["product_name"]: x for x in rows(inventory.inventory_usage(r, AS_OF))}
    assert usage["P3"]["sold_last_week"] == 0 and usage["P3"]["stock_status"] == "High Stock"
    counts = rows(inventory.inventory_status_counts(inventory.inventory_usage(r, AS_OF)))[0]
    assert sum(counts.values()) == 3


def test_only_old_sales_get_nulls_d8(spark):
    r = make(spark,
             products=[product(1), product(2), product(3)],
             sales_transactions=[(1, ts("2023-01-01 10:00:00"), 500), (2, ts("2024-03-05 10:00:00"), 300)],
             sales_transaction_items=[item(1, 1, 5), item(2, 2, 3)])
    crit = {x["product_name"]: x for x in rows(inventory.critical_inventory(r, AS_OF))}
    assert crit["P1"]["sales_last_30_days"] is None and crit["P1"]["avg_daily_sales"] is None  # only old
    assert crit["P2"]["sales_last_30_days"] == 3 and crit["P2"]["avg_daily_sales"] == 3.0
    assert crit["P3"]["sales_last_30_days"] == 0 and crit["P3"]["avg_daily_sales"] == 0.0  # never sold
    rec = {x["product_name"] for x in rows(inventory.restock_recommendations(r, AS_OF, 30))}
    assert "P1" not in rec  # dropped by the post-join date filter


def test_top_k_ties_break_on_product_id(spark):
    r = make(spark, products=[product(i) for i in (5, 3, 9)],
             sales_transactions=[(1, ts("2024-03-01 10:00:00"), 100)],
             sales_transaction_items=[item(1, 5, 2), item(1, 3, 2), item(1, 9, 2)])
    top = rows(sales.top_selling_products(r, AS_OF, 2, 30))
    assert [x["product_name"] for x in top] == ["P3", "P5"]


def test_zero_previous_period_growth(spark):
    r = make(spark, sales_transactions=[(1, ts("2024-03-09 10:00:00"), 1000)])
    res = {x["period"]: x for x in rows(sales.sales_comparison(r, AS_OF, 7, "vs_last_period"))}
    assert res["Current Period"]["growth_percentage"] == 0.0
    assert res["Previous Period"]["total_sales"] == 0.0 and res["Previous Period"]["transaction_count"] == 0


def test_week_edges_w_mon(spark):
    # Mon 23:59 closes the week ending that Monday; Tue 00:00 opens the next
    r = make(spark, sales_transactions=[(1, ts("2024-03-04 23:59:00"), 100), (2, ts("2024-03-05 00:00:00"), 200)])
    res = rows(traffic.customer_traffic(r, AS_OF, "week", "2024-03-01 00:00:00", "2024-03-10 00:00:00"))
    assert [(x["transaction_date"], x["transaction_count"], x["period_label"], x["time_period"]) for x in res] == [
        (dt.datetime(2024, 3, 4), 1, "Week of Mar 04", 0), (dt.datetime(2024, 3, 11), 1, "Week of Mar 11", 1)]


def test_hour_labels_and_gap_fill(spark):
    r = make(spark, sales_transactions=[(1, ts("2024-03-09 09:15:00"), 100), (2, ts("2024-03-09 13:05:00"), 300)],
             sales_transaction_items=[item(1, 1, 1), item(2, 1, 3)])  # revenue comes from the items
    res = rows(traffic.customer_traffic(r, AS_OF, "hour", "2024-03-09 00:00:00", "2024-03-09 23:00:00"))
    assert [x["period_label"] for x in res] == ["09 AM", "10 AM", "11 AM", "12 PM", "01 PM"]
    assert [x["transaction_count"] for x in res] == [1, 0, 0, 0, 1]
    assert sum(x["total_revenue"] for x in res) == 4.0 and res[1]["avg_transaction_value"] == 0.0


def test_mid_month_start_misses_last_month_d11(spark):
    r = make(spark)
    spine = rows(trends.period_spine(spark, "monthly", "2024-01-15", "2024-03-10"))
    assert [x["period_date"] for x in spine] == [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    assert rows(trends.period_spine(spark, "quarterly", "2024-01-01", "2024-12-31"))[-1]["period_date"] == dt.date(2024, 10, 1)
    labels = rows(trends.advanced_sales_trends(r, AS_OF, "quarterly", "2024-01-01", "2024-06-30"))
    assert [x["period_label"] for x in labels] == ["Q1 2024", "Q2 2024"]


def test_short_series_skipped(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(7)]
    data = [("six", d, 100 * (i + 1)) for i, d in enumerate(days[:6])] + \
           [("seven", d, 100 * (i + 1)) for i, d in enumerate(days)]
    series = spark.createDataFrame(data, "series_key string, date date, value bigint")
    keys = {x["series_key"] for x in rows(forecast.forecast_moving_average(series))}
    assert keys == {"seven"}
    # window = min(7, 7 // 2) = 3, trailing mean with min_periods = 1
    fc = [x["forecast"] for x in sorted(rows(forecast.forecast_moving_average(series)), key=lambda x: x["date"])]
    expect = pd.Series([1, 2, 3, 4, 5, 6, 7], dtype=float).rolling(3, min_periods=1).mean().tolist()
    assert fc == expect
    ewm = [x["forecast"] for x in sorted(rows(forecast.forecast_exponential(series)), key=lambda x: x["date"])]
    ref = pd.Series([1, 2, 3, 4, 5, 6, 7], dtype=float).ewm(alpha=0.3, adjust=False).mean().round(4).tolist()
    assert ewm == ref
    proj = rows(forecast.project_linear_trend(series, 5))
    assert len(proj) == 5 and [x["forecast"] for x in sorted(proj, key=lambda x: x["step"])] == [8.0, 9.0, 10.0, 11.0, 12.0]


def _brute_pairs(baskets):
    """Reference semantics: name-sorted item rows, every position pair i < j."""
    c = Counter()
    for names in baskets:
        for a, b in itertools.combinations(sorted(names), 2):
            c[(a, b)] += 1
    return c


def test_basket_pairs_with_duplicates_match_brute_force(spark):
    products = [product(1, "apple"), product(2, "bread"), product(3, "apple"), product(4, "milk")]
    baskets = {1: [1, 2, 2, 4], 2: [1, 3, 2], 3: [2, 2], 4: [1, 2, 4], 5: [4]}
    txs = [(t, ts("2024-03-01 10:00:00"), 100) for t in baskets]
    items = [item(t, p) for t, ps in baskets.items() for p in ps]
    r = make(spark, products=products, sales_transactions=txs, sales_transaction_items=items)
    got = {(x["product_a"], x["product_b"]): x["frequency"]
           for x in rows(basket.frequently_bought_together_where(r, None, limit=100, min_frequency=1))}
    names = {p[0]: p[1] for p in products}
    qualifying = [[names[p] for p in ps] for ps in baskets.values() if len(set(ps)) >= 2]
    assert got == dict(_brute_pairs(qualifying))
    assert all(a <= b for a, b in got)


def test_basket_pairs_in_name_order_when_ids_are_not(spark):
    # product ids run against name order, and one name has two ids
    products = [product(1, "zucchini"), product(2, "melon"), product(3, "apple"), product(4, "zucchini")]
    baskets = {1: [1, 2, 3], 2: [4, 3], 3: [2, 1, 4], 4: [3, 2], 5: [1, 3, 2, 2]}
    txs = [(t, ts("2024-03-01 10:00:00"), 100) for t in baskets]
    items = [item(t, p) for t, ps in baskets.items() for p in ps]
    r = make(spark, products=products, sales_transactions=txs, sales_transaction_items=items)
    got = rows(basket.frequently_bought_together_where(r, None, limit=100, min_frequency=1))
    names = {p[0]: p[1] for p in products}
    brute = dict(_brute_pairs([[names[p] for p in ps] for ps in baskets.values() if len(set(ps)) >= 2]))
    assert {(x["product_a"], x["product_b"]): x["frequency"] for x in got} == brute
    per_a = {}
    for a, _ in brute:
        per_a[a] = per_a.get(a, 0) + 1
    for x in got:
        assert x["product_a"] <= x["product_b"]
        assert x["confidence"] == round(x["frequency"] / per_a[x["product_a"]] + 1e-12, 3)


def test_category_share_and_dispatch(spark, retail):
    perf = rows(category.category_performance(retail, "2001-08-02", 2500))
    assert abs(sum(x["revenue_percentage"] for x in perf) - 100.0) < 0.05
    assert category.buying_behavior(retail, "unknown", "2001-08-02") is None
    assert traffic.default_period_type(1) == "hour" and traffic.default_period_type(30) == "day"
    assert traffic.default_period_type(120) == "week" and traffic.default_period_type(70, "load") == "week"


def test_stream_append_mode_emits_closed_windows(spark):
    from storepulse.streaming import live
    complete = {r["window_start"]: r["items_sold"] for r in live.stream_hourly_sales(spark, "/root/testdata/sf0.001").collect()}
    append = {r["window_start"]: r["items_sold"]
              for r in live.stream_hourly_sales(spark, "/root/testdata/sf0.001", "append").collect()}
    # append emits only windows the watermark has closed; those are final
    assert append and set(append) < set(complete)
    assert all(complete[k] == v for k, v in append.items())


def test_basket_empty_and_single_product_baskets(spark):
    r = make(spark, products=[product(1, "apple"), product(2, "bread")],
             sales_transactions=[(1, ts("2024-03-01 10:00:00"), 100)],
             sales_transaction_items=[item(1, 1), item(1, 1)])  # one product twice: not a basket
    assert basket.frequently_bought_together_where(r, None, min_frequency=1).count() == 0
    assert basket.frequently_bought_together_where(make(spark), None, min_frequency=1).count() == 0


def test_stream_resumes_from_its_folder(spark, tmp_path):
    """Stopped after the first file and started again with the second one: the
    result equals the batch answer, and nothing is read twice."""
    import pyarrow.parquet as pq

    from oracles.compare import compare, duck
    from oracles.queries_sql import ORACLES
    from storepulse.streaming import live
    table = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by("ts")
    half = table.num_rows // 2
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    (tmp_path / "in").mkdir()
    pq.write_table(table.slice(0, half), f"{folder}/events.parquet")
    first = live.stream_daily_dashboard(spark, folder, state=state).count()
    pq.write_table(table.slice(half), f"{folder}/events_2.parquet")
    assert 0 < first < live.stream_daily_dashboard(spark, folder, state=state).count()
    again = live.stream_daily_dashboard(spark, folder, state=state)  # nothing new
    assert not compare(again, duck("/root/testdata/sf0.001"), ORACLES["stream_daily_dashboard"])
    batches = sorted((tmp_path / "state" / "result").glob("batch-*"))
    assert sum(spark.read.parquet(str(b)).count() > 0 for b in batches) >= 2


def test_stream_update_mode_merges_across_epochs(spark, tmp_path):
    import pyarrow.parquet as pq

    from storepulse.streaming import live
    table = pq.read_table("/root/testdata/sf0.001/events.parquet")
    n = table.num_rows
    # three files -> three micro-batches; windows (days) recur across them
    for i, name in enumerate(["events.parquet", "events_2.parquet", "events_3.parquet"]):
        pq.write_table(table.slice(i * n // 3, n // 3 + (n if i == 2 else 0)), tmp_path / name)
    folder = str(tmp_path)
    complete = sorted(map(tuple, live.stream_daily_dashboard(spark, folder).collect()))
    update = sorted(map(tuple, live.stream_daily_dashboard(spark, folder, "update", max_files_per_trigger=1).collect()))
    assert update == complete


def test_exponential_mean_of_long_series_equals_the_loop(spark):
    """10,000 days: block and group edges, zero stretches longer than a group,
    short series beside it."""
    import random
    rng = random.Random(4)
    value = [rng.choice([0, 5, 10_000, 123_456_789]) for _ in range(10_000)]
    value[3000:5000] = [0] * 2000
    all_values = {"long": value, "first": [10**12] + [0] * 1500, "seven": [7, -3, 100, 0, 0, 5, 9], "block": list(range(64)), "more": [9] * 65}
    day = dt.date(1990, 1, 1)
    data = [(k, day + dt.timedelta(days=i), v) for k, vs in all_values.items() for i, v in enumerate(vs)]
    series = spark.createDataFrame(data, "series_key string, date date, value bigint").repartition(5)
    got = {(x["series_key"], x["date"]): x["forecast"] for x in rows(forecast.forecast_exponential(series))}
    for k, vs in all_values.items():
        e = None
        for i, v in enumerate(vs):
            e = float(v) if e is None else 0.7 * e + 0.3 * v
            assert abs(got[k, day + dt.timedelta(days=i)] - e / 100.0) <= 1e-4 + 1e-12 * abs(e), (k, i)
    plan = forecast.forecast_exponential(series)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(series_key") == 1
