"""Property checks on generated inputs."""

import datetime as dt
import itertools
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storepulse.operators import basket, category, forecast, inventory, traffic
from tests.micro import item, make, product

BASE = dt.datetime(2024, 3, 1)

baskets_strategy = st.lists(
    st.lists(st.integers(min_value=0, max_value=5), min_size=1, max_size=7), min_size=1, max_size=12)


@settings(max_examples=40, deadline=None)
@given(baskets_strategy)
def test_fold_matches_brute_force(baskets):
    """Numpy pairs of (basket, name, count), the basket cut into one to three
    blocks, == every position pair of the name-sorted basket."""
    rows = []
    for t, names in enumerate(baskets):
        blocks = 1 + t % 3
        for n, c in Counter(names).items():
            rows += [(t, min(n % blocks, o), max(n % blocks, o), n % blocks, n, c) for o in range(blocks)]
    pdf = pd.DataFrame(sorted(rows), columns=["transaction_id", "low", "high", "mine", "name_id", "c"])
    got = Counter()
    for a, b, w in basket._cells(iter([pdf.iloc[:3], pdf.iloc[3:]])):
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            got[x, y] += z
    brute = Counter()
    for names in baskets:
        for pair in itertools.combinations(sorted(names), 2):
            brute[pair] += 1
    assert {k: v for k, v in got.items() if v} == dict(brute)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5 * 24 * 60 - 1), st.integers(1, 9)), min_size=1, max_size=30))
def test_gap_filled_traffic_preserves_totals(spark, txs):
    """Sum over gap-filled buckets == sum over input, for every bucket size;
    bucket positions are consecutive."""
    t_rows = [(i + 1, BASE + dt.timedelta(minutes=m), 100 * q) for i, (m, q) in enumerate(txs)]
    i_rows = [item(i + 1, 1, q) for i, (_, q) in enumerate(txs)]
    r = make(spark, products=[product(1)], sales_transactions=t_rows, sales_transaction_items=i_rows)
    for period in ("hour", "day", "week"):
        res = traffic.customer_traffic(r, BASE, period, BASE, BASE + dt.timedelta(days=6)).collect()
        assert sum(x["transaction_count"] for x in res) == len(txs)
        assert sum(x["items_sold"] for x in res) == sum(q for _, q in txs)
        if period != "hour":
            assert [x["time_period"] for x in res] == list(range(len(res)))


def test_shares_statuses_and_horizon(spark, retail):
    perf = category.category_performance(retail, "2001-08-02", 2500).collect()
    assert abs(sum(x["revenue_percentage"] for x in perf) - 100.0) < 0.01 * len(perf)
    usage = inventory.inventory_usage(retail, "2001-08-02")
    counts = inventory.inventory_status_counts(usage).collect()[0]
    assert counts["low_stock"] + counts["medium_stock"] + counts["high_stock"] == usage.count()
    series = forecast.daily_series(retail, "2001-08-02", 2500, "category")
    for fn in (forecast.project_moving_average, forecast.project_linear_trend, forecast.project_exponential):
        per_key = {}
        for x in fn(series, 9).collect():
            per_key.setdefault(x["series_key"], []).append(x["step"])
            assert x["forecast"] >= 0
        assert per_key and all(sorted(v) == list(range(1, 10)) for v in per_key.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=7, max_size=40))
def test_line_fit_matches_numpy(values):
    """Closed-form least squares from exact integer sums == numpy.polyfit."""
    n = len(values)
    x = np.arange(n)
    sx, sxx, sy, sxy = x.sum(), (x * x).sum(), sum(values), int(np.dot(x, values))
    den = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / den
    intercept = (sy - slope * sx) / n
    ps, pi = np.polyfit(x, np.array(values, dtype=float), 1)
    assert abs(slope - ps) <= 1e-6 * max(1.0, abs(ps)) and abs(intercept - pi) <= 1e-6 * max(1.0, abs(pi))
