"""Interval join against a double loop, and where its filters reach."""

import datetime as dt
import random

import pytest

from storepulse.operators import promo
from storepulse.operators.intervals import interval_join
from storepulse.session import shared_dir
from storepulse.sources.retail import materialize_retail

POINTS = "k bigint, at timestamp_ntz, p bigint"
INTERVALS = "k bigint, start_date date, end_date date, i bigint"
DAY = dt.datetime(2020, 1, 1)


def double_loop(points, intervals):
    def inside(at, a, b):
        first = a is None or at >= dt.datetime.combine(a, dt.time())
        return first and (b is None or at <= dt.datetime.combine(b, dt.time()))
    return [(k, at, p, a, b, i) for k, at, p in points for k2, a, b, i in intervals
            if k is not None and k == k2 and at is not None and inside(at, a, b)]


def joined(spark, points, intervals, **options):
    df = interval_join(spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS), ["k"], "at", **options)
    return sorted(((r["k"], r["at"], r["p"], r["start_date"], r["end_date"], r["i"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, days", [(1, 1), (2, 16), (3, 400)])
def test_overlapping_open_and_long_intervals(spark, seed, days):
    rng = random.Random(seed)
    day = lambda n: (DAY + dt.timedelta(days=n)).date()
    points = [(rng.choice([1, 2, 3, None]), DAY + dt.timedelta(days=rng.randrange(-40, 400), hours=rng.choice([0, 0, 7])), p) for p in range(300)]
    points += [(1, None, -1)]
    intervals = []
    for i in range(40):
        a = rng.randrange(0, 380)
        b = a + rng.choice([0, 0, 3, 30, 100, -5])
        intervals.append((rng.choice([1, 2, 3, 4, None]), day(a), day(b), i))
    if seed > 1:
        intervals += [(1, None, day(50), 50), (2, day(200), None, 51), (3, None, None, 52), (1, day(-2000), day(3000), 53)]
    got = joined(spark, points, intervals, days=days)
    assert got == sorted(double_loop(points, intervals), key=str) and len(got) > 40


def test_empty_sides(spark):
    assert joined(spark, [], [(1, DAY.date(), DAY.date(), 1)]) == []
    assert joined(spark, [(1, DAY, 1)], []) == []


@pytest.fixture(scope="module")
def canon(spark, retail):
    return materialize_retail(retail, shared_dir(spark, "canonical-intervals"))


@pytest.mark.parametrize("query", [
    lambda r: promo.promotion_effectiveness(r, "2001-08-02", 3650), lambda r: promo.promotion_effectiveness_created(r, "2001-08-02", 3650),
    lambda r: promo.promotional_impact(r, "2001-08-02", 3650)])
def test_dates_and_bins_come_before_the_fact_join(spark, canon, query):
    text = query(canon)._jdf.queryExecution().optimizedPlan().toString()
    facts = [x for x in text.splitlines() if "scalar-subquery" in x and "transaction_date" in x and "Filter" in x]
    assert len(facts) >= 2, text  # transactions and items
    assert "bin_" in text


def test_subquery_bounds_reach_the_files(spark, canon):
    df = promo.promotion_comparison(canon, 3)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("DataFilters: [") >= 2 and text.count("Subquery") >= 2
    scans = [x for x in text.splitlines() if "FileScan" in x and "transaction_date" in x]
    assert all("ReusedSubquery" in x or "Subquery" in x or "subquery" in x for x in scans), scans


def test_unknown_promotion_is_one_empty_row(spark, canon):
    row = promo.promotion_comparison(canon, 999).collect()
    assert len(row) == 1 and row[0]["revenue_during"] is None and row[0]["transactions_before"] == 0
