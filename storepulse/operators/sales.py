"""Sales trend, top-seller and live-day operators (M1-M5, M12-M15, A1-A9,
A11, A16).

All windows are expressed on the bare ``transaction_date`` column so they
push into the scan; per-product work is aggregated to one row per product
before the (small) product/category dimension is joined on.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.columns import (
    as_ts, between_ts, cents_avg, cents_sum, day_range, exact_avg, ratio,
    round_half_up, since, to_datetime,
)
from storepulse.operators.common import (
    Tables, items_in, line_parts, lines_by_transaction, product_dim, sold_lines, top_k, transactions,
)


# ---------------------------------------------------------------- M1 / M2 / M12
def _daily_sales(tx: DataFrame) -> DataFrame:
    return (tx.groupBy(F.to_date("transaction_date").alias("date"))
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 cents_sum("total_cents").alias("daily_revenue"),
                 cents_avg("total_cents").alias("avg_transaction_value")))


def sales_trend(r: Tables, as_of, days: int = 30) -> DataFrame:
    """M1: per day of the trailing window -- transaction count, revenue and
    average ticket.  (The reference's ``metric`` argument does not change
    the rows; see ``sales_trend_metric``.)"""
    return _daily_sales(transactions(r, since("transaction_date", as_of, days))).orderBy("date")


def sales_trend_range(r: Tables, start, end) -> DataFrame:
    """M2: as M1 over the closed range [start, end]."""
    return _daily_sales(transactions(r, between_ts("transaction_date", start, end))).orderBy("date")


METRIC_COLUMNS = {
    "revenue": "daily_revenue",
    "transactions": "transaction_count",
    "avg_transaction_value": "avg_transaction_value",
}


def sales_trend_metric(trend: DataFrame, metric: str = "revenue") -> DataFrame:
    """M3: pick the plotted column of an M1/M2 frame; unknown -> revenue."""
    col = METRIC_COLUMNS.get(metric, "daily_revenue")
    return trend.select("date", F.col(col).cast("double").alias("value"))


def sales_forecast_data(r: Tables, as_of, days: int = 30, start=None, end=None) -> DataFrame:
    """The daily series behind the forecasts (M1 columns, other order).
    Unlike the reference, an explicit [start, end] is honoured (D12)."""
    w = between_ts("transaction_date", start, end) if start and end else since("transaction_date", as_of, days)
    return (_daily_sales(transactions(r, w))
            .select("date", "daily_revenue", "transaction_count", "avg_transaction_value").orderBy("date"))


# ---------------------------------------------------------------- M4
def peak_shopping_hours(r: Tables, as_of, days: int = 7) -> DataFrame:
    """M4: transactions per hour of day in the trailing window."""
    return (transactions(r, since("transaction_date", as_of, days))
            .groupBy(F.hour("transaction_date").cast("bigint").alias("hour"))
            .agg(F.count(F.lit(1)).alias("transaction_count")).orderBy("hour"))


# ---------------------------------------------------------------- M5 / A9
def _product_sales(lines: DataFrame) -> DataFrame:
    """One row per product: quantity, revenue, distinct transactions, mean
    unit price.  The distinct count is planned inside the partitioning of
    the lines (dealt by transaction), so only one compact per-product shuffle
    follows."""
    return (lines.groupBy("product_id")
            .agg(F.sum("quantity").alias("qty"),
                 cents_sum("total_cents").alias("revenue"),
                 F.countDistinct("transaction_id").alias("n_tx"),
                 cents_avg("unit_cents").alias("avg_unit")))


def top_selling_products(r: Tables, as_of, limit: int = 10, days: int = 30) -> DataFrame:
    """M5: top ``limit`` products by quantity in the trailing window
    (ties broken by product id)."""
    window = since("transaction_date", as_of, days)
    agg = _product_sales(lines_by_transaction(r, window, line_parts(r, window)))
    ranked = agg.join(product_dim(r).select("product_id", "product_name", "category"), "product_id")
    return top_k(ranked, [F.col("qty").desc(), F.col("product_id").asc()], limit).select(
        "product_name", "category",
        F.col("qty").alias("total_quantity_sold"),
        F.col("revenue").alias("total_revenue"),
        F.col("n_tx").alias("sales_frequency"),
        F.col("avg_unit").alias("avg_price"))


def popular_products_for_promotion(r: Tables, as_of, limit: int = 10, days: int = 30) -> DataFrame:
    """M5 under the sales-manager column names."""
    return top_selling_products(r, as_of, limit, days).select(
        "product_name", "category",
        F.col("total_quantity_sold").alias("total_sold"),
        "total_revenue",
        F.col("sales_frequency").alias("total_transactions"),
        F.col("avg_price").alias("avg_selling_price"))


# ---------------------------------------------------------------- M13-M15
def product_sales_trends(r: Tables, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    """Daily quantity/revenue of the top ``limit`` (name, category)
    groups by total quantity.  Daily rows are joined back on the product
    *name only*, as the reference does (D9): a top name that also exists in
    another category brings that category's days along."""
    lines = sold_lines(r, since("transaction_date", as_of, days)).select("product_id", "transaction_date", "quantity", "total_cents")
    dim = product_dim(r).select("product_id", "product_name", "category")
    rank = [F.col("total_quantity").desc(), F.col("product_name").asc(), F.col("category").asc()]
    # the ranking needs one row per product only
    ranked = top_k(lines.groupBy("product_id").agg(F.sum("quantity").alias("q")).join(dim, "product_id")
                   .groupBy("product_name", "category").agg(F.sum("q").alias("total_quantity")), rank, limit)
    # days are kept for products of the ranked names alone
    names = F.broadcast(ranked.select("product_name").distinct())  # limit rows at most
    some = dim.join(names, "product_name", "left_semi")
    daily = (lines.join(some, "product_id")
             .groupBy("product_id", "product_name", "category", F.to_date("transaction_date").alias("sale_date"))
             .agg(F.sum("quantity").alias("daily_quantity"), F.sum("total_cents").alias("daily_cents")))
    totals = (daily.groupBy("product_name", "category")
              .agg(F.sum("daily_quantity").alias("total_quantity"),
                   exact_avg("daily_quantity").alias("avg_daily_quantity"),
                   F.countDistinct("sale_date").alias("days_with_sales")))
    top = top_k(totals, rank, limit)
    return (daily.join(top.select("product_name", "total_quantity", "avg_daily_quantity", "days_with_sales"),
                       "product_name")
            .select("product_name", "category", "sale_date", "daily_quantity",
                    (F.col("daily_cents").cast("double") / 100.0).alias("daily_revenue"),
                    "total_quantity", "avg_daily_quantity", "days_with_sales")
            .orderBy(F.col("total_quantity").desc(), F.col("sale_date").asc()))


def product_trend_summary(trends: DataFrame) -> DataFrame:
    """One row per (name, category) of an M13 frame: the three totals
    of the group's first row in total-quantity order.  They differ within a
    group only under the D9 fan-out and always come from one row."""
    first = F.max(F.struct("total_quantity", "avg_daily_quantity", "days_with_sales"))
    return trends.groupBy("product_name", "category").agg(first.alias("t")).select("product_name", "category", "t.*")


def product_trend_top5_series(trends: DataFrame, n: int = 5) -> DataFrame:
    """Daily rows of the first ``n`` product names in rank order."""
    names = (trends.groupBy("product_name").agg(F.max("total_quantity").alias("rank_qty")))
    first = top_k(names, [F.col("rank_qty").desc(), F.col("product_name").asc()], n).select("product_name")
    return (trends.join(F.broadcast(first), "product_name", "left_semi")  # n rows
            .select("product_name", "category", "sale_date", "daily_quantity", "daily_revenue")
            .orderBy("product_name", "sale_date"))


# ---------------------------------------------------------------- A1-A6 (one day)
def todays_dashboard(r: Tables, as_of) -> DataFrame:
    """A1: count, revenue and average ticket of the day holding ``as_of``;
    always exactly one row."""
    return (transactions(r, day_range("transaction_date", as_of, as_of))
            .agg(F.count(F.lit(1)).alias("todays_transactions"),
                 F.coalesce(cents_sum("total_cents"), F.lit(0.0)).alias("todays_revenue"),
                 F.coalesce(cents_avg("total_cents"), F.lit(0.0)).alias("avg_transaction_value"))
            .withColumn("data_timestamp", as_ts(as_of)))


def hourly_sales(r: Tables, as_of) -> DataFrame:
    """A2: revenue and items per hour of the day.  The transaction total is
    summed once per *item row* (D5), as the reference's join does."""
    lines = sold_lines(r, day_range("transaction_date", as_of, as_of))
    return (lines.groupBy(F.hour("transaction_date").cast("bigint").alias("hour"))
            .agg(F.coalesce(cents_sum("tx_cents"), F.lit(0.0)).alias("hourly_revenue"),
                 F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("items_sold"))
            .orderBy("hour"))


def hourly_kpis(hourly: DataFrame) -> DataFrame:
    """A3: revenue of the last listed hour, total items, and the hour with
    the highest revenue (earliest on ties) as 'H:00'.  One row (none when
    the day is empty)."""
    return (hourly.agg(F.max_by("hourly_revenue", "hour").alias("current_hour_sales"),
                       F.sum("items_sold").cast("bigint").alias("items_sold"),
                       F.max_by("hour", F.struct(F.col("hourly_revenue"), (-F.col("hour")).alias("neg_hour")))
                       .alias("peak"),
                       F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 0)
            .select("current_hour_sales", "items_sold",
                    F.concat(F.col("peak").cast("string"), F.lit(":00")).alias("peak_hour")))


def business_hours(hourly: DataFrame, first: int = 8, last: int = 22) -> DataFrame:
    """A4: A2 rows with 8 <= hour <= 22."""
    return hourly.filter(F.col("hour").between(first, last))


def todays_top_products(r: Tables, as_of, limit: int = 5) -> DataFrame:
    """A5: the day's top ``limit`` products by quantity (ties by id)."""
    lines = sold_lines(r, day_range("transaction_date", as_of, as_of))
    agg = lines.groupBy("product_id").agg(F.sum("quantity").alias("quantity_sold"),
                                          cents_sum("total_cents").alias("revenue"))
    names = r["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return top_k(agg.join(names, "product_id"), [F.col("quantity_sold").desc(), F.col("product_id").asc()],
                 limit).select("product_name", "quantity_sold", "revenue")


def recent_transactions(r: Tables, as_of, limit: int = 10) -> DataFrame:
    """The day's newest ``limit`` transactions with items, 'HH:mm'
    time and total (ties by id)."""
    lines = sold_lines(r, day_range("transaction_date", as_of, as_of))
    per_tx = lines.groupBy("transaction_id", "transaction_date", "tx_cents").agg(F.sum("quantity").alias("items"))
    return top_k(per_tx, [F.col("transaction_date").desc(), F.col("transaction_id").asc()], limit).select(
        F.date_format("transaction_date", "HH:mm").alias("time"), "items",
        (F.col("tx_cents").cast("double") / 100.0).alias("total"))


# ---------------------------------------------------------------- A7 / A8
def transaction_behavior(r: Tables, as_of, days: int = 30) -> DataFrame:
    """One 'All Transactions' row -- count, mean and sum of totals, mean
    items per transaction.  Items are pre-aggregated per transaction before
    the left join (joined on the transaction id, D4); no row when the window
    is empty (GROUP BY of a constant)."""
    window = since("transaction_date", as_of, days)
    per_tx = (items_in(r, window).groupBy("transaction_id")
              .agg(F.sum("quantity").alias("items_per_transaction")))
    tx = transactions(r, window).withColumnRenamed("id", "transaction_id")
    return (tx.join(per_tx, "transaction_id", "left")
            .groupBy(F.lit("All Transactions").alias("transaction_type"))
            .agg(F.count("transaction_id").alias("transaction_count"),
                 cents_avg("total_cents").alias("avg_purchase_amount"),
                 cents_sum("total_cents").alias("total_spent"),
                 exact_avg("items_per_transaction").alias("avg_items_per_transaction")))


def _avg_items(lines: DataFrame) -> DataFrame:
    return (lines.groupBy(F.to_date("transaction_date").alias("date"))
            .agg(F.countDistinct("transaction_id").alias("total_transactions"),
                 F.sum("quantity").alias("total_items"))
            .withColumn("avg_items", round_half_up(ratio(F.col("total_items"), F.col("total_transactions")), 2))
            .orderBy("date"))


def avg_items_per_transaction(r: Tables, as_of, days: int = 30) -> DataFrame:
    """Per day -- distinct transactions, items, items per transaction
    rounded to 2 places."""
    return _avg_items(sold_lines(r, since("transaction_date", as_of, days)))


def avg_items_per_transaction_range(r: Tables, start, end) -> DataFrame:
    """A8 over [start, end]."""
    return _avg_items(sold_lines(r, between_ts("transaction_date", start, end)))


# ---------------------------------------------------------------- A11
def monthly_sales(r: Tables, as_of, days: int = 365) -> DataFrame:
    """Revenue, count and mean ticket per (year, month) of the window."""
    return (transactions(r, since("transaction_date", as_of, days))
            .groupBy(F.year("transaction_date").cast("bigint").alias("year"),
                     F.month("transaction_date").cast("bigint").alias("month"))
            .agg(cents_sum("total_cents").alias("monthly_revenue"),
                 F.count(F.lit(1)).alias("monthly_transactions"),
                 cents_avg("total_cents").alias("avg_transaction_value"))
            .select("month", "year", "monthly_revenue", "monthly_transactions", "avg_transaction_value")
            .orderBy("year", "month"))


# ---------------------------------------------------------------- A16
COMPARISON_LABELS = {
    "vs_last_period": "Previous Period",
    "vs_last_year": "Same Period Last Year",
    "vs_last_month": "Previous Month",
}


def comparison_bounds(as_of, days: int = 30, comparison_type: str = "vs_last_period", start=None, end=None):
    """Day bounds (current_start, current_end, prev_start, prev_end): the
    earlier period is the current one moved back by its own length, by a year
    of 365 days or by 30 days."""
    last = to_datetime(end if start and end else as_of).date()
    length = (last - to_datetime(start).date()).days + 1 if start and end else days
    first = last - _dt.timedelta(days=length - 1)
    back = _dt.timedelta(days={"vs_last_period": length, "vs_last_year": 365}.get(comparison_type, 30))
    return first, last, first - back, last - back


def sales_comparison(r: Tables, as_of, days: int = 30, comparison_type: str = "vs_last_period",
                     start=None, end=None) -> DataFrame:
    """Current period vs a comparison period (whole days, inclusive).

    Both periods come out of ONE scan with conditional aggregates; growth is
    set on the 'Current Period' row only, when the previous total is > 0.
    """
    cs, ce, ps, pe = comparison_bounds(as_of, days, comparison_type, start, end)
    label = COMPARISON_LABELS.get(comparison_type, "Previous Period")
    cur = day_range("transaction_date", cs, ce)
    prev = day_range("transaction_date", ps, pe)
    tx = transactions(r, cur | prev)

    def stats(cond, p):
        c = F.when(cond, F.col("total_cents"))
        return [F.count(c).alias(f"{p}_n"), F.sum(c).alias(f"{p}_sum")]

    one = tx.agg(*stats(cur, "c"), *stats(prev, "p"))

    def row(p, name, growth):
        return F.struct(
            F.lit(name).alias("period"),
            F.coalesce(F.col(f"{p}_sum").cast("double") / 100.0, F.lit(0.0)).alias("total_sales"),
            F.col(f"{p}_n").alias("transaction_count"),
            F.coalesce(ratio(F.col(f"{p}_sum"), F.col(f"{p}_n")) / 100.0, F.lit(0.0)).alias("avg_transaction_value"),
            growth.alias("growth_percentage"))

    growth = F.when(F.col("p_sum") > 0, round_half_up(
        (F.col("c_sum") - F.col("p_sum")).cast("double") / F.col("p_sum").cast("double") * 100.0, 2)
    ).otherwise(F.lit(0.0))
    # both output rows are built from the single aggregate row (no re-scan)
    return (one.select(F.inline(F.array(row("c", "Current Period", growth), row("p", label, F.lit(0.0)))))
            .orderBy(F.col("period").desc()))
