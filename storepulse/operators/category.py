"""Category and product-ranking operators."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.columns import (
    as_ts, between_ts, cents_avg, exact_avg, ratio, round_half_up, since, to_datetime,
)
from storepulse.operators.common import Tables, line_parts, lines_by_transaction, product_dim, reuse, sold_lines, top_k


# ---------------------------------------------------------------- A13
def _category_performance(r: Tables, window: Column) -> DataFrame:
    parts = line_parts(r, window)
    lines = lines_by_transaction(r, window, parts).select("transaction_id", "product_id", "quantity", "total_cents")
    cats = product_dim(r).select("product_id", "category_id", "category")
    sums = [F.sum(c).alias(c) for c in ("quantity", "total_cents", "n")]
    # one row per (transaction, product) before categories are joined, one per
    # (transaction, category) after, so transactions are counted, not collected
    sold = (lines.groupBy("transaction_id", "product_id")
            .agg(F.sum("quantity").alias("quantity"), F.sum("total_cents").alias("total_cents"), F.count("quantity").alias("n"))
            .join(cats, "product_id").repartition(parts, "transaction_id")
            .groupBy("category_id", "category", "transaction_id").agg(*sums))
    per_cat = (sold.groupBy("category_id", "category")
               .agg(F.count("transaction_id").alias("total_transactions"),
                    F.sum("quantity").alias("total_items_sold"), F.sum("total_cents").alias("cents"),
                    ratio(F.sum("quantity"), F.sum("n")).alias("avg_qty")))
    # the share window runs over one row per category
    grand = F.sum("cents").over(Window.partitionBy())
    return (per_cat.select(
        "category", "total_transactions", "total_items_sold",
        (F.col("cents").cast("double") / 100.0).alias("total_sales"),
        round_half_up(F.col("avg_qty"), 2).alias("avg_items_per_transaction"),
        round_half_up(F.col("cents").cast("double") * 100.0 / grand.cast("double"), 2).alias("revenue_percentage"))
        .orderBy(F.col("total_sales").desc(), F.col("category")))


def category_performance(r: Tables, as_of, days: int = 30) -> DataFrame:
    """Per category -- distinct transactions, items, sales, mean
    quantity per *item row* (2 places) and share of all sales (2 places)."""
    return _category_performance(r, since("transaction_date", as_of, days))


def category_performance_range(r: Tables, start, end) -> DataFrame:
    """A13 over [start, end]."""
    return _category_performance(r, between_ts("transaction_date", start, end))


# ---------------------------------------------------------------- A15
SEASON_ORDER = ["Winter", "Spring", "Summer", "Fall"]


def _season(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring")
            .when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Fall"))


def _season_idx(season: Column) -> Column:
    return (F.when(season == "Winter", 1).when(season == "Spring", 2)
            .when(season == "Summer", 3).when(season == "Fall", 4))


def seasonal_trends(r: Tables, as_of, days: int = 365, start=None, end=None) -> DataFrame:
    """Per season (months 12-2, 3-5, 6-8, 9-11) of the window: total
    sales (transaction totals repeated per item row, D5), sales per selling
    day (2 places), growth against the previous present season in Winter ..
    Fall order (2 places, 0 for the first) and the top category.

    One aggregation to (product, day), then to (season, category, day) feeds
    both the season stats and the category ranking; what follows is tiny.
    """
    w = between_ts("transaction_date", start, end) if start and end else since("transaction_date", as_of, days)
    lines = sold_lines(r, w).select("product_id", "transaction_date", "tx_cents")
    cats = product_dim(r).select("product_id", "category")
    # item rows are reduced to (product, day) before a dimension is joined
    daily = lines.groupBy("product_id", F.to_date("transaction_date").alias("day")).agg(F.sum("tx_cents").alias("cents"))
    base = reuse(daily.join(cats, "product_id")
                 .groupBy(_season(F.month("day")).alias("season"), "category", "day")
                 .agg(F.sum("cents").alias("cents")))
    stats = base.groupBy("season").agg(F.sum("cents").alias("cents"), F.countDistinct("day").alias("days"))
    by_cat = base.groupBy("season", "category").agg(F.sum("cents").alias("cat_cents"))
    top = (by_cat.withColumn("rk", F.row_number().over(
        Window.partitionBy("season").orderBy(F.col("cat_cents").desc(), F.col("category"))))
        .filter(F.col("rk") == 1).select("season", F.col("category").alias("top_category")))
    prev = F.lag("cents").over(Window.orderBy(_season_idx(F.col("season"))))  # <= 4 rows
    growth = F.when(prev.isNotNull(), round_half_up(
        (F.col("cents") - prev).cast("double") / prev.cast("double") * 100.0, 2)).otherwise(F.lit(0.0))
    return (stats.join(top, "season", "left")
            .select("season", (F.col("cents").cast("double") / 100.0).alias("total_sales"),
                    round_half_up((F.col("cents").cast("double") / 100.0) / F.nullif(F.col("days"), F.lit(0)), 2)
                    .alias("avg_daily_sales"),
                    growth.alias("growth_rate"), "top_category")
            .orderBy(_season_idx(F.col("season"))))


# ---------------------------------------------------------------- A17 / A18 / R14
SORT_COLUMNS = {"total_sold": "total_sold", "total_revenue": "total_revenue",
                "avg_price": "avg_selling_price", "growth_rate": "growth_rate"}


def _product_ranking(r: Tables, window: Column, category, limit: int, metric: str,
                     midpoint=None) -> DataFrame:
    lines = lines_by_transaction(r, window, line_parts(r, window)).select(
        "transaction_id", "product_id", "quantity", "unit_cents", "total_cents", "transaction_date")
    dim = product_dim(r, active_only=True).select("product_id", "product_name", "category")
    if category and category != "All Categories":
        dim = dim.filter(F.col("category") == F.lit(category))
    aggs = [F.sum("quantity").alias("total_sold"),
            F.sum("total_cents").alias("cents"),
            F.countDistinct("transaction_id").alias("total_transactions"),
            cents_avg("unit_cents").alias("avg_selling_price")]
    if midpoint is not None:
        late = F.col("transaction_date") >= as_ts(midpoint)
        aggs += [exact_avg(F.when(late, F.col("quantity"))).alias("avg_late"),
                 exact_avg(F.when(~late, F.col("quantity"))).alias("avg_early")]
    per = (lines.groupBy("product_id").agg(*aggs).filter(F.col("total_sold") > 0)
           .join(dim, "product_id"))
    cols = ["product_name", "category", "total_sold",
            (F.col("cents").cast("double") / 100.0).alias("total_revenue"),
            "total_transactions", "avg_selling_price"]
    if midpoint is not None:
        cols.append(F.when((F.col("avg_late") > 0) & (F.col("avg_early") > 0), round_half_up(
            (F.col("avg_late") - F.col("avg_early")) / F.col("avg_early") * 100.0, 2)).otherwise(F.lit(0.0))
            .alias("growth_rate"))
        sort = SORT_COLUMNS.get(metric, "total_sold")
    else:
        sort = {k: v for k, v in SORT_COLUMNS.items() if k != "growth_rate"}.get(metric, "total_sold")
    ranked = per.select("product_id", *cols)
    return top_k(ranked, [F.col(sort).desc(), F.col("product_id")], limit).drop("product_id")


def popular_products_by_category(r: Tables, as_of, category=None, limit: int = 10, days: int = 30,
                                 metric: str = "total_sold") -> DataFrame:
    """Active products of the window (optionally one category),
    quantity > 0, ranked by ``metric``.  growth_rate compares the mean
    quantity per item row in the second half of the window with the first
    half (2 places; 0 unless both are > 0) -- R14's rule, used in place of
    A17's random number (D7)."""
    start = to_datetime(as_of) - _dt.timedelta(days=days)
    mid = start + _dt.timedelta(days=days / 2)
    return _product_ranking(r, since("transaction_date", as_of, days), category, limit, metric, mid)


product_growth_by_category = popular_products_by_category


def top_products_range(r: Tables, start, end, category=None, limit: int = 10,
                       metric: str = "total_sold") -> DataFrame:
    """A18 (= R15): A17 over [start, end] without growth_rate."""
    return _product_ranking(r, between_ts("transaction_date", start, end), category, limit, metric)


def popular_products_view(r: Tables, as_of, days: int = 30, metric: str = "total_sold",
                          category: str = "All Categories", limit: int = 10, start=None, end=None) -> DataFrame:
    """The product table of the sales page -- range form (A18) when both
    dates are given, else A17; columns renamed (avg_price,
    transaction_count); growth_rate from the half-period rule when the
    source lacks it (D7); filtered to the category; sorted by ``metric``
    when it is a column; first ``limit`` rows."""
    if start and end:
        s, e = to_datetime(start), to_datetime(end)
        mid = s + (e - s) / 2
        # the range form knows no growth order: it takes the best sellers and
        # only shows them in order of growth
        by = metric if metric != "growth_rate" else "total_sold"
        df = _product_ranking(r, between_ts("transaction_date", s, e), category, limit, by, mid)
    else:
        df = popular_products_by_category(r, as_of, category, limit, days, metric)
    df = (df.withColumnRenamed("avg_selling_price", "avg_price")
          .withColumnRenamed("total_transactions", "transaction_count"))
    if category != "All Categories":
        df = df.filter(F.col("category") == F.lit(category))
    order = [F.col(metric).desc()] if metric in df.columns else []
    return top_k(df, order + [F.col("product_name"), F.col("category")], limit)


def category_distribution(view: DataFrame) -> DataFrame:
    """Products per category of an A19 frame and their percentage."""
    counts = view.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the few categories
    return counts.select("category", "n", (F.col("n").cast("double") * 100.0 / total.cast("double")).alias("share"))


# ---------------------------------------------------------------- A26
def buying_behavior(r: Tables, analysis_type: str, as_of, days: int = 30, start=None, end=None):
    """Route to A12 / A13 / A8 (their range forms when both dates are
    given); ``None`` for an unknown analysis type."""
    from storepulse.operators import basket, sales

    ranged = bool(start and end)
    if analysis_type == "frequently_bought_together":
        return (basket.frequently_bought_together_range(r, start, end) if ranged
                else basket.frequently_bought_together(r, as_of, days))
    if analysis_type == "category_performance":
        return category_performance_range(r, start, end) if ranged else category_performance(r, as_of, days)
    if analysis_type == "avg_items_per_transaction":
        return (sales.avg_items_per_transaction_range(r, start, end) if ranged
                else sales.avg_items_per_transaction(r, as_of, days))
    return None
