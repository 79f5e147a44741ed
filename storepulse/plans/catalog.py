"""Registry of runnable queries: key -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the driver's parquet tables through the retail view layer
and runs one operator (or a small composition) with the parameters in
``storepulse.plans.params``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storepulse.operators import sales as S
from storepulse.plans import params as P
from storepulse.sources.retail import RETAIL_TABLES, cache_dimensions, retail_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


_TABLE_CACHE: dict = {}


def _r(spark, sf_dir):
    """Retail views per (session, folder), built once like catalog entries;
    the small dimension tables are persisted, the facts stay scans."""
    key = (id(spark), sf_dir)
    hit = _TABLE_CACHE.get(key)
    if hit is None or hit[0] is not spark:
        # the session object is kept with its tables, so its id cannot be
        # reused by a later session while the entry exists
        hit = _TABLE_CACHE[key] = (spark, cache_dimensions(retail_tables(spark, sf_dir)))
    return hit[1]


def simple(key: str, build: Callable[[dict], DataFrame]) -> None:
    QUERIES[key] = lambda spark, sf_dir: build(_r(spark, sf_dir))


# ---------------------------------------------------------------- sales
simple("sales_trend", lambda r: S.sales_trend(r, P.AS_OF, P.FULL_DAYS))
simple("sales_trend_range", lambda r: S.sales_trend_range(r, P.RANGE_START, P.RANGE_END))
simple("sales_trend_metric", lambda r: S.sales_trend_metric(S.sales_trend(r, P.AS_OF, P.FULL_DAYS), "transactions"))
simple("sales_forecast_data", lambda r: S.sales_forecast_data(r, P.AS_OF, P.FULL_DAYS))
simple("peak_shopping_hours", lambda r: S.peak_shopping_hours(r, P.AS_OF, P.FULL_DAYS))
simple("top_selling_products", lambda r: S.top_selling_products(r, P.AS_OF, P.TOP_LIMIT, P.FULL_DAYS))
simple("popular_products_for_promotion",
       lambda r: S.popular_products_for_promotion(r, P.AS_OF, P.TOP_LIMIT, P.FULL_DAYS))
simple("product_sales_trends", lambda r: S.product_sales_trends(r, P.AS_OF, P.FULL_DAYS, P.TOP_LIMIT))
simple("product_trend_summary",
       lambda r: S.product_trend_summary(S.product_sales_trends(r, P.AS_OF, P.FULL_DAYS, P.TOP_LIMIT)))
simple("product_trend_top5_series",
       lambda r: S.product_trend_top5_series(S.product_sales_trends(r, P.AS_OF, P.FULL_DAYS, P.TOP_LIMIT)))
simple("todays_dashboard", lambda r: S.todays_dashboard(r, P.DAY_AS_OF))
simple("hourly_sales", lambda r: S.hourly_sales(r, P.DAY_AS_OF))
simple("hourly_kpis", lambda r: S.hourly_kpis(S.hourly_sales(r, P.DAY_AS_OF)))
simple("business_hours", lambda r: S.business_hours(S.hourly_sales(r, P.DAY_AS_OF)))
simple("todays_top_products", lambda r: S.todays_top_products(r, P.DAY_AS_OF, 5))
simple("recent_transactions", lambda r: S.recent_transactions(r, P.DAY_AS_OF, 10))
simple("transaction_behavior", lambda r: S.transaction_behavior(r, P.AS_OF, P.FULL_DAYS))
simple("avg_items_per_transaction", lambda r: S.avg_items_per_transaction(r, P.AS_OF, P.FULL_DAYS))
simple("avg_items_per_transaction_range",
       lambda r: S.avg_items_per_transaction_range(r, P.RANGE_START, P.RANGE_END))
simple("monthly_sales", lambda r: S.monthly_sales(r, P.AS_OF, P.FULL_DAYS))
for _m in ("revenue", "avg_transaction_value"):
    simple(f"sales_trend_metric_{_m}", lambda r, _m=_m: S.sales_trend_metric(S.sales_trend(r, P.AS_OF, P.FULL_DAYS), _m))
for _c in ("vs_last_period", "vs_last_month"):
    simple(f"sales_comparison_{_c}", lambda r, _c=_c: S.sales_comparison(r, P.AS_OF, 365, _c))
simple("sales_comparison", lambda r: S.sales_comparison(r, P.AS_OF, 365, P.COMPARISON))

# ---------------------------------------------------------------- traffic
from storepulse.operators import traffic as TR  # noqa: E402
from storepulse.operators import trends as RT  # noqa: E402

for _pt in ("hour", "day", "week", "month"):
    simple(f"customer_traffic_{_pt}",
           lambda r, _pt=_pt: TR.customer_traffic(r, P.AS_OF, _pt, P.HISTORY_START, P.HISTORY_END))
simple("traffic_summary",
       lambda r: TR.traffic_summary(TR.customer_traffic(r, P.AS_OF, "day", P.HISTORY_START, P.HISTORY_END)))
simple("traffic_layer_compare", lambda r: TR.traffic_layer_compare([
    ("A", TR.customer_traffic(r, P.AS_OF, "day", *P.LAYER_A), "day"),
    ("B", TR.customer_traffic(r, P.AS_OF, "day", *P.LAYER_B), "day")]))

# ---------------------------------------------------------------- trends
for _pt in ("daily", "weekly", "monthly", "quarterly"):
    simple(f"advanced_sales_trends_{_pt}",
           lambda r, _pt=_pt: RT.advanced_sales_trends(r, P.AS_OF, _pt, P.HISTORY_START, P.HISTORY_END))
    simple(f"category_sales_trends_{_pt}",
           lambda r, _pt=_pt: RT.category_sales_trends(r, P.AS_OF, _pt, P.HISTORY_START, P.HISTORY_END, 5))
simple("advanced_sales_trends_category",
       lambda r: RT.advanced_sales_trends(r, P.AS_OF, "weekly", P.HISTORY_START, P.HISTORY_END,
                                          category_id=P.CATEGORY_ID))
simple("advanced_sales_trends_product",
       lambda r: RT.advanced_sales_trends(r, P.AS_OF, "monthly", P.HISTORY_START, P.HISTORY_END,
                                          product_id=P.PRODUCT_ID))
simple("sales_summary_metrics", lambda r: RT.sales_summary_metrics(r, P.AS_OF, P.SUMMARY_START, P.HISTORY_END))

# ---------------------------------------------------------------- promotions
from storepulse.operators import promo as PR  # noqa: E402


def _eff(r):
    return PR.promotion_effectiveness(r, P.PROMO_AS_OF, P.PROMO_DAYS)


simple("promotion_effectiveness", _eff)
simple("promotion_effectiveness_filtered",
       lambda r: PR.promotion_effectiveness(r, P.PROMO_AS_OF, P.PROMO_DAYS, "bogo", "upcoming"))
simple("promotion_effectiveness_range",
       lambda r: PR.promotion_effectiveness(r, P.PROMO_AS_OF, P.PROMO_DAYS, start=P.PROMO_RANGE[0], end=P.PROMO_RANGE[1]))
simple("promotion_effectiveness_created",
       lambda r: PR.promotion_effectiveness_created(r, P.PROMO_AS_OF, P.PROMO_DAYS))
simple("promotion_kpis", lambda r: PR.promotion_kpis(_eff(r)))
simple("top_promotions", lambda r: PR.top_promotions(_eff(r), 8))
simple("promotion_type_share", lambda r: PR.promotion_type_share(_eff(r)))
simple("active_promotions", PR.active_promotions)
simple("promotion_dates", lambda r: PR.promotion_dates(r, P.PROMO_ID))
simple("promotion_comparison", lambda r: PR.promotion_comparison(r, P.PROMO_ID))
simple("promotional_impact", lambda r: PR.promotional_impact(r, P.PROMO_AS_OF, P.PROMO_DAYS))
simple("promo_vs_non_promo", lambda r: PR.promo_vs_non_promo(r, *P.PROMO_PERIOD, *P.NON_PROMO_PERIOD))
simple("promo_summary_cards",
       lambda r: PR.promo_summary_cards(PR.promo_vs_non_promo(r, *P.PROMO_PERIOD, *P.NON_PROMO_PERIOD)))

# ---------------------------------------------------------------- baskets
from storepulse.operators import basket as BK  # noqa: E402

simple("frequently_bought_together", lambda r: BK.frequently_bought_together(r, P.AS_OF, P.FULL_DAYS))
simple("frequently_bought_together_range",
       lambda r: BK.frequently_bought_together_range(r, P.RANGE_START, P.RANGE_END))
simple("top_associations", lambda r: BK.top_associations(BK.frequently_bought_together(r, P.AS_OF, P.FULL_DAYS)))

# ---------------------------------------------------------------- categories / product rankings
from storepulse.operators import category as CT  # noqa: E402

simple("category_performance", lambda r: CT.category_performance(r, P.AS_OF, P.FULL_DAYS))
simple("category_performance_range", lambda r: CT.category_performance_range(r, P.RANGE_START, P.RANGE_END))
simple("seasonal_trends", lambda r: CT.seasonal_trends(r, P.AS_OF, P.FULL_DAYS))
simple("seasonal_trends_range", lambda r: CT.seasonal_trends(r, P.AS_OF, start=P.RANGE_START, end=P.RANGE_END))
simple("popular_products_by_category",
       lambda r: CT.popular_products_by_category(r, P.AS_OF, None, P.TOP_LIMIT, P.FULL_DAYS, "total_revenue"))
simple("popular_products_by_category_filtered",
       lambda r: CT.popular_products_by_category(r, P.AS_OF, "PROMO", P.TOP_LIMIT, P.FULL_DAYS, "avg_price"))
simple("product_growth_by_category",
       lambda r: CT.product_growth_by_category(r, P.AS_OF, None, P.TOP_LIMIT, P.FULL_DAYS, "growth_rate"))
simple("top_products_range",
       lambda r: CT.top_products_range(r, P.RANGE_START, P.RANGE_END, None, P.TOP_LIMIT, "total_sold"))
simple("top_products_range_filtered",
       lambda r: CT.top_products_range(r, P.RANGE_START, P.RANGE_END, "SMALL", P.TOP_LIMIT, "total_revenue"))
simple("popular_products_view",
       lambda r: CT.popular_products_view(r, P.AS_OF, P.FULL_DAYS, "growth_rate", "All Categories", P.TOP_LIMIT))
simple("popular_products_view_range",
       lambda r: CT.popular_products_view(r, P.AS_OF, P.FULL_DAYS, "avg_price", "LARGE", P.TOP_LIMIT,
                                          P.RANGE_START, P.RANGE_END))
simple("popular_products_view_range_growth",
       lambda r: CT.popular_products_view(r, P.AS_OF, P.FULL_DAYS, "growth_rate", "All Categories", P.TOP_LIMIT,
                                          P.RANGE_START, P.RANGE_END))
simple("category_distribution", lambda r: CT.category_distribution(
    CT.popular_products_view(r, P.AS_OF, P.FULL_DAYS, "growth_rate", "All Categories", P.TOP_LIMIT)))
simple("buying_behavior", lambda r: CT.buying_behavior(r, "category_performance", P.AS_OF, P.FULL_DAYS,
                                                       P.RANGE_START, P.RANGE_END))

simple("buying_behavior_pairs", lambda r: CT.buying_behavior(r, "frequently_bought_together", P.AS_OF, P.FULL_DAYS,
                                                             P.RANGE_START, P.RANGE_END))
simple("buying_behavior_items", lambda r: CT.buying_behavior(r, "avg_items_per_transaction", P.AS_OF, P.FULL_DAYS))

# ---------------------------------------------------------------- inventory / restocking
from storepulse.operators import inventory as IV  # noqa: E402

simple("inventory_usage", lambda r: IV.inventory_usage(r, P.AS_OF))
simple("inventory_status_counts", lambda r: IV.inventory_status_counts(IV.inventory_usage(r, P.AS_OF)))
simple("low_stock_products", IV.low_stock_products)
simple("stock_alert_counts", lambda r: IV.stock_alert_counts(IV.low_stock_products(r)))
simple("urgent_reorder", lambda r: IV.urgent_reorder(r, 3))
simple("predicted_high_demand", lambda r: IV.predicted_high_demand(r, P.AS_OF, P.FULL_DAYS))
simple("demand_risk_counts", lambda r: IV.demand_risk_counts(IV.predicted_high_demand(r, P.AS_OF, P.FULL_DAYS)))
simple("high_risk_top", lambda r: IV.high_risk_top(r, P.AS_OF, P.FULL_DAYS, 5))
simple("inventory_movement_trends", lambda r: IV.inventory_movement_trends(r, P.AS_OF, P.FULL_DAYS))
simple("inventory_value", IV.inventory_value)
simple("supplier_performance", lambda r: IV.supplier_performance(r, P.AS_OF, 30))
simple("critical_inventory", lambda r: IV.critical_inventory(r, P.AS_OF, 30))
simple("restock_recommendations", lambda r: IV.restock_recommendations(r, P.AS_OF, 30))

# ---------------------------------------------------------------- forecasts
from storepulse.operators import forecast as FC  # noqa: E402


def _cat_series(r):
    return FC.daily_series(r, P.AS_OF, P.FULL_DAYS, "category")


simple("forecast_moving_average", lambda r: FC.forecast_moving_average(_cat_series(r)))
simple("forecast_moving_average_all",
       lambda r: FC.forecast_moving_average(FC.daily_series(r, P.AS_OF, P.FULL_DAYS, "all")))
simple("forecast_linear_trend", lambda r: FC.forecast_linear_trend(_cat_series(r)))
simple("forecast_exponential", lambda r: FC.forecast_exponential(_cat_series(r)))
simple("project_moving_average", lambda r: FC.project_moving_average(_cat_series(r), P.FORECAST_HORIZON))
simple("project_linear_trend", lambda r: FC.project_linear_trend(_cat_series(r), P.FORECAST_HORIZON))
simple("project_exponential", lambda r: FC.project_exponential(_cat_series(r), P.FORECAST_HORIZON))
simple("forecast_quality", lambda r: FC.forecast_quality(_cat_series(r), "moving_average", P.FORECAST_HORIZON))
simple("avg_items_trendline",
       lambda r: FC.avg_items_trendline(S.avg_items_per_transaction(r, P.AS_OF, P.FULL_DAYS)))

# ---------------------------------------------------------------- the same forms from stored hourly cells
from storepulse.operators import cells as HC  # noqa: E402


def _cells(spark, sf_dir):
    """Cells of all facts, written to the shared folder and read back."""
    from storepulse.session import shared_dir as folder_for
    r, folder = _r(spark, sf_dir), folder_for(spark, "hour-cells")
    HC.store(r, folder)
    return HC.HourCells(r, spark.read.parquet(folder))


CELL_FORMS = {
    "sales_trend": lambda c: HC.sales_trend(c.since(P.AS_OF, P.FULL_DAYS)),
    "sales_trend_range": lambda c: HC.sales_trend(c.window(P.RANGE_START, P.RANGE_END)),
    "peak_shopping_hours": lambda c: HC.peak_shopping_hours(c.since(P.AS_OF, P.FULL_DAYS)),
    "avg_items_per_transaction": lambda c: HC.avg_items_per_transaction(c.since(P.AS_OF, P.FULL_DAYS)),
    "avg_items_per_transaction_range": lambda c: HC.avg_items_per_transaction(c.window(P.RANGE_START, P.RANGE_END)),
    "monthly_sales": lambda c: HC.monthly_sales(c.since(P.AS_OF, P.FULL_DAYS)),
    **{f"customer_traffic_{t}": (lambda c, t=t: HC.customer_traffic(c, P.AS_OF, t, P.HISTORY_START, P.HISTORY_END))
       for t in ("hour", "day", "week", "month")},
}
for _form, _build in CELL_FORMS.items():
    QUERIES[f"cells_{_form}"] = lambda spark, sf_dir, _build=_build: _build(_cells(spark, sf_dir))

# ---------------------------------------------------------------- streaming (closed input, availableNow)
from storepulse.streaming import live as ST  # noqa: E402

QUERIES["stream_hourly_sales"] = ST.stream_hourly_sales
QUERIES["stream_daily_dashboard"] = ST.stream_daily_dashboard
# item and order dates of the test tables lie up to seven years apart
QUERIES["stream_top_products"] = lambda spark, sf: ST.stream_top_products(spark, sf, early="2600 days", late="2600 days")
QUERIES["stream_traffic"] = ST.stream_traffic
QUERIES["stream_movement_totals"] = ST.stream_movement_totals

# ---------------------------------------------------------------- sources / sinks / reports
import datetime as _dt  # noqa: E402
from functools import reduce as _reduce  # noqa: E402

from pyspark.sql import functions as _F  # noqa: E402

from storepulse.plans import reports as RP  # noqa: E402
from storepulse.session import shared_dir  # noqa: E402
from storepulse.sources import tables as TB  # noqa: E402
from storepulse.sources.report import sheet_name, write_report_bundle  # noqa: E402

PARAM_SQL = """
SELECT CAST(transaction_date AS DATE) AS date, COUNT(*) AS transaction_count,
       CAST(SUM(total_cents) AS DOUBLE) / 100.0 AS daily_revenue
FROM sales_transactions
WHERE transaction_date BETWEEN :start AND :end
GROUP BY CAST(transaction_date AS DATE)
"""


@register("parameterised_sql")
def _param_sql(spark, sf_dir):
    r = _r(spark, sf_dir)
    TB.register(r)
    return TB.run_sql(spark, PARAM_SQL, start=_dt.datetime.fromisoformat(P.RANGE_START),
                      end=_dt.datetime.fromisoformat(P.RANGE_END))


@register("load_tables")
def _load(spark, sf_dir):
    raw = TB.load_tables(spark, sf_dir, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"],
                         register_views=False)
    return _reduce(lambda a, b: a.unionByName(b), [
        df.agg(_F.count(_F.lit(1)).alias("row_count")).select(_F.lit(name).alias("table_name"), "row_count")
        for name, df in raw.items()])


@register("table_row_counts")
def _counts(spark, sf_dir):
    r = _r(spark, sf_dir)
    return _reduce(lambda a, b: a.unionByName(b), [
        df.agg(_F.count(_F.lit(1)).alias("row_count")).select(_F.lit(name).alias("table_name"), "row_count")
        for name, df in ((t, r[t]) for t in RETAIL_TABLES)])


simple("schema_profile", TB.schema_profile)
simple("schema_profile_incomplete",
       lambda r: TB.schema_profile({k: v for k, v in r.items() if k != "promotion_products"}))


@register("report_bundle")
def _bundle(spark, sf_dir):
    """S4 read back: two titles that share their first 31 characters, and an
    empty section, which is not written."""
    r, folder = _r(spark, sf_dir), shared_dir(spark, "report-bundle")
    low = IV.low_stock_products(r)
    written = write_report_bundle(spark, "Stock", {
        "Inventory Movement by Category / all": IV.inventory_movement_trends(r, P.AS_OF, P.FULL_DAYS),
        "Inventory Movement by Category / low stock": low,
        "Nothing": low.limit(0),
    }, folder, P.AS_OF)
    names = [(m["section"], m["folder"]) for m in written.collect()]  # one row a section
    return _reduce(lambda a, b: a.unionByName(b), [
        spark.read.parquet(f"{folder}/{f}").agg(_F.count(_F.lit(1)).alias("row_count")).select(
            _F.lit(s).alias("section"), _F.lit(sheet_name(s)).alias("sheet_name"), _F.lit(f).alias("folder"), "row_count")
        for s, f in names])


@register("manager_report")
def _manager_report(spark, sf_dir):
    return RP.manager_report(spark, _r(spark, sf_dir), P.AS_OF, shared_dir(spark, "manager-report"),
                             days=P.FULL_DAYS, traffic_start=P.HISTORY_START, traffic_end=P.HISTORY_END)


@register("sales_report")
def _sales_report(spark, sf_dir):
    return RP.sales_report(spark, _r(spark, sf_dir), P.DAY_AS_OF, shared_dir(spark, "sales-report"),
                           days=P.FULL_DAYS, promo_period=P.PROMO_PERIOD, non_promo_period=P.NON_PROMO_PERIOD)


@register("inventory_report")
def _inventory_report(spark, sf_dir):
    return RP.inventory_report(spark, _r(spark, sf_dir), P.AS_OF, shared_dir(spark, "inventory-report"),
                               days=P.FULL_DAYS)

# ---------------------------------------------------------------- display helpers
from storepulse.functions import display as DP  # noqa: E402

simple("low_stock_display", lambda r: DP.table_view(IV.low_stock_products(r), 50))
simple("promo_comparison_display",
       lambda r: DP.comparison_display(PR.promo_vs_non_promo(r, *P.PROMO_PERIOD, *P.NON_PROMO_PERIOD)))
