"""Role report jobs -- run the role's operators and write them as
one bundle (S4).

Each section scans with its own pushed-down date filter.  Where the facts fit
the executors' memory and disk, ``persist_facts=True`` keeps the transaction /
item projections cached across the sections (MEMORY_AND_DISK, so an evicted
or lost block is re-read or recomputed from lineage).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from storepulse.operators import category, inventory, promo, sales, traffic
from storepulse.sources.report import write_report_bundle

FACTS = ("sales_transactions", "sales_transaction_items")


@contextmanager
def _shared_facts(r: dict, enabled: bool):
    if not enabled:
        yield r
        return
    cached = {k: r[k].persist(StorageLevel.MEMORY_AND_DISK) for k in FACTS}
    try:
        yield {**r, **cached}
    finally:
        for df in cached.values():
            df.unpersist()


def manager_report(spark: SparkSession, r: dict, as_of, out_dir: str, days: int = 30, limit: int = 10,
                   period_type: str = "day", traffic_start=None, traffic_end=None,
                   fmt: str = "parquet", persist_facts: bool = False) -> DataFrame:
    """Sales trend, top products, customer traffic, inventory usage,
    promotion effectiveness and product trends (without the three per-name
    total columns, de-duplicated)."""
    with _shared_facts(r, persist_facts) as rr:
        trends = sales.product_sales_trends(rr, as_of, days, limit)
        sections = {
            "Sales Trend Analysis": sales.sales_trend(rr, as_of, days),
            "Top Selling Products": sales.top_selling_products(rr, as_of, limit, days),
            "Customer Traffic Analysis": traffic.customer_traffic(rr, as_of, period_type, traffic_start, traffic_end),
            "Inventory Usage Insights": inventory.inventory_usage(rr, as_of),
            "Promotion Effectiveness": promo.promotion_effectiveness(rr, as_of, days),
            "Product Sales Trends": trends.drop("total_quantity", "avg_daily_quantity", "days_with_sales").distinct(),
        }
        return write_report_bundle(spark, "Manager Analytics Report", sections, out_dir, as_of, fmt)


def sales_report(spark: SparkSession, r: dict, as_of, out_dir: str, days: int = 30, limit: int = 10,
                 promo_period=None, non_promo_period=None, fmt: str = "parquet",
                 persist_facts: bool = False) -> DataFrame:
    """today's dashboard, promotional comparison, buying behaviour,
    popular products and seasonal (monthly) trends."""
    with _shared_facts(r, persist_facts) as rr:
        sections = {"Today's Sales Dashboard": sales.todays_dashboard(rr, as_of)}
        if promo_period and non_promo_period:
            sections["Promotional Comparison"] = promo.promo_vs_non_promo(rr, *promo_period, *non_promo_period)
        sections["Customer Buying Behavior"] = sales.transaction_behavior(rr, as_of, days)
        sections["Popular Products for Promotion"] = category.popular_products_by_category(rr, as_of, None, limit, days)
        sections["Seasonal Sales Trends"] = sales.monthly_sales(rr, as_of)
        return write_report_bundle(spark, "Sales Manager Analytics Report", sections, out_dir, as_of, fmt)


def inventory_report(spark: SparkSession, r: dict, as_of, out_dir: str, days: int = 30,
                     fmt: str = "parquet", persist_facts: bool = False) -> DataFrame:
    """Low stock, predicted high demand, movement by category."""
    with _shared_facts(r, persist_facts) as rr:
        sections = {
            "Low Stock Products": inventory.low_stock_products(rr),
            "Predicted High Demand Products": inventory.predicted_high_demand(rr, as_of, days),
            "Inventory Movement by Category": inventory.inventory_movement_trends(rr, as_of, days),
        }
        return write_report_bundle(spark, "Inventory Management Report", sections, out_dir, as_of, fmt)
