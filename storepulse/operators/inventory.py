"""Inventory and restocking operators.

Pattern: the big fact tables (items, movements) are reduced to one row per
product with conditional aggregates before they meet the product dimension,
so each operator is one scan + one compact shuffle + small joins.

The reference filters some LEFT JOINs with ``date >= x OR date IS NULL``
after the join (D8).  That keeps a product when it has *no* fact rows at all
or at least one recent row, and drops it when all its rows are old.  This is
reproduced exactly: the window is scanned for recent rows, and whether there is
any row at all is a bitmap of product ids (`presence`).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.columns import as_ts, exact_avg, ratio, round_half_up, since, to_datetime
from storepulse.operators.common import Tables, product_dim, sold_lines, top_k
from storepulse.operators.presence import with_presence


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _suppliers(r: Tables, prefix: str = "supplier") -> DataFrame:
    s = r["suppliers"]
    return s.select(F.col("id").alias("supplier_id"), F.col("name").alias(f"{prefix}_name"),
                    F.col("contact_person").alias("contact_person" if prefix == "supplier" else f"{prefix}_contact"),
                    F.col("phone").alias("phone" if prefix == "supplier" else f"{prefix}_phone"))


# ---------------------------------------------------------------- M6 / M7
def inventory_usage(r: Tables, as_of) -> DataFrame:
    """M6: active products with stock band (Low <= reorder, Medium <= 1.5 x
    reorder, else High) and quantity sold in the last 7 days (0 if none)."""
    sold = (sold_lines(r, since("transaction_date", as_of, 7))
            .groupBy("product_id").agg(F.sum("quantity").alias("sold")))
    stock, reorder = F.col("current_stock"), F.col("reorder_level")
    return (product_dim(r, active_only=True).join(sold, "product_id", "left")
            .select("product_name", "current_stock", "reorder_level", "category",
                    F.when(stock <= reorder, "Low Stock").when(stock <= reorder * 1.5, "Medium Stock")
                    .otherwise("High Stock").alias("stock_status"),
                    F.coalesce(F.col("sold"), F.lit(0)).cast("bigint").alias("sold_last_week"),
                    "product_id")
            .orderBy("current_stock", "product_id").drop("product_id"))


def inventory_status_counts(usage: DataFrame) -> DataFrame:
    """M7: number of Low / Medium / High Stock rows of an M6 frame."""
    s = F.col("stock_status")
    return usage.agg(_count_if(s == "Low Stock").alias("low_stock"),
                     _count_if(s == "Medium Stock").alias("medium_stock"),
                     _count_if(s == "High Stock").alias("high_stock"))


# ---------------------------------------------------------------- R1-R3
def _severity(stock: Column, reorder: Column) -> Column:
    return F.when(stock == 0, 1).when(stock <= reorder, 2).otherwise(3)


def low_stock_products(r: Tables) -> DataFrame:
    """Active products at or below 1.5 x reorder level with supplier
    contact (LEFT JOIN) and status Out of Stock / Critical / Low; most
    severe first, then lowest stock."""
    stock, reorder = F.col("current_stock"), F.col("reorder_level")
    p = product_dim(r, active_only=True).filter(stock <= reorder * 1.5)
    return (p.join(_suppliers(r), "supplier_id", "left")
            .select("product_name", "sku", "category", "current_stock", "reorder_level", "max_stock_level",
                    "supplier_name", "contact_person", "phone",
                    F.when(stock == 0, "Out of Stock").when(stock <= reorder, "Critical")
                    .when(stock <= reorder * 1.5, "Low").otherwise("Normal").alias("stock_status"),
                    _severity(stock, reorder).alias("_sev"), "product_id")
            .orderBy("_sev", "current_stock", "product_id").drop("_sev", "product_id"))


def stock_alert_counts(low: DataFrame) -> DataFrame:
    """R2: Out of Stock / Critical / Low counts of an R1 frame."""
    s = F.col("stock_status")
    return low.agg(_count_if(s == "Out of Stock").alias("out_of_stock"),
                   _count_if(s == "Critical").alias("critical"), _count_if(s == "Low").alias("low"))


def urgent_reorder(r: Tables, n: int = 3) -> DataFrame:
    """The first ``n`` Out of Stock / Critical rows in R1 order."""
    stock, reorder = F.col("current_stock"), F.col("reorder_level")
    p = product_dim(r, active_only=True).filter(stock <= reorder)
    return top_k(p, [_severity(stock, reorder), stock, F.col("product_id")], n).select(
        "product_name", "current_stock", "reorder_level")


# ---------------------------------------------------------------- R4 / R5
RISK_LABELS = ("High Demand Risk", "Medium Demand Risk", "Low Demand Risk")


def predicted_high_demand(r: Tables, as_of, days: int = 30) -> DataFrame:
    """Products sold in the window: mean of their per-day quantities,
    last-7-day quantity multiplied by the number of selling days (the
    reference's join repeats it once per day row, D6), demand risk from
    days of cover (<= 7 High, <= 14 Medium, else Low) and
    ceil(30 x daily mean) as reorder suggestion."""
    week_ago = as_ts(to_datetime(as_of) - _dt.timedelta(days=7))
    lines = sold_lines(r, since("transaction_date", as_of, days))
    daily = (lines.groupBy("product_id", F.to_date("transaction_date").alias("d"))
             .agg(F.sum("quantity").alias("q"),
                  F.sum(F.when(F.col("transaction_date") >= week_ago, F.col("quantity")).otherwise(0)).alias("wq")))
    per = (daily.groupBy("product_id")
           .agg(exact_avg("q").alias("avg_daily_sales"), F.count(F.lit(1)).alias("n_days"), F.sum("wq").alias("wq"))
           .filter(F.col("avg_daily_sales") > 0))
    cover = F.col("current_stock").cast("double") / F.nullif(F.col("avg_daily_sales"), F.lit(0.0))
    risk_idx = F.when(cover <= 7, 1).when(cover <= 14, 2).otherwise(3)
    return (product_dim(r, active_only=True).join(per, "product_id")
            .select("product_name", "sku", "category", "current_stock", "reorder_level", "avg_daily_sales",
                    (F.col("wq") * F.col("n_days")).cast("bigint").alias("total_sales_last_week"),
                    F.when(risk_idx == 1, RISK_LABELS[0]).when(risk_idx == 2, RISK_LABELS[1])
                    .otherwise(RISK_LABELS[2]).alias("demand_risk"),
                    F.ceil(F.col("avg_daily_sales") * 30.0).cast("bigint").alias("suggested_reorder_quantity"),
                    risk_idx.alias("_risk"), "product_id")
            .orderBy("_risk", F.col("avg_daily_sales").desc(), "product_id").drop("_risk", "product_id"))


def demand_risk_counts(demand: DataFrame) -> DataFrame:
    """High / Medium / Low demand-risk counts of an R4 frame."""
    d = F.col("demand_risk")
    return demand.agg(_count_if(d == RISK_LABELS[0]).alias("high_risk"),
                      _count_if(d == RISK_LABELS[1]).alias("medium_risk"),
                      _count_if(d == RISK_LABELS[2]).alias("low_risk"))


def high_risk_top(r: Tables, as_of, days: int = 30, n: int = 5) -> DataFrame:
    """R5 (chart): the first ``n`` High Demand Risk rows of R4."""
    return predicted_high_demand(r, as_of, days).filter(F.col("demand_risk") == RISK_LABELS[0]).limit(n)


# ---------------------------------------------------------------- R6
def inventory_movement_trends(r: Tables, as_of, days: int = 30) -> DataFrame:
    """Per category -- outbound / inbound totals, products moved, mean
    outbound / inbound quantity (NULL when none), from movements in the
    window.  Movements are reduced per product before the category join."""
    mv = r["inventory_movements"].filter(since("movement_date", as_of, days))
    out, inn = F.col("movement_type") == "outbound", F.col("movement_type") == "inbound"
    per_product = mv.groupBy("product_id").agg(
        F.sum(F.when(out, F.col("quantity")).otherwise(0)).alias("o_sum"),
        F.count(F.when(out, F.col("quantity"))).alias("o_n"),
        F.sum(F.when(inn, F.col("quantity")).otherwise(0)).alias("i_sum"),
        F.count(F.when(inn, F.col("quantity"))).alias("i_n"))
    return (per_product.join(product_dim(r).select("product_id", "category_id", "category"), "product_id")
            .groupBy("category_id", "category")
            .agg(F.sum("o_sum").alias("total_outbound"), F.sum("i_sum").alias("total_inbound"),
                 F.count(F.lit(1)).alias("products_with_movement"),
                 ratio(F.sum("o_sum"), F.sum("o_n")).alias("avg_outbound_quantity"),
                 ratio(F.sum("i_sum"), F.sum("i_n")).alias("avg_inbound_quantity"))
            .orderBy(F.col("total_outbound").desc(), "category").drop("category_id"))


# ---------------------------------------------------------------- R10
def inventory_value(r: Tables) -> DataFrame:
    """Per category of active products -- count, stock units, stock
    value (stock x cost), mean value per product, out-of-stock and low-stock
    counts, low-stock percentage (2 places)."""
    stock, reorder = F.col("current_stock"), F.col("reorder_level")
    value = stock * F.col("cost_cents")
    return (product_dim(r, active_only=True).groupBy("category_id", "category")
            .agg(F.count("product_id").alias("total_products"),
                 F.sum(stock).alias("total_stock_units"),
                 F.sum(value).alias("v_sum"), F.count(value).alias("v_n"),
                 _count_if(stock == 0).alias("out_of_stock_count"),
                 _count_if(stock <= reorder).alias("low_stock_count"))
            .select("category", "total_products", "total_stock_units",
                    (F.col("v_sum").cast("double") / 100.0).alias("total_inventory_value"),
                    (ratio(F.col("v_sum"), F.col("v_n")) / 100.0).alias("avg_product_value"),
                    "out_of_stock_count", "low_stock_count",
                    round_half_up(F.col("low_stock_count").cast("double") * 100.0
                                  / F.col("total_products").cast("double"), 2).alias("low_stock_percentage"))
            .orderBy(F.col("total_inventory_value").desc(), "category"))


# ---------------------------------------------------------------- R11
RATINGS = ("EXCELLENT", "GOOD", "FAIR", "POOR")


def supplier_performance(r: Tables, as_of, days: int = 30) -> DataFrame:
    """Per active supplier -- products supplied, inbound deliveries in
    the last ``days`` days (count, total, mean size, last date), stock
    health of its active products and a rating:
    EXCELLENT (>= 5 deliveries and <= 2 low-stock), GOOD (>= 3 and <= 5),
    FAIR (>= 1 or <= 8), else POOR -- with SQL three-valued logic when the
    supplier has no active products.  The post-join date filter (D8) drops
    products (and suppliers) whose movements are all older than the window.
    """
    mv = r["inventory_movements"]
    inbound = F.col("movement_type") == "inbound"
    is_recent = since("movement_date", as_of, days)
    # only the window is scanned; whether there are older movements is a bitmap
    per_product = (mv.filter(is_recent).groupBy("product_id")
                   .agg(_count_if(inbound).alias("deliveries"),
                        F.sum(F.when(inbound, F.col("quantity")).otherwise(0)).alias("delivered"),
                        F.sum(F.when(inbound, F.col("quantity"))).alias("in_sum"),
                        F.count(F.when(inbound, F.col("quantity"))).alias("in_n"),
                        F.max(F.when(inbound, F.col("movement_date"))).alias("last_in")))
    prods = r["products"].select(F.col("id").alias("product_id"), "supplier_id")
    # product rows surviving the filter: with a recent movement, or with none at all
    kept = (with_presence(prods, r, "inventory_movements", "moved").join(per_product, "product_id", "left")
            .filter(F.col("deliveries").isNotNull() | ~F.col("moved")))
    per_sup = (kept.groupBy("supplier_id")
               .agg(F.countDistinct("product_id").alias("products_supplied"),
                    F.coalesce(F.sum("deliveries"), F.lit(0)).cast("bigint").alias("delivery_count"),
                    F.coalesce(F.sum("delivered"), F.lit(0)).cast("bigint").alias("total_delivered"),
                    ratio(F.sum("in_sum"), F.sum("in_n")).alias("avg_delivery_size"),
                    F.max("last_in").alias("last_delivery_date")))
    sup = r["suppliers"].filter(F.col("is_active")).select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "contact_person", "phone")
    has_products = prods.select("supplier_id").distinct().withColumn("has_products", F.lit(True))
    stock, reorder = F.col("current_stock"), F.col("reorder_level")
    status = (r["products"].filter(F.col("is_active")).groupBy("supplier_id")
              .agg(_count_if(stock == 0).alias("out_of_stock_products"),
                   _count_if(stock <= reorder).alias("low_stock_products"),
                   F.sum(stock * F.col("cost_cents")).alias("value_cents")))
    base = (sup.join(per_sup, "supplier_id", "left").join(has_products, "supplier_id", "left")
            # suppliers without products keep their single all-NULL row
            .filter(F.col("products_supplied").isNotNull() | F.col("has_products").isNull())
            .join(status, "supplier_id", "left"))
    dc, low = F.coalesce(F.col("delivery_count"), F.lit(0)), F.col("low_stock_products")
    rating = (F.when((dc >= 5) & (low <= 2), RATINGS[0]).when((dc >= 3) & (low <= 5), RATINGS[1])
              .when((dc >= 1) | (low <= 8), RATINGS[2]).otherwise(RATINGS[3]))
    rating_idx = (F.when(rating == RATINGS[0], 1).when(rating == RATINGS[1], 2)
                  .when(rating == RATINGS[2], 3).otherwise(4))
    return (base.select("supplier_id", "supplier_name", "contact_person", "phone",
                        F.coalesce("products_supplied", F.lit(0)).alias("products_supplied"),
                        dc.alias("delivery_count"),
                        F.coalesce("total_delivered", F.lit(0)).cast("bigint").alias("total_delivered"),
                        "avg_delivery_size", "last_delivery_date", "out_of_stock_products", "low_stock_products",
                        (F.col("value_cents").cast("double") / 100.0).alias("total_inventory_value"),
                        rating.alias("performance_rating"), rating_idx.alias("_ri"))
            .orderBy("_ri", F.col("total_delivered").desc(), "supplier_id").drop("_ri"))


# ---------------------------------------------------------------- R12
def _items_dated(r: Tables, ok) -> DataFrame:
    """product_id, quantity and transaction_date of item rows whose date
    passes ``ok`` (which accepts a null date: rows without a transaction).
    The canonical layout keeps the date on the rows, so this is a scan of the
    window; the plain views have to ask the transactions."""
    items = r["sales_transaction_items"]
    if "transaction_date" not in items.columns:
        tx = r["sales_transactions"].select(F.col("id").alias("transaction_id"), "transaction_date")
        items = items.select("transaction_id", "product_id", "quantity").join(tx, "transaction_id", "left")
    return items.filter(ok).select("product_id", "quantity", "transaction_date")


def critical_inventory(r: Tables, as_of, days: int = 30) -> DataFrame:
    """Every active product with supplier contact, sales of the last
    ``days`` days (sum and mean quantity per item row), inbound/outbound
    movements and last restock of the window, status (OUT_OF_STOCK,
    CRITICAL, LOW, OVERSTOCKED >= 0.8 x max, NORMAL), days of stock left
    (1 place) and a suggested order max(2 x reorder, 30 x mean).  Products
    whose sales (or movements) are all older than the window get NULLs from
    the reference's post-join filter (D8); products without any get 0."""
    ok = since("transaction_date", as_of, days) | F.col("transaction_date").isNull()
    sales = (_items_dated(r, ok).groupBy("product_id")
             .agg(F.sum("quantity").alias("s_sum"), F.count("quantity").alias("s_n"), F.lit(True).alias("s_keep")))
    okm = since("movement_date", as_of, days) | F.col("movement_date").isNull()
    inbound, outbound = F.col("movement_type") == "inbound", F.col("movement_type") == "outbound"
    moves = (r["inventory_movements"].filter(okm).groupBy("product_id")
             .agg(F.sum(F.when(inbound, F.col("quantity")).otherwise(0)).alias("in30"),
                  F.sum(F.when(outbound, F.col("quantity")).otherwise(0)).alias("out30"),
                  F.max(F.when(inbound, F.col("movement_date"))).alias("last_restock_date"),
                  F.lit(True).alias("m_keep")))
    p = product_dim(r, active_only=True).join(_suppliers(r, "supplier"), "supplier_id", "left")
    p = with_presence(with_presence(p, r, "sales_transaction_items", "sold"), r, "inventory_movements", "moved")
    p = p.join(sales, "product_id", "left").join(moves, "product_id", "left")
    # A product with fact rows but none recent is absent from the CTE -> NULLs
    s_present = F.col("s_keep").isNotNull() | ~F.col("sold")
    m_present = F.col("m_keep").isNotNull() | ~F.col("moved")
    sales_30 = F.when(s_present, F.coalesce(F.col("s_sum"), F.lit(0)))
    avg_sales = F.when(s_present, F.coalesce(ratio(F.col("s_sum"), F.col("s_n")), F.lit(0.0)))
    stock, reorder, mx = F.col("current_stock"), F.col("reorder_level"), F.col("max_stock_level")
    status = (F.when(stock == 0, "OUT_OF_STOCK").when(stock <= reorder, "CRITICAL")
              .when(stock <= reorder * 1.5, "LOW").when(stock >= mx * 0.8, "OVERSTOCKED").otherwise("NORMAL"))
    sev = F.when(stock == 0, 1).when(stock <= reorder, 2).when(stock <= reorder * 1.5, 3).otherwise(4)
    out = p.select(
        "product_name", "sku", "category", "current_stock", "reorder_level", "max_stock_level",
        "supplier_name", F.col("contact_person").alias("supplier_contact"), F.col("phone").alias("supplier_phone"),
        sales_30.cast("bigint").alias("sales_last_30_days"), avg_sales.alias("avg_daily_sales"),
        F.when(m_present, F.coalesce(F.col("in30"), F.lit(0))).cast("bigint").alias("inbound_last_30_days"),
        F.when(m_present, F.coalesce(F.col("out30"), F.lit(0))).cast("bigint").alias("outbound_last_30_days"),
        F.when(m_present, F.col("last_restock_date")).alias("last_restock_date"),
        status.alias("stock_status"),
        F.when(avg_sales > 0, round_half_up(stock.cast("double") / avg_sales, 1)).alias("days_of_stock_remaining"),
        F.when(avg_sales > 0, F.greatest((reorder * 2).cast("double"), avg_sales * 30.0))
        .otherwise((reorder * 2).cast("double")).alias("suggested_order_quantity"),
        sev.alias("_sev"), "product_id")
    return (out.orderBy("_sev", F.col("avg_daily_sales").desc_nulls_first(), "current_stock", "product_id")
            .drop("_sev", "product_id"))


# ---------------------------------------------------------------- R13
def restock_recommendations(r: Tables, as_of, days_ahead: int = 30) -> DataFrame:
    """Active products whose stock does not cover ``days_ahead`` days
    of projected demand.  Demand = mean quantity per item row of the last
    14 days, else of the 14 days before, else 1; trend INCREASING (> +20%) /
    DECREASING (< -20%) / STABLE; priority by days of cover (7 / 14 / 21);
    order quantity = max(max - stock, demand x days - stock, 2 x reorder).
    Products whose sales are all older than 28 days drop out (D8)."""
    now = to_datetime(as_of)
    recent_start, prev_start = as_ts(now - _dt.timedelta(days=14)), as_ts(now - _dt.timedelta(days=28))
    ts = F.col("transaction_date")
    per = (_items_dated(r, (ts >= prev_start) | ts.isNull()).groupBy("product_id")
           .agg(exact_avg(F.when(ts >= recent_start, F.col("quantity"))).alias("recent"),
                exact_avg(F.when((ts >= prev_start) & (ts < recent_start), F.col("quantity"))).alias("previous"),
                F.lit(True).alias("keep")))
    # a product with a recent row, or with no item rows at all
    p = with_presence(product_dim(r, active_only=True), r, "sales_transaction_items", "sold").join(per, "product_id", "left")
    p = p.filter(F.col("keep").isNotNull() | ~F.col("sold"))
    demand = F.coalesce(F.col("recent"), F.col("previous"), F.lit(1.0))
    stock = F.col("current_stock")
    trend = (F.when(F.col("recent") > F.col("previous") * 1.2, "INCREASING")
             .when(F.col("recent") < F.col("previous") * 0.8, "DECREASING").otherwise("STABLE"))
    prio = F.when(stock <= demand * 7, 1).when(stock <= demand * 14, 2).when(stock <= demand * 21, 3).otherwise(4)
    return (p.join(_suppliers(r), "supplier_id", "left")
            .filter(stock <= demand * days_ahead)
            .select("product_name", "category", "supplier_name", "current_stock", "reorder_level",
                    demand.alias("projected_daily_demand"), trend.alias("demand_trend"),
                    (demand * days_ahead).alias("projected_demand_period"),
                    F.when(prio == 1, "URGENT").when(prio == 2, "HIGH").when(prio == 3, "MEDIUM")
                    .otherwise("LOW").alias("restock_priority"),
                    F.greatest((F.col("max_stock_level") - stock).cast("double"), demand * days_ahead - stock,
                               (F.col("reorder_level") * 2).cast("double")).alias("recommended_order_quantity"),
                    round_half_up(stock.cast("double") / F.nullif(demand, F.lit(0.0)), 1)
                    .alias("estimated_days_remaining"),
                    prio.alias("_p"), "product_id")
            .orderBy("_p", F.col("projected_daily_demand").desc(), "product_id").drop("_p", "product_id"))
