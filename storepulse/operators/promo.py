"""Promotion operators.

The reference joins every promotion to *all* item rows of its products and
filters afterwards.  Here each figure is computed at the level it needs:
item rows are first reduced to what can contribute (matching promotion id,
or one row per product for all-time totals), so the big item table is
scanned once with a pushed-down filter and shuffled only as compact partial
aggregates.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.columns import as_ts, between_ts, cents_avg, ratio, round_half_up, to_datetime
from storepulse.operators.common import Tables, items_in, sold_lines, top_k
from storepulse.operators.intervals import bounds, interval_join, within


def _ts_of(date_col: str):
    return F.col(date_col).cast("timestamp_ntz")


def _select_promotions(p: DataFrame, as_of, days, promotion_type, status, start, end,
                       window_col: str, status_now) -> DataFrame:
    if start and end:
        p = p.filter((_ts_of("start_date") >= as_ts(start)) & (_ts_of("end_date") <= as_ts(end)))
    else:
        p = p.filter(_ts_of(window_col) >= as_ts(to_datetime(as_of) - _dt.timedelta(days=days)))
    if promotion_type:
        p = p.filter(F.col("promotion_type") == F.lit(promotion_type))
    if status == "active":
        p = p.filter((F.col("start_date") <= status_now) & (F.col("end_date") >= status_now))
    elif status == "expired":
        p = p.filter(F.col("end_date") < status_now)
    elif status == "upcoming":
        p = p.filter(F.col("start_date") > status_now)
    return p


def _promoted_sales(r: Tables, links: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Item rows (``columns``) sold inside an interval of ``links`` (on,
    start_date, end_date, ...) with their transaction's total tx_cents.

    Transactions are cut to the span of the intervals before any join.  Where
    item rows carry their date (the canonical layout) they are cut too and
    joined by interval first, so that only rows inside an interval meet a
    transaction; on the plain views the transaction brings the date."""
    items = r["sales_transaction_items"]
    tx = r["sales_transactions"].filter(within("transaction_date", *bounds(links, "start_date", "end_date"))).select(
        F.col("id").alias("transaction_id"), "transaction_date", F.col("total_cents").alias("tx_cents"))
    if "transaction_date" in items.columns:
        sold = interval_join(items.select("transaction_id", "transaction_date", *columns), links, on, "transaction_date")
        return sold.drop("transaction_date").join(tx.drop("transaction_date"), "transaction_id")
    some = items.select("transaction_id", *columns).join(links.select(on).distinct(), on, "left_semi")
    return interval_join(some.join(tx, "transaction_id"), links, on, "transaction_date")


def _effectiveness(r: Tables, promos: DataFrame, avg_of: str) -> DataFrame:
    pp = r["promotion_products"]
    sel = promos.select(F.col("id").alias("promotion_id"), "start_date", "end_date")
    links = sel.join(pp, "promotion_id")
    n_products = links.groupBy("promotion_id").agg(F.countDistinct("product_id").alias("products_in_promotion"))
    # revenue and discount are of item rows sold under the promotion on any
    # date: one row per (product, promotion) before the join, no transaction
    own = (r["sales_transaction_items"].filter(F.col("promotion_id").isNotNull())
           .groupBy("product_id", "promotion_id")
           .agg(F.sum("total_cents").alias("rev"), F.sum("discount_cents").alias("disc"), F.count("total_cents").alias("n"))
           .join(links, ["product_id", "promotion_id"])
           .groupBy("promotion_id").agg(F.sum("rev").alias("rev"), F.sum("disc").alias("disc"), F.sum("n").alias("n")))
    # transactions are counted inside the promotion's own dates
    sold = _promoted_sales(r, links, ["product_id", "promotion_id"], ["product_id", "promotion_id"])
    dated = sold.groupBy("promotion_id").agg(
        F.countDistinct("transaction_id").alias("transactions_count"), cents_avg("tx_cents").alias("tx_avg"))
    stats = own.join(dated, "promotion_id", "left").withColumn(
        "avg_value", F.col("tx_avg") if avg_of == "transaction" else ratio(F.col("rev"), F.col("n")) / 100.0)
    return (promos.withColumnRenamed("id", "promotion_id")
            .join(n_products, "promotion_id", "left").join(stats, "promotion_id", "left")
            .select(F.col("name").alias("promotion_name"), "promotion_type", "discount_percentage",
                    "start_date", "end_date", "is_active",
                    F.coalesce("products_in_promotion", F.lit(0)).alias("products_in_promotion"),
                    F.coalesce(F.col("rev").cast("double") / 100.0, F.lit(0.0)).alias("total_revenue"),
                    F.coalesce(F.col("disc").cast("double") / 100.0, F.lit(0.0)).alias("total_discount_given"),
                    F.coalesce("transactions_count", F.lit(0)).alias("transactions_count"),
                    F.coalesce("avg_value", F.lit(0.0)).alias("avg_transaction_value"))
            .orderBy(F.col("start_date").desc(), F.col("promotion_name")))


def promotion_effectiveness(r: Tables, as_of, days: int = 30, promotion_type=None, status=None,
                            start=None, end=None) -> DataFrame:
    """M8 (the effective definition): active promotions started within the
    window (or lying inside [start, end]), optional type and status
    (active / expired / upcoming against the as_of *date*).  Revenue and
    discount sum item rows sold under the promotion (any date); transaction
    count and average ticket only count transactions dated inside the
    promotion's own [start_date, end_date]."""
    today = F.lit(to_datetime(as_of).date())
    promos = _select_promotions(r["promotions"].filter(F.col("is_active")), as_of, days, promotion_type,
                                status, start, end, "start_date", today)
    return _effectiveness(r, promos, "transaction")


def promotion_effectiveness_created(r: Tables, as_of, days: int = 30, promotion_type=None, status=None,
                                    start=None, end=None) -> DataFrame:
    """M8b (the shadowed first definition): no active filter, window on
    ``created_at``, status against the as_of *timestamp*, average over the
    item totals instead of the transaction totals."""
    now = as_ts(as_of)
    p = r["promotions"]
    promos = _select_promotions(p, as_of, days, promotion_type, None, start, end, "created_at", now)
    if status == "active":
        promos = promos.filter((_ts_of("start_date") <= now) & (_ts_of("end_date") >= now))
    elif status == "expired":
        promos = promos.filter(_ts_of("end_date") < now)
    elif status == "upcoming":
        promos = promos.filter(_ts_of("start_date") > now)
    return _effectiveness(r, promos, "item")


def promotion_kpis(eff: DataFrame) -> DataFrame:
    """M9: one-row roll-up of an M8 frame (revenue re-rounded to cents)."""
    d = F.col("discount_percentage")
    return eff.agg(F.count(F.lit(1)).alias("total_promotions"),
                   F.coalesce(F.sum(F.col("is_active").cast("bigint")), F.lit(0)).alias("active_promotions"),
                   F.coalesce(round_half_up(F.sum("total_revenue"), 2), F.lit(0.0)).alias("total_revenue"),
                   F.coalesce(F.sum("transactions_count"), F.lit(0)).alias("total_transactions"),
                   F.coalesce(ratio(F.sum(F.when(d > 0, d)), F.count(F.when(d > 0, d))), F.lit(0.0))
                   .alias("avg_discount"))


def top_promotions(eff: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` promotions with the highest revenue (ties: later
    start first, then name)."""
    return top_k(eff, [F.col("total_revenue").desc(), F.col("start_date").desc(), F.col("promotion_name")], n)


def value_share(df: DataFrame, col: str) -> DataFrame:
    """``value_counts`` with its percentage (pie charts): col, n, share."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the already-aggregated distinct values only
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(col, "n", (F.col("n").cast("double") * 100.0 / total.cast("double")).alias("share"))


def promotion_type_share(eff: DataFrame) -> DataFrame:
    """Promotions per type and their percentage."""
    return value_share(eff, "promotion_type")


# ---------------------------------------------------------------- A10 / A21 / A22
def active_promotions(r: Tables) -> DataFrame:
    """Id and name of active promotions, newest start first."""
    return (r["promotions"].filter(F.col("is_active"))
            .orderBy(F.col("start_date").desc(), F.col("id")).select("id", "name"))


def promotion_dates(r: Tables, promotion_id: int) -> DataFrame:
    """Start and end date of one promotion."""
    return r["promotions"].filter(F.col("id") == F.lit(promotion_id)).select("start_date", "end_date")


def promotion_comparison(r: Tables, promotion_id: int, start_date=None, end_date=None) -> DataFrame:
    """A10: sales of the promotion's products in the 30 days before its
    start ([start-30d, start-1d]) and during it ([start, end]); always one
    row, with null sums and zero counts when nothing matches or the promotion
    is unknown.

    Given dates are literals; otherwise the promotion's row is a scalar
    subquery.  Either way the range of both periods reaches the scans, and one
    pass computes both with conditional aggregates.
    """
    prods = r["promotion_products"].filter(F.col("promotion_id") == F.lit(promotion_id)).select("product_id")
    day = F.col("transaction_date")
    if start_date is not None and end_date is not None:
        s, e = as_ts(start_date), as_ts(end_date)
    else:
        dates = promotion_dates(r, promotion_id)
        s, e = (dates.agg(F.min(c).cast("timestamp_ntz")).scalar() for c in ("start_date", "end_date"))
    lines = sold_lines(r, (day >= s - F.expr("INTERVAL 30 DAYS")) & (day <= e))
    before = (day >= s - F.expr("INTERVAL 30 DAYS")) & (day <= s - F.expr("INTERVAL 1 DAY"))
    during = (day >= s) & (day <= e)
    lines = lines.filter(before | during).join(prods, "product_id")

    def period(cond, p):
        return [(F.sum(F.when(cond, F.col("total_cents"))).cast("double") / 100.0).alias(f"revenue_{p}"),
                F.sum(F.when(cond, F.col("quantity"))).cast("bigint").alias(f"quantity_{p}"),
                F.countDistinct(F.when(cond, F.col("transaction_id"))).alias(f"transactions_{p}")]

    return lines.agg(*period(before, "before"), *period(during, "during"))


# ---------------------------------------------------------------- A14
def promotional_impact(r: Tables, as_of, days: int = 30, start=None, end=None) -> DataFrame:
    """Per promotion started in the window (or inside [start, end]):
    units and revenue of *all* item rows of its products (the date test sits
    in the transaction join's ON clause, so it does not limit them), the
    discount those would carry (revenue x pct / 100), and -- for the
    transactions dated inside the promotion -- distinct count and average
    ticket; ROI = (revenue - discount) / discount x 100, 2 places, 0 unless
    the discount is positive."""
    promos = r["promotions"]
    if start and end:
        promos = promos.filter((_ts_of("start_date") >= as_ts(start)) & (_ts_of("end_date") <= as_ts(end)))
    else:
        promos = promos.filter(_ts_of("start_date") >= as_ts(to_datetime(as_of) - _dt.timedelta(days=days)))
    sel = promos.select(F.col("id").alias("promo"), "start_date", "end_date", "discount_percentage")
    links = sel.join(r["promotion_products"].withColumnRenamed("promotion_id", "promo"), "promo")
    items = r["sales_transaction_items"]
    # all-time totals per product: one compact row per product before the join
    per_product = items.groupBy("product_id").agg(F.sum("quantity").alias("qty"), F.sum("total_cents").alias("cents"))
    totals = (links.join(per_product, "product_id")
              .groupBy("promo").agg(F.sum("qty").alias("units"), F.sum("cents").alias("rev"),
                                    F.sum(F.col("cents") * F.col("discount_percentage")).alias("disc_x100")))
    dated = _promoted_sales(r, links, ["product_id"], ["product_id"]).groupBy("promo").agg(
        F.countDistinct("transaction_id").alias("n_tx"), cents_avg("tx_cents").alias("aov"))
    rev = F.col("rev").cast("double") / 100.0
    disc = F.col("disc_x100").cast("double") / 10000.0
    roi = F.when(F.col("disc_x100") > 0, round_half_up(
        (F.col("rev") * 100 - F.col("disc_x100")).cast("double") / F.col("disc_x100").cast("double") * 100.0, 2)
    ).otherwise(F.lit(0.0))
    return (promos.withColumnRenamed("id", "promo").join(totals, "promo", "left").join(dated, "promo", "left")
            .select(F.col("name").alias("campaign_name"), "start_date", "end_date", "discount_percentage",
                    F.coalesce(rev, F.lit(0.0)).alias("total_revenue"),
                    F.coalesce(F.col("units"), F.lit(0)).cast("bigint").alias("units_sold"),
                    F.coalesce(F.col("aov"), F.lit(0.0)).alias("avg_order_value"),
                    F.coalesce(F.col("n_tx"), F.lit(0)).alias("transaction_count"),
                    F.coalesce(disc, F.lit(0.0)).alias("total_discount_given"),
                    roi.alias("roi_percentage"))
            .orderBy(F.col("total_revenue").desc(), F.col("campaign_name")))


# ---------------------------------------------------------------- A23 / A24
def promo_vs_non_promo(r: Tables, p_start, p_end, n_start, n_end) -> DataFrame:
    """A23: 'Promotional' and 'Non-Promotional' period rows (transactions
    LEFT JOIN items; sums of transaction totals repeat per item row, D5)
    plus a 'Change (%)' row = (p - n) / n x 100, 0 unless n > 0.  One scan
    covers both periods."""
    if to_datetime(p_start) > to_datetime(p_end) or to_datetime(n_start) > to_datetime(n_end):
        raise ValueError("start date must not be after end date")
    pc = between_ts("transaction_date", p_start, p_end)
    nc = between_ts("transaction_date", n_start, n_end)
    tx = r["sales_transactions"].filter(pc | nc).select(
        F.col("id").alias("transaction_id"), "transaction_date", F.col("total_cents").alias("tx_cents"))
    lines = tx.join(items_in(r, pc | nc).select("transaction_id", "quantity"), "transaction_id", "left")

    def aggs(cond, p):
        t = F.when(cond, F.col("tx_cents"))
        return [F.sum(t).alias(f"{p}_sum"), F.count(t).alias(f"{p}_rows"),
                F.countDistinct(F.when(cond, F.col("transaction_id"))).alias(f"{p}_n"),
                F.sum(F.when(cond, F.col("quantity"))).alias(f"{p}_q")]

    one = lines.agg(*aggs(pc, "p"), *aggs(nc, "n"))

    def vals(p):
        return {"total_sales": F.coalesce(F.col(f"{p}_sum").cast("double") / 100.0, F.lit(0.0)),
                "transaction_count": F.col(f"{p}_n").cast("double"),
                "avg_transaction_value": F.coalesce(ratio(F.col(f"{p}_sum"), F.col(f"{p}_rows")) / 100.0, F.lit(0.0)),
                "items_sold": F.coalesce(F.col(f"{p}_q"), F.lit(0)).cast("double")}

    pv, nv = vals("p"), vals("n")

    def change(a, b):
        return F.when(b > 0, (a - b) / b * 100.0).otherwise(F.lit(0.0))

    def row(label, v):
        return F.struct(F.lit(label).alias("period_type"), *[v[k].alias(k) for k in pv])

    return one.select(F.inline(F.array(
        row("Promotional", pv), row("Non-Promotional", nv),
        row("Change (%)", {k: change(pv[k], nv[k]) for k in pv}))))


def promo_summary_cards(cmp: DataFrame) -> DataFrame:
    """Sales uplift and transaction growth (change row), promotional
    sales and items (promotional row); one row."""
    is_change = F.col("period_type") == "Change (%)"
    is_promo = F.col("period_type") == "Promotional"
    return cmp.agg(F.max(F.when(is_change, F.col("total_sales"))).alias("sales_uplift"),
                   F.max(F.when(is_change, F.col("transaction_count"))).alias("transaction_growth"),
                   F.max(F.when(is_promo, F.col("total_sales"))).alias("promo_sales"),
                   F.max(F.when(is_promo, F.col("items_sold"))).cast("bigint").alias("promo_items"))
