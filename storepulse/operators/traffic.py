"""Customer traffic (M16-M19): bucketed transaction counts with gap filling.

The reference pulls raw rows into pandas and bins them with a Grouper; here
the binning is a ``groupBy`` on a bucket expression, and the gap filling is a
spine generated from the (one-row) min/max of the aggregated buckets, so the
only data-sized work is one partial aggregation.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.columns import between_ts, round_half_up, to_datetime, week_closing_monday
from storepulse.operators.common import Tables, items_in, line_parts, reuse, transactions

DEFAULT_SPANS = {"hour": _dt.timedelta(days=1), "day": _dt.timedelta(days=7), "week": _dt.timedelta(weeks=4)}
OTHER_SPAN = _dt.timedelta(weeks=8)


def traffic_bounds(as_of, period_type: str, start=None, end=None):
    """Reference defaults: the last day / 7 days / 4 weeks / 8 weeks."""
    if start is None or end is None:
        end = to_datetime(as_of)
        start = end - DEFAULT_SPANS.get(period_type, OTHER_SPAN)
    return to_datetime(start), to_datetime(end)


def default_period_type(days: int, purpose: str = "save") -> str:
    """Bucket choice from a span in days -- <=2 hour, <=90 day, else
    week (save/export); <=60 day else week when loading a saved layer."""
    if purpose == "load":
        return "day" if days <= 60 else "week"
    if days <= 2:
        return "hour"
    return "day" if days <= 90 else "week"


def _bucket(period_type: str, column: str = "transaction_date"):
    ts = F.col(column)
    if period_type == "hour":
        return F.date_trunc("hour", ts).cast("timestamp_ntz"), "INTERVAL 1 HOUR"
    if period_type in ("week", "month"):  # pandas W-MON: Tue..Mon, labelled by the Monday
        return week_closing_monday(F.to_date(ts)).cast("timestamp_ntz"), "INTERVAL 7 DAYS"
    return F.date_trunc("day", ts).cast("timestamp_ntz"), "INTERVAL 1 DAY"


def customer_traffic(r: Tables, as_of, period_type: str = "day", start=None, end=None) -> DataFrame:
    """Per bucket between the first and last busy bucket of [start,
    end]: distinct transactions, items, revenue (transactions LEFT JOIN
    items), average ticket (0 for empty buckets), position and label.

    hour -> hourly buckets, time_period = hour of day, label 'hh AM';
    day (and unknown types) -> days, label 'Tue, Sep 17';
    week / month -> Tue..Mon weeks named by the closing Monday, label
    'Week of Sep 23'.  time_period counts buckets from 0 otherwise.
    """
    start, end = traffic_bounds(as_of, period_type, start, end)
    bucket, step = _bucket(period_type)
    window = between_ts("transaction_date", start, end)
    parts = line_parts(r, window)  # distinct transactions are counted inside the partitions of the join
    tx = transactions(r, window).select(F.col("id").alias("transaction_id"), "transaction_date").repartition(parts, "transaction_id")
    items = items_in(r, window).select("transaction_id", "quantity", "total_cents").repartition(parts, "transaction_id")
    # one row per busy bucket; read twice (bounds of the spine, then the
    # gap-filling join), so it is materialised once
    agg = reuse(tx.join(items, "transaction_id", "left")
                .groupBy(bucket.alias("transaction_date"))
                .agg(F.countDistinct("transaction_id").alias("n"),
                     F.sum("quantity").alias("q"),
                     F.sum("total_cents").alias("c")))
    return filled(agg, period_type, step)


def filled(agg: DataFrame, period_type: str, step: str) -> DataFrame:
    """M16's rows from the busy buckets (transaction_date, n, q, c): empty
    buckets between the first and the last, position and label."""
    spine = (agg.agg(F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"))
             .filter(F.col("lo").isNotNull())
             .select("lo", F.explode(F.sequence("lo", "hi", F.expr(step))).alias("transaction_date")))
    revenue = F.coalesce(F.col("c").cast("double") / 100.0, F.lit(0.0))
    n = F.coalesce(F.col("n"), F.lit(0))
    if period_type == "hour":
        pos = F.hour("transaction_date").cast("bigint")
        label = F.date_format("transaction_date", "hh a")
    elif period_type in ("week", "month"):
        pos = (F.datediff(F.to_date("transaction_date"), F.to_date("lo")) / 7).cast("bigint")
        label = F.concat(F.lit("Week of "), F.date_format("transaction_date", "MMM dd"))
    else:
        pos = F.datediff(F.to_date("transaction_date"), F.to_date("lo")).cast("bigint")
        label = F.date_format("transaction_date", "EEE, MMM dd")
    return (spine.join(agg, "transaction_date", "left")
            .select("transaction_date",
                    n.alias("transaction_count"),
                    F.coalesce(F.col("q"), F.lit(0)).cast("bigint").alias("items_sold"),
                    revenue.alias("total_revenue"),
                    F.coalesce(revenue / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0))
                    .alias("avg_transaction_value"),
                    pos.alias("time_period"),
                    label.alias("period_label"))
            .orderBy("transaction_date"))


def traffic_summary(traffic: DataFrame) -> DataFrame:
    """Totals of an M16 frame and the mean of the bucket averages.

    Revenue is re-rounded to cents and the mean to 6 places, so the result
    does not depend on the order partial sums of doubles are merged in."""
    return traffic.agg(F.sum("transaction_count").alias("total_transactions"),
                       F.sum("items_sold").alias("total_items"),
                       round_half_up(F.sum("total_revenue"), 2).alias("total_revenue"),
                       round_half_up(F.avg("avg_transaction_value"), 6).alias("avg_transaction"))


def traffic_layer_compare(layers: list[tuple]) -> DataFrame:
    """Overlay of saved traffic layers as one long frame aligned on
    ``time_period``.  A layer is (label, frame) or (label, frame,
    period_type); layers of different period types cannot be overlaid."""
    if len({layer[2] for layer in layers if len(layer) > 2}) > 1:
        raise ValueError("traffic layers of different period types cannot be compared")
    tagged = [layer[1].select(F.lit(layer[0]).alias("layer"), *layer[1].columns) for layer in layers]
    return reduce(DataFrame.unionByName, tagged)
