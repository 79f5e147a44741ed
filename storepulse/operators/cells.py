"""Stored hourly cells and the views that roll them up (M1, M2, M4, A8, A11,
M16).

One row per hour holds what adds up over any longer bucket: transactions and
their amount, transactions with items, items and their amount.  A transaction
has one time, so its counts add up too.  The cells are partitioned by month;
``refresh`` rewrites the months of the days that changed and nothing else.

``HourCells.window`` answers any closed range exactly.  An hour's cell keeps
the first and last time in it: if both lie in the range the whole cell counts.
At most two hours can be cut by a range; only if one is, its rows are taken
from the facts, by a pushed-down filter of that hour.  So a day, week, month or
range form reads the cells and, as a rule, no fact at all.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce as _reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.columns import as_ts, between_ts, cents_sum, ratio, round_half_up, to_datetime
from storepulse.operators.common import Tables, items_in, transactions
from storepulse.operators.traffic import _bucket, filled, traffic_bounds

HOUR = _dt.timedelta(hours=1)
SUMS = ("n_tx", "tx_cents", "n_sold", "items", "item_cents")


def hour_cells(r: Tables, window: Column | None = None) -> DataFrame:
    """The cells of the facts in a window: hour, first_at, last_at, the SUMS
    and the month."""
    tx = transactions(r, window).select(F.col("id").alias("transaction_id"), "transaction_date", F.col("total_cents").alias("tx_cents"))
    per_tx = items_in(r, window).groupBy("transaction_id").agg(
        F.sum("quantity").alias("items"), F.sum("total_cents").alias("item_cents"), F.lit(1).alias("sold"))
    hour = F.date_trunc("hour", "transaction_date").cast("timestamp_ntz")
    cells = tx.join(per_tx, "transaction_id", "left").groupBy(hour.alias("hour")).agg(
        F.min("transaction_date").alias("first_at"), F.max("transaction_date").alias("last_at"),
        F.count(F.lit(1)).alias("n_tx"), F.sum("tx_cents").alias("tx_cents"), F.count("sold").alias("n_sold"),
        F.sum("items").alias("items"), F.sum("item_cents").alias("item_cents"))
    return cells.withColumn("month", F.date_format("hour", "yyyy-MM"))


def store(r: Tables, path: str, window: Column | None = None) -> None:
    """Write the cells of the months that the window's facts lie in; months
    without such facts keep their partition.  The window must cover whole
    months."""
    (hour_cells(r, window).repartition("month").sortWithinPartitions("month", "hour").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def refresh(r: Tables, path: str, first_day, last_day) -> None:
    """Rewrite the cells of the months of the changed days; the rest of the
    facts is not read."""
    first = to_datetime(first_day).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    last = to_datetime(last_day).replace(day=28) + _dt.timedelta(days=4)
    end = last.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    day = F.col("transaction_date")
    store(r, path, (day >= as_ts(first)) & (day < as_ts(end)))


class HourCells:
    """Stored cells beside the facts that they were made of."""

    def __init__(self, r: Tables, stored: DataFrame):
        self.r, self.cells = r, stored

    def window(self, start, end) -> DataFrame:
        """The cells of start <= time <= end, exactly."""
        low, high = as_ts(start), as_ts(end)
        inside = (F.col("first_at") >= low) & (F.col("last_at") <= high)
        near = self.cells.filter(F.col("hour").between(as_ts(to_datetime(start) - HOUR), as_ts(end)))
        cut = near.filter(~inside & (F.col("last_at") >= low) & (F.col("first_at") <= high)).select("hour")
        hours = [x["hour"] for x in cut.collect()]  # two at most: the hours of start and end
        whole = near.filter(inside).select("hour", *SUMS)
        if not hours:
            return whole
        rows = between_ts("transaction_date", start, end) & _reduce(
            Column.__or__, [(F.col("transaction_date") >= as_ts(h)) & (F.col("transaction_date") < as_ts(h + HOUR)) for h in hours])
        return whole.unionByName(hour_cells(self.r, rows).select("hour", *SUMS))

    def since(self, as_of, days: float) -> DataFrame:
        return self.window(to_datetime(as_of) - _dt.timedelta(days=days), to_datetime(as_of))


def _average(cents: str, n: str) -> Column:
    return F.sum(cents).cast("double") / F.nullif(F.sum(n), F.lit(0)) / F.lit(100.0)


def sales_trend(cells: DataFrame) -> DataFrame:
    """M1 / M2 from the cells of a window."""
    return (cells.groupBy(F.to_date("hour").alias("date"))
            .agg(F.sum("n_tx").alias("transaction_count"), cents_sum("tx_cents").alias("daily_revenue"),
                 _average("tx_cents", "n_tx").alias("avg_transaction_value"))
            .orderBy("date"))


def peak_shopping_hours(cells: DataFrame) -> DataFrame:
    """M4."""
    return (cells.groupBy(F.hour("hour").cast("bigint").alias("hour"))
            .agg(F.sum("n_tx").alias("transaction_count")).orderBy("hour"))


def monthly_sales(cells: DataFrame) -> DataFrame:
    """A11."""
    return (cells.groupBy(F.year("hour").cast("bigint").alias("year"), F.month("hour").cast("bigint").alias("month"))
            .agg(cents_sum("tx_cents").alias("monthly_revenue"), F.sum("n_tx").alias("monthly_transactions"),
                 _average("tx_cents", "n_tx").alias("avg_transaction_value"))
            .select("month", "year", "monthly_revenue", "monthly_transactions", "avg_transaction_value")
            .orderBy("year", "month"))


def avg_items_per_transaction(cells: DataFrame) -> DataFrame:
    """Days on which something was sold."""
    return (cells.filter("n_sold > 0").groupBy(F.to_date("hour").alias("date"))
            .agg(F.sum("n_sold").alias("total_transactions"), F.sum("items").alias("total_items"))
            .withColumn("avg_items", round_half_up(ratio(F.col("total_items"), F.col("total_transactions")), 2))
            .orderBy("date"))


def customer_traffic(stored: HourCells, as_of, period_type: str = "day", start=None, end=None) -> DataFrame:
    """An hour lies in one bucket of every period type."""
    cells = stored.window(*traffic_bounds(as_of, period_type, start, end))
    bucket, step = _bucket(period_type, "hour")
    agg = cells.groupBy(bucket.alias("transaction_date")).agg(
        F.sum("n_tx").alias("n"), F.sum("items").alias("q"), F.sum("item_cents").alias("c"))
    return filled(agg, period_type, step)
