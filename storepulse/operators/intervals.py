"""Interval join (J3): rows with a time to intervals that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_DAYS = 16  # width of a bin
MOST_BINS = 64  # an interval over more bins is joined without them


def _bin(at: Column, days: int) -> Column:
    return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) / days).cast("long")


def bounds(intervals: DataFrame, start: str, end: str) -> tuple[Column, Column]:
    """Earliest start and latest end as scalar subqueries (null where an
    interval is open on that side): used in a filter they are computed once
    and reach the files as pushed-down values."""
    low = F.when(F.count_if(F.col(start).isNull()) == 0, F.min(start).cast("timestamp_ntz"))
    high = F.when(F.count_if(F.col(end).isNull()) == 0, F.max(end).cast("timestamp_ntz"))
    return intervals.agg(low.alias("low")).scalar(), intervals.agg(high.alias("high")).scalar()


def within(at: str, low: Column, high: Column) -> Column:
    """at between the bounds; a null bound is open."""
    first, last = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    return (F.col(at) >= F.coalesce(low, first)) & (F.col(at) <= F.coalesce(high, last))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str,
                  start: str = "start_date", end: str = "end_date", days: int = BIN_DAYS) -> DataFrame:
    """Inner join on equal ``on`` columns and start <= at <= end (both ends
    included; a null start or end is open; a null time matches nothing).

    An interval is dealt to the bins of ``days`` days that it touches, a point
    to its own bin, so the join is an equality on (on, bin) and the exact test
    runs on what shares a bin: a key with many intervals over the years is
    not multiplied with all its points.  Overlapping intervals each match.
    Open intervals and those of more than MOST_BINS bins have no bins; they
    are joined on ``on`` alone (Spark drops that branch where there are none).
    Points are cut to the span of all intervals before either join.
    """
    points = points.filter(within(at, *bounds(intervals, start, end)))
    first, last = _bin(F.col(start), days), _bin(F.col(end), days)
    short = F.col(start).isNotNull() & F.col(end).isNotNull() & (last - first < MOST_BINS)
    binned = intervals.filter(short & (last >= first)).withColumn("bin_", F.explode(F.sequence(first, last)))
    wide = intervals.filter(~short)
    exact = ((F.col(start).isNull() | (F.col(at) >= F.col(start).cast("timestamp_ntz")))
             & (F.col(end).isNull() | (F.col(at) <= F.col(end).cast("timestamp_ntz"))))
    near = points.withColumn("bin_", _bin(F.col(at), days)).join(binned, [*on, "bin_"]).drop("bin_")
    far = points.join(wide, on)
    return near.unionByName(far).filter(exact)
