"""Column expressions used across operators.

Conventions
-----------
* Money is carried as BIGINT minor units (cents) so that sums are exact and
  independent of partitioning; it is turned into a DOUBLE currency amount only
  at the end (``dollars`` / ``cents_sum`` / ``cents_avg``).
* Averages are written as ``CAST(SUM AS DOUBLE) / COUNT`` so that the result
  does not depend on the order in which partial sums are merged.
* Time columns are ``timestamp_ntz``; literals are cast to match so that the
  comparison stays a plain column-vs-literal predicate Spark pushes into the
  parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = _dt.timedelta(days=1)


def as_ts(value) -> Column:
    """A timestamp_ntz literal from a datetime/date/ISO string."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    elif isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    return F.lit(value).cast("timestamp_ntz")


def to_datetime(value) -> _dt.datetime:
    if isinstance(value, str):
        return _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        return _dt.datetime(value.year, value.month, value.day)
    return value


def since(col: str | Column, as_of, days: float) -> Column:
    """Trailing window ``as_of - days <= col <= as_of``: rows after ``as_of``
    have not happened yet."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= as_ts(to_datetime(as_of) - _dt.timedelta(days=days))) & (c <= as_ts(as_of))


def between_ts(col: str | Column, start, end) -> Column:
    """Closed range ``start <= col <= end``; a date bound means midnight."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= as_ts(start)) & (c <= as_ts(end))


def day_range(col: str | Column, first_day, last_day) -> Column:
    """``DATE(col) BETWEEN first_day AND last_day`` written as a half-open
    timestamp range so the predicate reaches the scan."""
    c = F.col(col) if isinstance(col, str) else col
    lo = to_datetime(first_day).replace(hour=0, minute=0, second=0, microsecond=0)
    hi = to_datetime(last_day).replace(hour=0, minute=0, second=0, microsecond=0) + DAY
    return (c >= as_ts(lo)) & (c < as_ts(hi))


def to_day(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(c)


def dollars(cents: str | Column) -> Column:
    c = F.col(cents) if isinstance(cents, str) else cents
    return c.cast("double") / F.lit(100.0)


def cents_sum(cents: str | Column) -> Column:
    """SUM of a cents column as a DOUBLE currency amount (exact sum first)."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return F.sum(c).cast("double") / F.lit(100.0)


def cents_avg(cents: str | Column) -> Column:
    """AVG of a cents column in currency units, NULL when no rows."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)) / F.lit(100.0)


def exact_avg(col: str | Column) -> Column:
    """AVG of an integer column as DOUBLE, NULL when no non-null rows."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE; NULL when the divisor is 0 or NULL."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def round_half_up(x: Column, digits: int) -> Column:
    """Round half away from zero, identically in every engine
    (``sign(x) * floor(|x| * 10^d + 0.5) / 10^d``)."""
    scale = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def week_closing_monday(day: Column) -> Column:
    """Monday that closes a pandas ``W-MON`` bin (Tue..Mon) holding ``day``."""
    return F.next_day(F.date_sub(day, 1), "Mon")


def bucket_start(ts: Column, unit: str) -> Column:
    """SQL-style period start (weeks start on Monday) as timestamp_ntz."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def period_label_sql_style(period_date: Column, period_type: str) -> Column:
    """Labels of the gap-filled trend reports: 'Mon DD', 'Week of Mon DD',
    'Mon YYYY', 'Qn YYYY'."""
    if period_type == "daily":
        return F.date_format(period_date, "MMM dd")
    if period_type == "weekly":
        return F.concat(F.lit("Week of "), F.date_format(period_date, "MMM dd"))
    if period_type == "monthly":
        return F.date_format(period_date, "MMM yyyy")
    if period_type == "quarterly":
        return F.concat(F.lit("Q"), F.quarter(period_date).cast("string"), F.lit(" "),
                        F.year(period_date).cast("string"))
    raise ValueError(f"unknown period type {period_type!r}")


def truncate_text(col: str | Column, n: int) -> Column:
    """Display truncation: longer than n characters -> first n + '...'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
