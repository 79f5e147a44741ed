"""Column-level helpers shared by the operators (all built-in expressions)."""

from storepulse.functions.columns import (  # noqa: F401
    DAY,
    as_ts,
    bucket_start,
    cents_avg,
    cents_sum,
    dollars,
    period_label_sql_style,
    ratio,
    round_half_up,
    since,
    between_ts,
    day_range,
    to_day,
    truncate_text,
    week_closing_monday,
)
