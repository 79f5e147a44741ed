"""Forecast operators (P1-P9) over many daily series at once.

Input: a daily series frame ``(series_key, date, value)`` where ``value`` is
an integer amount (cents for revenue) so running sums are exact.  Every
window is partitioned by ``series_key``; one series is one calendar of days,
so its size is bounded by the date range, not by the data volume, and
thousands of series (one per category or product) run in parallel.

Semantics follow the reference's second (effective) pass:

* moving average: window w = min(7, n // 2), trailing mean, min_periods = 1;
* linear trend: least-squares line over x = 0..n-1 (closed form from exact
  integer sums);
* exponential: EWM with alpha 0.3, ``adjust=False`` (e0 = y0,
  e_t = 0.7 e_{t-1} + 0.3 y_t), by a scan of blocks;
* projections: h future days after the last date, no random noise (D7),
  floored at 0;
* series with fewer than 7 days are skipped, as in the reference.

Outputs are divided by ``scale`` (100 for cents) and rounded to 4 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.columns import between_ts, round_half_up, since
from storepulse.operators.common import Tables, product_dim, reuse, sold_lines, transactions

MIN_POINTS = 7
ALPHA = 0.3
BLOCK = 64  # points of a block of the exponential mean: 0.7 ** -64 stays far below a double's range
GROUP = 16  # blocks whose sums are composed at once
GROWTH_POINTS = 10
GROWTH_CAP = 0.1


# ---------------------------------------------------------------- series builders
def daily_series(r: Tables, as_of=None, days: int = 30, by: str = "all", start=None, end=None) -> DataFrame:
    """Daily revenue series in cents.  ``by='all'`` is the reference's M12
    series (transaction totals per day, key 'all'); ``by='category'`` or
    ``by='product'`` sums item revenue per key and day."""
    w = between_ts("transaction_date", start, end) if start and end else since("transaction_date", as_of, days)
    if by == "all":
        return (transactions(r, w).groupBy(F.to_date("transaction_date").alias("date"))
                .agg(F.sum("total_cents").alias("value"))
                .select(F.lit("all").alias("series_key"), "date", "value"))
    lines = sold_lines(r, w)
    if by == "product":
        key = F.col("product_id").cast("string")
        per = lines.groupBy(key.alias("series_key"), F.to_date("transaction_date").alias("date"))
        return per.agg(F.sum("total_cents").alias("value"))
    per_product = (lines.groupBy("product_id", F.to_date("transaction_date").alias("date"))
                   .agg(F.sum("total_cents").alias("value")))
    return (per_product.join(product_dim(r).select("product_id", "category"), "product_id")
            .groupBy(F.col("category").alias("series_key"), "date").agg(F.sum("value").alias("value")))


def _indexed(series: DataFrame) -> DataFrame:
    """Adds x = 0..n-1 in date order and n; drops series shorter than 7."""
    by_key = Window.partitionBy("series_key")
    return (series.withColumn("x", (F.row_number().over(by_key.orderBy("date")) - 1).cast("bigint"))
            .withColumn("n", F.count(F.lit(1)).over(by_key))
            .filter(F.col("n") >= MIN_POINTS))


OUT_DIGITS = 4  # sub-cent for currency series


def _out(x: Column, scale: float) -> Column:
    return round_half_up(x / F.lit(float(scale)), OUT_DIGITS)


def _window_size(n: Column) -> Column:
    return F.least(F.lit(7), F.floor(n / 2)).cast("int")


# ---------------------------------------------------------------- P1 / P2 / P3 (fitted)
def _moving_average_cents(idx: DataFrame) -> DataFrame:
    trail = Window.partitionBy("series_key").orderBy("date").rowsBetween(-6, 0)
    w = _window_size(F.col("n"))
    recent = F.collect_list("value").over(trail)
    last_w = F.slice(recent, F.greatest(F.size(recent) - w + 1, F.lit(1)), w)
    total = F.aggregate(last_w, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return idx.withColumn("fit", total.cast("double") / F.size(last_w).cast("double"))


def forecast_moving_average(series: DataFrame, scale: float = 100.0) -> DataFrame:
    """Trailing mean over min(7, n // 2) days (min_periods = 1)."""
    fitted = _moving_average_cents(_indexed(series))
    return fitted.select("series_key", "date", _out(F.col("value").cast("double"), scale).alias("actual"),
                         _out(F.col("fit"), scale).alias("forecast"))


def _line_coefficients(idx: DataFrame) -> DataFrame:
    """slope / intercept per series from exact integer sums."""
    d = "decimal(38,0)"
    agg = idx.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum("value").alias("sy"), F.sum(F.col("x").cast(d) * F.col("value").cast(d)).alias("sxy"),
        F.max("date").alias("last_date"))
    n, sx, sxx, sy, sxy = (F.col(c).cast(d) for c in ("n", "sx", "sxx", "sy", "sxy"))
    slope = (n * sxy - sx * sy).cast("double") / (n * sxx - sx * sx).cast("double")
    return (agg.withColumn("slope", slope)
            .withColumn("intercept", (F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double"))
                        / F.col("n").cast("double")))


def _with_line(idx: DataFrame) -> DataFrame:
    """slope / intercept on every row via window sums over the series -- the
    rows are already clustered by series, so no join back and no re-scan."""
    d = "decimal(38,0)"
    w = Window.partitionBy("series_key")
    n = F.count(F.lit(1)).over(w).cast(d)
    sx, sxx = F.sum("x").over(w).cast(d), F.sum(F.col("x") * F.col("x")).over(w).cast(d)
    sy = F.sum("value").over(w).cast(d)
    sxy = F.sum(F.col("x").cast(d) * F.col("value").cast(d)).over(w).cast(d)
    out = (idx.withColumn("_n", n).withColumn("_sx", sx).withColumn("_sxx", sxx)
           .withColumn("_sy", sy).withColumn("_sxy", sxy))
    slope = ((F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")).cast("double")
             / (F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")).cast("double"))
    out = out.withColumn("slope", slope)
    out = out.withColumn("intercept", (F.col("_sy").cast("double") - F.col("slope") * F.col("_sx").cast("double"))
                         / F.col("_n").cast("double"))
    return out.drop("_n", "_sx", "_sxx", "_sy", "_sxy")


def forecast_linear_trend(series: DataFrame, scale: float = 100.0) -> DataFrame:
    """Fitted values of the least-squares line."""
    return (_with_line(_indexed(series))
            .select("series_key", "date", _out(F.col("value").cast("double"), scale).alias("actual"),
                    _out(F.col("intercept") + F.col("slope") * F.col("x").cast("double"), scale).alias("forecast")))


def _ewm_cents(idx: DataFrame) -> DataFrame:
    """The recurrence e = (1 - ALPHA) e' + ALPHA y over each series, as a scan
    of blocks.

    BLOCK points map the value before them to the one at their end by
    e -> decay^BLOCK e + b, where b is the block's own sum from a start of 0.
    A running sum composes the maps of the blocks of a group (GROUP blocks);
    over a whole group the factor is 1e-159, so a group starts from the sum of
    the group before it alone, what came earlier is far below a double's
    precision.  With its start known every block is filled in by the
    recurrence itself, so the first block has the loop's very values.  Rows
    are clustered by series once, n points cost n steps, and no array is
    longer than a block."""
    decay = 1.0 - ALPHA
    step = decay ** BLOCK
    power = lambda k: F.pow(F.lit(step), k.cast("double"))
    before = lambda *by: Window.partitionBy("series_key", *by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def then(e, p):
        y = p["value"].cast("double")
        return F.when(e.isNull(), y).otherwise(F.lit(decay) * e + F.lit(ALPHA) * y)

    blocks = idx.groupBy("series_key", F.floor(F.col("x") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("x", "date", "value"))).alias("pts"))  # BLOCK points at most
    blocks = blocks.select("series_key", "block", "pts", (F.col("block") % GROUP).alias("j"), F.floor(F.col("block") / GROUP).alias("part"),
                           F.aggregate("pts", F.lit(0.0), then).alias("b"))
    inner = F.when(F.col("j") > 0, power(F.col("j") - 1) * F.sum(F.col("b") / power(F.col("j"))).over(before("part"))).otherwise(F.lit(0.0))
    blocks = blocks.withColumn("inner", inner)
    whole = F.when(F.col("j") == GROUP - 1, F.lit(step) * F.col("inner") + F.col("b"))
    first = F.first(F.col("pts")[0]["value"].cast("double")).over(Window.partitionBy("series_key").orderBy("block"))
    start = F.coalesce(F.last(whole, ignorenulls=True).over(before()), first)
    blocks = blocks.withColumn("start", F.when(F.col("block") > 0, power(F.col("j")) * start + F.col("inner")))

    def fill(acc, p):
        e = then(acc["e"], p)
        return F.struct(e.alias("e"), F.concat(acc["out"], F.array(e)).alias("out"))

    init = F.struct(F.col("start").alias("e"), F.array().cast("array<double>").alias("out"))
    filled = blocks.select("series_key", F.inline(F.arrays_zip("pts", F.aggregate("pts", init, fill)["out"].alias("fit"))))
    return filled.select("series_key", "pts.x", "pts.date", "pts.value", "fit")


def forecast_exponential(series: DataFrame, scale: float = 100.0) -> DataFrame:
    """EWM (alpha 0.3, adjust=False) fitted values."""
    fitted = _ewm_cents(_indexed(series))
    return fitted.select("series_key", "date", _out(F.col("value").cast("double"), scale).alias("actual"),
                         _out(F.col("fit"), scale).alias("forecast"))


# ---------------------------------------------------------------- P4 / P5 / P6 (projections)
def _future(base: DataFrame, horizon: int, value_of_step) -> DataFrame:
    steps = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select("series_key", F.date_add("last_date", F.col("step")).alias("date"),
                        F.col("step").cast("bigint").alias("step"), value_of_step.alias("raw"))


def project_moving_average(series: DataFrame, horizon: int = 7, scale: float = 100.0) -> DataFrame:
    """Last moving average + mean day-to-day change of the last w
    actual values x step, for ``horizon`` days."""
    fitted = _moving_average_cents(_indexed(series))
    w = _window_size(F.col("n"))
    tail = fitted.filter(F.col("x") >= F.col("n") - w)
    base = tail.groupBy("series_key").agg(
        F.max_by("fit", "x").alias("base"), F.max_by("value", "x").alias("y_last"),
        F.min_by("value", "x").alias("y_first"), F.count(F.lit(1)).alias("w"), F.max("date").alias("last_date"))
    trend = F.when(F.col("w") > 1, (F.col("y_last") - F.col("y_first")).cast("double")
                   / (F.col("w") - 1).cast("double")).otherwise(F.lit(0.0))
    out = _future(base.withColumn("trend", trend), horizon,
                  F.col("base") + F.col("trend") * F.col("step").cast("double"))
    return out.select("series_key", "date", "step", _out(F.greatest(F.col("raw"), F.lit(0.0)), scale).alias("forecast"))


def project_linear_trend(series: DataFrame, horizon: int = 7, scale: float = 100.0) -> DataFrame:
    """P5: the least-squares line extended to x = n .. n + h - 1."""
    coef = _line_coefficients(_indexed(series))
    x = (F.col("n") - 1 + F.col("step")).cast("double")
    out = _future(coef, horizon, F.col("intercept") + F.col("slope") * x)
    return out.select("series_key", "date", "step", _out(F.greatest(F.col("raw"), F.lit(0.0)), scale).alias("forecast"))


def project_exponential(series: DataFrame, horizon: int = 7, scale: float = 100.0) -> DataFrame:
    """Last EWM value compounded by the recent growth g each day.
    g = (last - first) / sum(all but last) of the last 10 actual values
    (= mean of differences / mean of all but the last), clamped to +-0.1;
    0 when that sum is 0."""
    fitted = _ewm_cents(_indexed(series)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("series_key")))
    tail = fitted.filter(F.col("x") >= F.col("n") - GROWTH_POINTS)
    base = tail.groupBy("series_key").agg(
        F.max_by("fit", "x").alias("last_fit"), F.max_by("value", "x").alias("y_last"),
        F.min_by("value", "x").alias("y_first"), F.sum("value").alias("s_all"),
        F.max("date").alias("last_date"))
    denom = (F.col("s_all") - F.col("y_last")).cast("double")
    g = F.when(denom != 0, (F.col("y_last") - F.col("y_first")).cast("double") / denom).otherwise(F.lit(0.0))
    g = F.greatest(F.lit(-GROWTH_CAP), F.least(F.lit(GROWTH_CAP), g))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array().cast("array<double>"),
                       lambda acc, i: F.concat(acc, F.array(
                           F.coalesce(F.try_element_at(acc, F.lit(-1)), F.col("last_fit")) * (F.lit(1.0) + F.col("g")))))
    with_path = base.withColumn("g", g).withColumn("path", path)
    steps = with_path.select("series_key", "last_date", F.posexplode("path").alias("pos", "raw"))
    return steps.select("series_key", F.date_add("last_date", F.col("pos") + 1).alias("date"),
                        (F.col("pos") + 1).cast("bigint").alias("step"),
                        _out(F.greatest(F.col("raw"), F.lit(0.0)), scale).alias("forecast"))


# ---------------------------------------------------------------- P8 / P9
FITTERS = {"moving_average": forecast_moving_average, "linear_trend": forecast_linear_trend,
           "exponential": forecast_exponential}
PROJECTORS = {"moving_average": project_moving_average, "linear_trend": project_linear_trend,
              "exponential": project_exponential}


def forecast_quality(series: DataFrame, method: str = "moving_average", horizon: int = 7,
                     scale: float = 100.0) -> DataFrame:
    """Per series -- historical mean, mean of the last 7 fitted values
    and its direction, MAE, accuracy = max(0, 100 - MAE / mean x 100) (0 when
    the mean is not positive), mean of the projection and its direction.
    Rounded to 4 places."""
    series = reuse(series)  # read by the fit and the projection
    fitted = FITTERS.get(method, forecast_moving_average)(series, scale)
    future = PROJECTORS.get(method, project_moving_average)(series, horizon, scale)
    rk = F.row_number().over(Window.partitionBy("series_key").orderBy(F.col("date").desc()))
    hist = (fitted.withColumn("rk", rk).groupBy("series_key")
            .agg(F.avg("actual").alias("avg_actual"),
                 F.avg(F.when(F.col("rk") <= 7, F.col("forecast"))).alias("recent_fc"),
                 F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae")))
    fut = future.groupBy("series_key").agg(F.avg("forecast").alias("future_avg"))
    acc = F.when(F.col("avg_actual") > 0, F.greatest(F.lit(0.0), F.lit(100.0) - F.col("mae") / F.col("avg_actual")
                                                       * 100.0)).otherwise(F.lit(0.0))
    r4 = lambda c: round_half_up(c, 4)
    return (hist.join(fut, "series_key", "left")
            .select("series_key", r4(F.col("avg_actual")).alias("historical_avg"),
                    r4(F.col("recent_fc")).alias("recent_forecast_avg"),
                    F.when(F.col("recent_fc") > F.col("avg_actual"), "Increasing").otherwise("Decreasing")
                    .alias("recent_trend"),
                    r4(F.col("mae")).alias("mae"), r4(acc).alias("accuracy"),
                    r4(F.coalesce(F.col("future_avg"), F.lit(0.0))).alias("future_avg"),
                    F.when(F.coalesce(F.col("future_avg"), F.lit(0.0)) > F.col("recent_fc"), "Increasing")
                    .otherwise("Decreasing").alias("future_trend")))


def avg_items_trendline(avg_items: DataFrame) -> DataFrame:
    """Least-squares line through an A8 frame's avg_items (2-place
    values, carried as integer hundredths so the sums are exact)."""
    series = avg_items.select(F.lit("avg_items").alias("series_key"), "date",
                              F.floor(F.col("avg_items") * 100.0 + 0.5).cast("bigint").alias("value"))
    idx = series.withColumn("x", (F.row_number().over(Window.partitionBy("series_key").orderBy("date")) - 1)
                            .cast("bigint"))
    return (_with_line(idx)
            .select("date", (F.col("value").cast("double") / 100.0).alias("avg_items"),
                    _out(F.col("intercept") + F.col("slope") * F.col("x").cast("double"), 100.0).alias("trend")))
