"""Forecasts of all series in one job, with dates, averages, trend, band and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.calendar import future_dates
from shelfwise.functions.columns import array_mean, as_double, half_up, name
from shelfwise.functions.text import insight, stock_action, trend_label
from shelfwise.operators.features import LAGS, ROLLS, with_features
from shelfwise.operators.models import weekday_factor
from shelfwise.operators.ordering import AUTO, Layout, last_rows, over_series
from shelfwise.operators.roles import Roles
from shelfwise.operators.windows import HORIZON, LOOKBACK, latest_window, sliding_windows

# Band width, chart tail, product factors and the divisor floor.
BAND = (0.88, 1.12)
CHART_TAIL = 21
PRODUCT_FACTORS = (("Milk", 1.3), ("Coffee", 0.9), ("Bread", 0.4), ("Snacks", 1.1))
AVERAGE_FLOOR = 1e-6


def _keys(roles: Roles) -> list[Column]:
    return [name(roles.series)] if roles.series else []


def recent_average(df: DataFrame, roles: Roles, rows: int = LOOKBACK) -> DataFrame:
    """Mean target of the newest rows and the last date, per series."""
    newest = last_rows(df, roles, rows)
    return newest.groupBy(*_keys(roles)).agg(
        F.avg(roles.target).alias("recent_average"),
        F.max(name(roles.date).cast("date")).alias("last_date"),
    )


def future_steps(
    last_dates: DataFrame, keep: Sequence[str], steps: int = HORIZON, step_days: int = 1
) -> DataFrame:
    """One row per coming date: ``step`` from 1, ``date`` after ``last_date``."""
    dates = future_dates(F.col("last_date"), steps, step_days)
    return last_dates.select(*keep, F.posexplode(dates).alias("_at", "date")).select(
        *keep, (F.col("_at") + 1).cast("int").alias("step"), "date"
    )


def weekday_forecast(df: DataFrame, roles: Roles, lookback: int = LOOKBACK,
                     horizon: int = HORIZON, step_days: int = 1) -> DataFrame:
    """Baseline forecast rows: recent average times a weekday factor, never negative."""
    keys = [roles.series] if roles.series else []
    recent = recent_average(df, roles, lookback)
    rows = future_steps(recent, [*keys, "recent_average"], horizon, step_days)
    value = F.greatest(F.col("recent_average") * weekday_factor(F.col("date")), F.lit(0.0))
    return rows.withColumn("forecast", value)


def forecast_inputs(
    prepared: DataFrame,
    roles: Roles,
    features: Sequence[str],
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    anchor: str = "next",
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    step_days: int = 1,
    sequence: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """The one window per series a model is asked about.

    ``next``: the window ends at the last row with a target. The coming row gets its own
    calendar, lags and means; other features are carried forward from that last row.
    ``last_complete``: the last window whose horizon is still known.

    ``recent_average`` is the mean of the last ``lookback`` known targets and ``last_date``
    the date of the last one. Series with too little history give no row.
    """
    if anchor == "last_complete":
        layout = layout.settled(prepared, roles)
        frame = with_features(prepared, roles, lags, rolls, layout).na.drop("any")
        last = latest_window(
            sliding_windows(frame, roles, lookback, horizon, features, sequence, layout)
        )
        newest = F.slice(F.concat("past", "future"), -lookback, lookback)
        return last.withColumns({
            "recent_average": array_mean(newest), "last_date": F.col("end_date")
        })
    if anchor != "next":
        raise ValueError("anchor is 'next' or 'last_complete'")

    date, target = roles.date, roles.target
    temporal = prepared.schema[date].dataType
    step = F.expr(f"INTERVAL '{step_days}' DAY")
    ahead = F.date_add(name(date), step_days) if isinstance(temporal, T.DateType) else name(date) + step
    known = prepared.where(name(target).isNotNull())
    reach = max([*lags, *rolls, 0])
    if set(prepared.columns) <= {*roles.keys, target, *roles.features, *roles.tiebreak}:
        # Prepared features have no gaps, so the newest rows decide alone: they are cut out
        # before any shuffle, however long the history is. (A gap in some further column
        # would drop its row and make an older one count.)
        known = last_rows(known, roles, lookback + reach).drop("_back")
        layout = Layout("series")
    else:
        layout = layout.settled(known, roles)
    coming = last_rows(known, roles, 1).drop("_back").withColumns({
        date: ahead.cast(temporal),
        target: F.lit(None).cast(prepared.schema[target].dataType),
    })
    marked = known.withColumn("_new", F.lit(False)).unionByName(
        coming.withColumn("_new", F.lit(True))
    )
    frame = with_features(marked, roles, lags, rolls, layout)
    others = [c for c in frame.columns if c != target]
    frame = frame.na.drop("any", subset=others).where(F.col("_new") | name(target).isNotNull())

    now = F.array(*[as_double(c, frame.schema[c].dataType) for c in features])
    y = as_double(target, frame.schema[target].dataType)
    extra = [name(t) for t in roles.tiebreak]
    slim = frame.select(
        *[name(k) for k in roles.keys], *extra, "_new",
        y.alias("_target"), now.cast("array<double>").alias("_now"),
    )

    def build(window: WindowSpec) -> dict[str, Column]:
        back = window.rowsBetween(-lookback, -1)
        columns = {"past": F.collect_list("_target").over(back)}
        if sequence:
            row = F.concat(F.array("_target"), F.col("_now"))
            columns["steps"] = F.collect_list(row).over(back)
        return columns

    ready = over_series(slim, roles, lookback, 0, build, layout)
    ready = ready.where(F.col("_new") & (F.size("past") == lookback))
    columns = [
        *[name(k) for k in roles.keys], "past", F.concat("past", "_now").alias("tabular"),
        array_mean(F.col("past")).alias("recent_average"),
        F.date_sub(name(date).cast("date"), step_days).alias("last_date"),
    ]
    if sequence:
        columns.append(F.col("steps"))
    return ready.select(*columns)


def forecast_rows(predicted: DataFrame, roles: Roles, step_days: int = 1) -> DataFrame:
    """Long forecast of a model: the prediction array against the dates after the last."""
    keys = [roles.series] if roles.series else []
    at = F.posexplode("prediction").alias("_at", "_p")
    return predicted.select(*keys, "recent_average", "last_date", at).select(
        *keys,
        "recent_average",
        (F.col("_at") + 1).cast("int").alias("step"),
        F.date_add("last_date", (F.col("_at") + 1) * step_days).alias("date"),
        F.greatest(F.col("_p"), F.lit(0.0)).alias("forecast"),
    )


def forecast_summary(rows: DataFrame, roles: Roles) -> DataFrame:
    """Averages, trend, label and insight per series from long forecast rows."""
    keys = [roles.series] if roles.series else []
    return _with_trend(rows.groupBy(*keys).agg(*_averages()), keys)


def _averages() -> list[Column]:
    return [F.max("recent_average").alias("_recent"), F.avg("forecast").alias("_ahead")]


def _with_trend(totals: DataFrame, keep: Sequence[str]) -> DataFrame:
    delta = (F.col("_ahead") - F.col("_recent")) / F.greatest("_recent", F.lit(AVERAGE_FLOOR))
    return (
        totals.withColumn("_delta", delta)
        .withColumn("trend_pct", F.bround(F.col("_delta") * 100, 1))
        .select(
            *keep,
            F.bround("_recent", 1).alias("recent_average"),
            F.bround("_ahead", 1).alias("forecast_average"),
            "trend_pct",
            trend_label(F.col("trend_pct")).alias("trend_label"),
            insight(F.col("_delta")).alias("insight"),
        )
    )


def forecast_document(rows: DataFrame, roles: Roles, model_name: str) -> DataFrame:
    """One row per series in the layout of the served document: one aggregate of the rows."""
    keys = [roles.series] if roles.series else []
    grouped = rows.groupBy(*keys).agg(
        *_averages(),
        F.count(F.lit(1)).cast("int").alias("horizon"),
        F.array_sort(F.collect_list(F.struct(
            "step", F.date_format("date", "yyyy-MM-dd").alias("date"),
            F.bround("forecast", 1).alias("value"),
        ))).alias("points"),
    )
    summary = _with_trend(grouped, [*keys, "horizon", "points"])
    return summary.withColumn("model", F.lit(model_name))


def forecast_band(rows: DataFrame) -> DataFrame:
    """Lower and upper bound around every forecast value."""
    low, high = BAND
    return rows.withColumns({
        "lower": F.col("forecast") * low, "upper": F.col("forecast") * high
    })


def chart_series(df: DataFrame, rows: DataFrame, roles: Roles, tail: int = CHART_TAIL) -> DataFrame:
    """Newest actual rows, then the forecast; the forecast line starts at the last actual."""
    keys = [roles.series] if roles.series else []
    y = as_double(roles.target, df.schema[roles.target].dataType)
    actual = last_rows(df, roles, tail).select(
        *keys,
        name(roles.date).cast("date").alias("date"),
        y.alias("actual"),
        F.when(F.col("_back") == 1, y).alias("forecast"),
    )
    ahead = rows.select(*keys, "date", F.lit(None).cast("double").alias("actual"), "forecast")
    return forecast_band(actual.unionByName(ahead))


def inventory_recommendations(summary: DataFrame, roles: Roles) -> DataFrame:
    """Advice per product: the trend times the product's factor."""
    keys = [roles.series] if roles.series else []
    products = F.array(*[
        F.struct(F.lit(p).alias("product"), F.lit(f).alias("factor")) for p, f in PRODUCT_FACTORS
    ])
    percent = half_up(F.col("trend_pct") * F.col("factor")).cast("bigint")
    return (
        summary.select(*keys, "trend_pct", F.inline(products))
        .withColumn("change_pct", percent)
        .select(*keys, "product", "change_pct", stock_action(F.col("change_pct")).alias("action"))
    )
