"""Calendar, lag and rolling features of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from shelfwise.functions.calendar import CALENDAR_FEATURES, calendar_parts
from shelfwise.functions.columns import name, numeric_columns
from shelfwise.operators.ordering import AUTO, Layout, over_series
from shelfwise.operators.prep import drop_incomplete
from shelfwise.operators.roles import Roles

# Default offsets and widths, counted in rows of the series.
LAGS = (1, 7, 14)
ROLLS = (7, 14)


def calendar_features(df: DataFrame, date: str, keep: Sequence[str | None] = ()) -> DataFrame:
    """Date parts as columns. A part named like the date or a ``keep`` column is prefixed."""
    taken = {date, *keep}
    return df.withColumns({
        f"cal_{part}" if part in taken else part: c
        for part, c in calendar_parts(name(date)).items()
    })


def _lags(target: str, lags: Sequence[int], window: WindowSpec) -> dict[str, Column]:
    return {f"{target}_lag{n}": F.lag(name(target), n).over(window) for n in lags}


def _rolls(target: str, rolls: Sequence[int], window: WindowSpec) -> dict[str, Column]:
    columns = {}
    for r in rolls:
        frame = window.rowsBetween(-r, -1)
        full = F.count(name(target)).over(frame) == r
        columns[f"{target}_roll{r}"] = F.when(full, F.avg(name(target)).over(frame))
    return columns


def lag_features(
    df: DataFrame, roles: Roles, lags: Sequence[int] = LAGS, layout: Layout = AUTO
) -> DataFrame:
    """Target values ``lags`` rows earlier in the same series."""
    return over_series(df, roles, max(lags), 0, lambda w: _lags(roles.target, lags, w), layout)


def rolling_features(
    df: DataFrame, roles: Roles, rolls: Sequence[int] = ROLLS, layout: Layout = AUTO
) -> DataFrame:
    """Mean of the previous r rows; NULL while fewer than r values are known."""
    return over_series(df, roles, max(rolls), 0, lambda w: _rolls(roles.target, rolls, w), layout)


def with_features(
    df: DataFrame,
    roles: Roles,
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    layout: Layout = AUTO,
) -> DataFrame:
    """All features, rows kept; lags and means share one window and one shuffle."""

    def build(window: WindowSpec) -> dict[str, Column]:
        return {**_lags(roles.target, lags, window), **_rolls(roles.target, rolls, window)}

    reach = max([*lags, *rolls, 0])
    dated = calendar_features(df, roles.date, (roles.series, roles.target))
    return over_series(dated, roles, reach, 0, build, layout) if reach else dated


def feature_frame(
    df: DataFrame,
    roles: Roles,
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    layout: Layout = AUTO,
) -> DataFrame:
    """All features, rows with any missing value dropped."""
    return drop_incomplete(with_features(df, roles, lags, rolls, layout))


def feature_columns(df: DataFrame, roles: Roles) -> list[str]:
    """Numeric columns of an engineered frame that are neither key, target nor tie-break."""
    skip = (roles.date, roles.target, roles.series, *roles.tiebreak)
    return [c for c in numeric_columns(df, skip) if not c.startswith("_")]


def densify(df: DataFrame, roles: Roles, step_days: int = 1, fill: float | None = None) -> DataFrame:
    """Add the missing dates of every series between its first and last one.

    For users who want lags counted in days. New rows have NULL (or ``fill`` as target).
    The calendar of a series is built from two dates, then joined on (series, date).
    """
    keys = [name(roles.series)] if roles.series else []
    span = df.groupBy(*keys).agg(F.min(roles.date).alias("_a"), F.max(roles.date).alias("_b"))
    step = F.expr(f"make_interval(0, 0, 0, {step_days})")
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(roles.date))
    full = calendar.join(df, roles.keys, "left").select(*[name(c) for c in df.columns])
    if fill is None:
        return full
    return full.withColumn(roles.target, F.coalesce(name(roles.target), F.lit(fill)))


__all__ = [
    "CALENDAR_FEATURES", "LAGS", "ROLLS", "calendar_features", "densify", "feature_columns",
    "feature_frame", "lag_features", "rolling_features", "with_features",
]
