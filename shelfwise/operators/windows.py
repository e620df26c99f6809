"""Sliding lookback / horizon windows and their chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from shelfwise.functions.columns import as_double, name
from shelfwise.operators.features import feature_columns
from shelfwise.operators.ordering import AUTO, Layout, last_rows, over_series, with_positions
from shelfwise.operators.roles import Roles

# Default window sizes, split share and the least number of windows.
LOOKBACK = 14
HORIZON = 7
TRAIN_SHARE = 0.8
MIN_WINDOWS = 30
MIN_ROWS = 100

#: Rows of one series that a chunk holds.
CHUNK_ROWS = 1_024


def sliding_windows(
    df: DataFrame,
    roles: Roles,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    features: Sequence[str] | None = None,
    sequence: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """One row per complete window of a feature frame, keyed by (series, date).

    ``past``: the ``lookback`` targets before the row. ``future``: the targets of the row
    and the ``horizon - 1`` after it. ``tabular``: past plus the features of the row.
    ``steps`` (with ``sequence``): per lookback row, its target and features.
    ``end_date``: date of the last horizon row. ``window_index`` counts from 0 in the
    series, ``n_windows`` is their number.

    Windows never cross a series. The frame must have no missing targets (see
    ``drop_incomplete``): completeness is read off the position of the row.
    """
    names = list(features) if features is not None else feature_columns(df, roles)
    now = [as_double(c, df.schema[c].dataType) for c in names]
    target = as_double(roles.target, df.schema[roles.target].dataType)
    extra = [name(t) for t in roles.tiebreak]
    slim = df.select(
        *[name(k) for k in roles.keys], *extra,
        target.alias("_target"), F.array(*now).cast("array<double>").alias("_now"),
    )

    def build(window: WindowSpec) -> dict[str, Column]:
        back = window.rowsBetween(-lookback, -1)
        ahead = window.rowsBetween(0, horizon - 1)
        columns = {
            "past": F.collect_list("_target").over(back),
            "future": F.collect_list("_target").over(ahead),
            "end_date": F.last(name(roles.date)).over(ahead).cast("date"),
        }
        if sequence:
            step = F.concat(F.array("_target"), F.col("_now"))
            columns["steps"] = F.collect_list(step).over(back)
        return columns

    framed = over_series(slim, roles, lookback, horizon - 1, build, layout, positions=True)
    index = F.col("_pos") - lookback
    count = F.col("_n") - (lookback + horizon - 1)
    kept = framed.where((index >= 0) & (index < count))
    columns = [
        *[name(k) for k in roles.keys], *extra,
        "past", "future", F.concat("past", "_now").alias("tabular"), "end_date",
    ]
    if sequence:
        columns.append(F.col("steps"))
    return kept.select(
        *columns, index.cast("long").alias("window_index"), count.cast("long").alias("n_windows")
    )


def series_chunks(
    df: DataFrame,
    roles: Roles,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    features: Sequence[str] | None = None,
    layout: Layout = AUTO,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A feature frame as one row per (series, run of ``rows`` rows), for ``chunk_windows``.

    ``cells`` holds the rows of the chunk in order, and the few rows next to it that its windows
    reach. A row is kept about once, not once per window that covers it: this is what to persist
    where windows are read several times.
    """
    names = list(features) if features is not None else feature_columns(df, roles)
    now = [as_double(c, df.schema[c].dataType) for c in names]
    target = as_double(roles.target, df.schema[roles.target].dataType)
    keys = [name(roles.series)] if roles.series else []
    slim = df.select(
        *keys, name(roles.date).alias("_date"), *[name(t).alias(f"_t{i}") for i, t in enumerate(roles.tiebreak)],
        target.alias("_target"), F.array(*now).cast("array<double>").alias("_now"),
    )
    local = roles.with_(date="_date", tiebreak=tuple(f"_t{i}" for i in range(len(roles.tiebreak))))
    rows = max(rows, lookback + horizon)
    place, home = F.col("_pos") % rows, F.expr(f"_pos div {rows}")
    ahead, back = place >= rows - lookback, (place < horizon - 1) & (home > 0)
    chunks = (
        F.when(ahead & back, F.array(home, home + 1, home - 1))
        .when(ahead, F.array(home, home + 1))
        .when(back, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    cell = F.struct("_pos", "_date", *local.tiebreak, "_target", "_now")
    placed = with_positions(slim, local, layout.settled(slim, local))
    spread = placed.select(*keys, "_n", cell.alias("cell"), F.explode(chunks).alias("chunk"))
    return spread.groupBy(*keys, "chunk").agg(
        F.max("_n").alias("n"), F.array_sort(F.collect_list("cell")).alias("cells"))


def chunk_windows(
    chunks: DataFrame,
    roles: Roles,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    sequence: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The windows of ``sliding_windows``, cut from chunks made with the same sizes; no shuffle."""
    keys = [name(roles.series)] if roles.series else []
    rows = max(rows, lookback + horizon)
    start = F.col("cells")[0]["_pos"]
    first = F.greatest(F.col("chunk") * rows, F.lit(lookback))
    last = F.least((F.col("chunk") + 1) * rows, F.col("n") - horizon + 1) - 1  # positions of windows
    places = F.when(last >= first, F.sequence(first, last))
    at = chunks.select(*keys, "n", "cells", start.alias("_start"), F.explode(places).alias("_pos"))
    at = at.withColumn("_i", (F.col("_pos") - F.col("_start") + 1).cast("int"))  # 1-based
    back = F.slice("cells", F.col("_i") - lookback, F.lit(lookback))
    ahead = F.slice("cells", F.col("_i"), F.lit(horizon))
    here = F.element_at("cells", F.col("_i"))
    past = F.transform(back, lambda c: c["_target"])
    columns = [
        *keys, here["_date"].alias(roles.date),
        *[here[f"_t{i}"].alias(t) for i, t in enumerate(roles.tiebreak)],
        past.alias("past"), F.transform(ahead, lambda c: c["_target"]).alias("future"),
        F.concat(past, here["_now"]).alias("tabular"),
        F.element_at(ahead, -1)["_date"].cast("date").alias("end_date"),
    ]
    if sequence:
        columns.append(F.transform(back, lambda c: F.concat(F.array(c["_target"]), c["_now"])).alias("steps"))
    return at.select(
        *columns, (F.col("_pos") - lookback).cast("long").alias("window_index"),
        (F.col("n") - (lookback + horizon - 1)).cast("long").alias("n_windows"))


def window_count(df: DataFrame, roles: Roles, lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Complete windows per series: a grouped count, no window is built."""
    keys = [name(roles.series)] if roles.series else []
    n = F.count(F.lit(1)) - (lookback + horizon - 1)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.greatest(n, F.lit(0)).alias("n_windows")
    )


def split_windows(windows: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """Mark the earliest share of each series' windows as training data."""
    cut = F.floor(F.col("n_windows") * F.lit(train_share))
    return windows.withColumn("is_train", F.col("window_index") < cut)


def latest_window(windows: DataFrame) -> DataFrame:
    """The last complete window of every series: a filter, its index is known."""
    return windows.where(F.col("window_index") == F.col("n_windows") - 1)


def horizon_long(windows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (window, step): ``step`` counts from 1."""
    return windows.select(
        *[name(k) for k in keep], F.posexplode("future").alias("_at", "y")
    ).select(*[name(k) for k in keep], (F.col("_at") + 1).cast("int").alias("step"), "y")


def eligible_series(
    df: DataFrame, roles: Roles, min_windows: int = MIN_WINDOWS, min_rows: int = MIN_ROWS,
    lookback: int = LOOKBACK, horizon: int = HORIZON,
) -> DataFrame:
    """Series of a feature frame with enough rows and windows to be trained on."""
    return window_count(df, roles, lookback, horizon).where(
        (F.col("n_windows") >= min_windows) & (F.col("n_rows") >= min_rows)
    )


def require_rows(n_rows: int, least: int = MIN_ROWS) -> None:
    if n_rows < least:
        raise ValueError(f"Not enough data to proceed: {n_rows} rows, {least} needed.")


def require_windows(n_windows: int, least: int = MIN_WINDOWS) -> None:
    if n_windows < least:
        raise ValueError(f"Too few windows ({n_windows}); more history is needed.")


__all__ = [
    "CHUNK_ROWS", "HORIZON", "LOOKBACK", "MIN_ROWS", "MIN_WINDOWS", "TRAIN_SHARE", "chunk_windows",
    "eligible_series", "horizon_long", "last_rows", "latest_window", "require_rows",
    "require_windows", "series_chunks", "sliding_windows", "split_windows", "window_count",
]
