"""Row order inside a series, laid out so that no task has to hold a whole long series.

All layouts give the same rows, one per (series, date, tie-break columns):

``series``
    one window partition per series. Right for daily panels: a series then has at most one
    row per calendar day (36,525 per century), so a window partition has a proven bound.

``blocks``
    for sub-daily data, where one series may hold a third of all rows. Every row gets its
    position in the series by two-level counting (rows per series and time slice, a running
    sum over slices, a row number inside the slice). Positions are cut into blocks of equal
    size, and the few rows next to a cut are copied into the neighbour block, so a window
    over (series, block) sees all the rows its frame can reach.

``sorted``
    like ``blocks``, for data where even one time slice is too large for a task. Positions
    come from a global range sort, which splits any series and any slice evenly; the
    sorted table is checkpointed, because its parts are counted before they are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import name
from shelfwise.operators.roles import Roles
from shelfwise.session import ensure_checkpoint_dir

ROWS_PER_BLOCK = 65_536
SLICE_SECONDS = 3_600
SLICE_DAYS = 64


@dataclass(frozen=True)
class Layout:
    """How ordered work is spread: "auto" (measured), "series", "blocks" or "sorted"."""

    kind: str = "auto"
    rows_per_block: int = ROWS_PER_BLOCK
    slice_seconds: int = SLICE_SECONDS

    def resolve(self, df: DataFrame, roles: Roles) -> str:
        return measured_layout(df, roles).kind if self.kind == "auto" else self.kind

    def settled(self, df: DataFrame, roles: Roles) -> Layout:
        """The same with the kind decided, for several steps over the same rows."""
        return replace(self, kind=self.resolve(df, roles))


AUTO = Layout()
#: For tables with one row per (series, date) of type DATE, as ``to_panel`` makes them.
PANEL = Layout("series")


def measured_layout(df: DataFrame, roles: Roles, max_rows: int = 1_000_000) -> Layout:
    """Pick the layout from the largest series and time slice (one small aggregate job)."""
    key, time_slice = _series_and_slice(df, roles, AUTO)
    per_slice = df.groupBy(key.alias("k"), time_slice.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    per_series = per_slice.groupBy("k").agg(F.sum("n").alias("rows"), F.max("n").alias("slice"))
    found = per_series.agg(F.max("rows"), F.max("slice")).first()
    rows, largest_slice = found[0] or 0, found[1] or 0
    if rows <= max_rows:
        return Layout("series")
    return Layout("blocks" if largest_slice <= max_rows else "sorted")


def series_keys(roles: Roles) -> list[Column]:
    return [name(roles.series)] if roles.series else []


def series_order(roles: Roles, descending: bool = False) -> list[Column]:
    """Date, then the tie-break columns of the roles."""
    columns = [name(roles.date), *[name(t) for t in roles.tiebreak]]
    return [c.desc() if descending else c.asc() for c in columns]


def _time_slice(df: DataFrame, roles: Roles, layout: Layout) -> Column:
    date = name(roles.date)
    kind = df.schema[roles.date].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(date) / SLICE_DAYS)
    if isinstance(kind, T.TimestampNTZType):  # no time zone: count wall-clock seconds
        of_day = F.hour(date) * 3600 + F.minute(date) * 60 + F.floor(F.second(date))
        seconds = F.unix_date(date.cast("date")).cast("long") * 86_400 + of_day
    else:
        seconds = F.unix_seconds(date)
    return F.floor(seconds / layout.slice_seconds)


def _series_and_slice(df: DataFrame, roles: Roles, layout: Layout) -> tuple[Column, Column]:
    """Never-null keys: a join on them can reuse the partitioning of a window."""
    key = F.coalesce(name(roles.series).cast("string"), F.lit("\0")) if roles.series else F.lit("")
    return key, F.coalesce(_time_slice(df, roles, layout), F.lit(-(2**40)))


def with_positions(df: DataFrame, roles: Roles, layout: Layout = AUTO) -> DataFrame:
    """Add ``_pos`` (0-based place in the series) and ``_n`` (rows in the series)."""
    kind = layout.resolve(df, roles)
    if kind == "series":
        whole = W.partitionBy(*series_keys(roles))
        return df.withColumns({
            "_pos": (F.row_number().over(whole.orderBy(*series_order(roles))) - 1).cast("long"),
            "_n": F.count(F.lit(1)).over(whole),
        })
    key, time_slice = _series_and_slice(df, roles, layout)
    if kind == "sorted":
        keyed = df.withColumn("_key", key)
        placed = positions_by_sort(keyed, ["_key"], series_order(roles), "_pos", "_n")
        return placed.drop("_key")
    sliced = df.withColumns({"_key": key, "_slice": time_slice})
    per_slice = sliced.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = W.partitionBy("_key")
    earlier = by_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = per_slice.select(
        "_key",
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_rows").over(by_key).alias("_n"),
    )
    inside = W.partitionBy("_key", "_slice").orderBy(*series_order(roles))
    numbered = sliced.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(starts, ["_key", "_slice"])
        .withColumn("_pos", F.col("_start") + F.col("_rn") - 1)
        .drop("_key", "_slice", "_start", "_rn")
    )


def positions_by_sort(
    df: DataFrame, group: list[str], order: list[Column], position: str, total: str
) -> DataFrame:
    """Place of every row in its group and rows of the group, from a global range sort.

    After the sort the generated id grows with (group, order) and its high bits name the
    sorted part. Rows per (group, part) are counted, summed over the parts, and added to
    the place inside the part: no task sees more than one part of a group.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (
        df.orderBy(*group, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .checkpoint()
    )
    by_group = W.partitionBy(*group)
    earlier = by_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        ordered.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
        .withColumns({
            "_start": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            total: F.sum("_rows").over(by_group),
        })
    )
    place = F.col("_start") + F.col("_id") - F.col("_first")
    return (
        ordered.join(parts, [*group, "_part"])
        .withColumn(position, place)
        .drop("_id", "_part", "_rows", "_first", "_start")
    )


def over_series(
    df: DataFrame,
    roles: Roles,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    layout: Layout = AUTO,
    positions: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    ``build`` gets the window and returns the new columns; it may also use ``_pos`` and
    ``_n`` when ``positions`` is set.
    """
    kind = layout.resolve(df, roles)
    if kind == "series":
        window = W.partitionBy(*series_keys(roles)).orderBy(*series_order(roles))
        base = with_positions(df, roles, Layout("series")) if positions else df
        return base.withColumns(build(window))

    size = max(layout.rows_per_block, before + after + 1)
    place = F.col("_pos") % size
    home = F.expr(f"_pos div {size}")
    ahead = (place >= size - before) if before else F.lit(False)
    back = ((place < after) & (home > 0)) if after else F.lit(False)
    copies = (
        F.when(ahead & back, F.array(home, home + 1, home - 1))
        .when(ahead, F.array(home, home + 1))
        .when(back, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    spread = (
        with_positions(df, roles, replace(layout, kind=kind))
        .withColumn("_home", home)
        .withColumn("_block", F.explode(copies))
    )
    window = W.partitionBy(*series_keys(roles), "_block").orderBy("_pos")
    done = spread.withColumns(build(window)).where(F.col("_home") == F.col("_block"))
    done = done.drop("_home", "_block")
    return done if positions else done.drop("_pos", "_n")


def last_rows(df: DataFrame, roles: Roles, n: int) -> DataFrame:
    """The newest ``n`` rows of every series, numbered 1.. from the newest in ``_back``.

    A row-number limit is applied before the shuffle, so at most ``n`` rows per series
    leave each map task, however long the series is.
    """
    newest = W.partitionBy(*series_keys(roles)).orderBy(*series_order(roles, descending=True))
    return df.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
