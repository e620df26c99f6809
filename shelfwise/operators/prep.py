"""Cleaning, imputing, scaling and encoding with a fitted, storable state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.calendar import parse_timestamp
from shelfwise.functions.columns import as_double, name, nan_to_null, to_long
from shelfwise.operators.ordering import positions_by_sort, series_order
from shelfwise.operators.quantiles import SMALL_ROWS, exact_quantiles
from shelfwise.operators.roles import Roles

# The token of a missing category and the code of an unknown one.
MISSING_CATEGORY = "NA"
UNKNOWN_CODE = -1.0

#: Limits of a code table that is collected and broadcast: rows, and bytes of all texts.
BROADCAST_CATEGORIES = 50_000
BROADCAST_BYTES = 16 << 20
SALT_PARTS = 32


def to_panel(df: DataFrame, series: str | None, date: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (series, date): the shape every ordered operator expects.

    Rows of one key are combined before the shuffle, so a series that holds a large share
    of the raw rows costs no more than any other.
    """
    keys = [name(c) for c in (series, date) if c]
    return df.groupBy(*keys).agg(*[m.alias(k) for k, m in measures.items()])


def parse_dates(
    df: DataFrame, date: str, formats: Sequence[str] = (), as_date: bool = False
) -> DataFrame:
    """Read the date column and drop rows whose date is missing or unreadable."""
    c = name(date)
    if isinstance(df.schema[date].dataType, T.StringType):
        c = parse_timestamp(c, formats)
    if as_date:
        c = c.cast("date")
    return df.withColumn(date, c).where(name(date).isNotNull())


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in any column (or in any of ``columns``)."""
    return df.na.drop("any", subset=list(columns) if columns is not None else None)


def filter_series(df: DataFrame, series: str | None, value: object | None) -> DataFrame:
    """Keep one series; without a value (0 is a value) or a series column, keep all."""
    if value is None or series is None:
        return df
    return df.where(name(series) == F.lit(value))


def row_cap(
    df: DataFrame, roles: Roles, rows: int | None, formats: Sequence[str] = ()
) -> DataFrame:
    """The first ``rows`` rows in (series, date) order.

    Text dates are read for the order; rows whose date is unreadable come last in their series.
    """
    if rows is None:
        return df
    if not isinstance(df.schema[roles.date].dataType, T.StringType):
        return sort_panel(df, roles).limit(rows)
    read = df.withColumn("_when", parse_timestamp(name(roles.date), formats))
    keys = [name(roles.series)] if roles.series else []
    order = [F.col("_when").asc_nulls_last(), *[name(t) for t in roles.tiebreak]]
    return read.orderBy(*keys, *order).limit(rows).drop("_when")


def sort_panel(df: DataFrame, roles: Roles) -> DataFrame:
    """Global (series, date) order, for output only."""
    keys = [name(roles.series)] if roles.series else []
    return df.orderBy(*keys, *series_order(roles))


@dataclass(frozen=True)
class ColumnScale:
    """Fitted numbers of one numeric column."""

    median: float | None
    mean: float | None
    std: float | None


@dataclass(frozen=True)
class PrepState:
    """Everything the transform needs. ``codes`` has one row per (column, category)."""

    roles: Roles
    scales: dict[str, ColumnScale]
    codes: DataFrame | None
    n_codes: int = 0

    def scales_frame(self, spark: SparkSession) -> DataFrame:
        return scales_frame(spark, self.scales)


def scales_frame(spark: SparkSession, scales: dict[str, ColumnScale]) -> DataFrame:
    """The fitted numbers as a table, one row per column."""
    return spark.createDataFrame(
        [(c, s.median, s.mean, s.std) for c, s in scales.items()],
        "column string, median double, mean double, std double",
    )


def fit_medians(df: DataFrame, columns: Sequence[str], small_rows: int = SMALL_ROWS) -> dict:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], small_rows).items()}


def fit_scales(
    df: DataFrame, columns: Sequence[str], small_rows: int = SMALL_ROWS
) -> dict[str, ColumnScale]:
    """Median, and mean and population deviation as they are after filling the gaps.

    Filling adds copies of the median to known sums, so the filled table is never scanned.
    """
    if not columns:
        return {}
    aggregates = [F.count(F.lit(1))]
    for c in columns:
        x = F.nanvl(as_double(c, df.schema[c].dataType), F.lit(None).cast("double"))
        aggregates += [F.count(x), F.avg(x), F.var_pop(x)]
    total, *found = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()
    sizes = {c: found[3 * i] for i, c in enumerate(columns)}
    quantiles = exact_quantiles(df, columns, [0.5], small_rows, sizes=sizes)
    medians = {c: q[0] for c, q in quantiles.items()}
    scales = {}
    for i, c in enumerate(columns):
        present, mean, variance = found[3 * i : 3 * i + 3]
        if not present:
            scales[c] = ColumnScale(None, None, 1.0)
            continue
        filled, gap = total - present, mean - medians[c]
        share = present / total
        variance = share * (variance + gap * gap * filled / total)
        mean = share * mean + filled / total * medians[c]
        scales[c] = ColumnScale(medians[c], mean, sqrt(variance) or 1.0)
    return scales


def impute(df: DataFrame, fill: dict[str, float | None]) -> DataFrame:
    """Replace missing numbers by the given value of their column."""
    return df.withColumns({
        c: F.coalesce(
            F.nanvl(as_double(c, df.schema[c].dataType), F.lit(None).cast("double")),
            F.lit(v).cast("double"),
        )
        for c, v in fill.items()
    })


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace missing numbers by the exact median of their column."""
    return impute(df, fit_medians(df, columns))


def scale(df: DataFrame, scales: dict[str, ColumnScale]) -> DataFrame:
    """(x - mean) / std with fitted numbers as literals: a pure projection."""
    return df.withColumns({
        c: (name(c) - F.lit(s.mean).cast("double")) / F.lit(s.std) for c, s in scales.items()
    })


def _category(column: str) -> Column:
    return F.coalesce(name(column).cast("string"), F.lit(MISSING_CATEGORY))


def fit_codes(
    df: DataFrame, columns: Sequence[str], bound: int = BROADCAST_CATEGORIES,
    max_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, int]:
    """Codes 0..n-1 in string order per column, and the number of rows of that table.

    Up to ``bound`` categories and ``max_bytes`` of text in all, the table is a small local
    one. Beyond that they are numbered by a global sort, so no task holds all categories of a
    column, and no text comes to the driver.
    """
    pairs = to_long(df, {c: _category(c) for c in columns}, value_as="category").distinct()
    few = pairs.limit(bound + 1)
    if not _is_small(few, bound, max_bytes):
        order = [F.col("category").asc()]
        placed = positions_by_sort(pairs, ["column"], order, "code", "n")
        codes = placed.select("column", "category", F.col("code").cast("int").alias("code"))
        return codes, codes.count()
    codes, seen = [], {}
    for r in sorted(few.collect(), key=lambda r: (r["column"], r["category"].encode())):
        seen[r["column"]] = seen.get(r["column"], -1) + 1
        codes.append((r["column"], r["category"], seen[r["column"]]))
    schema = "column string, category string, code int"
    return df.sparkSession.createDataFrame(codes, schema), len(codes)


def _is_small(codes: DataFrame, bound: int, max_bytes: int) -> bool:
    """Is a table of at most ``bound + 1`` categories within both limits?"""
    size = F.coalesce(F.sum(F.octet_length("category")), F.lit(0))
    n, total = codes.agg(F.count(F.lit(1)), size).first()
    return n <= bound and total <= max_bytes


def encode(
    df: DataFrame,
    columns: Sequence[str],
    codes: DataFrame,
    n_codes: int,
    bound: int = BROADCAST_CATEGORIES,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace categories by their codes; unknown ones become -1.

    A code table within ``bound`` rows and ``max_bytes`` of text is broadcast. A larger one is
    joined by the SHA-256 of the category, with the rows of each category spread over
    ``SALT_PARTS`` parts, so a category that holds a third of all rows does not end in one task.
    """
    out = df
    small = n_codes <= bound and _is_small(codes, bound, max_bytes)
    for c in columns:
        of_column = codes.where(F.col("column") == c).select(
            F.col("category").alias("_category"), F.col("code").cast("double").alias("_code")
        )
        left = out.withColumn("_key", _category(c))
        if small:
            joined = left.join(F.broadcast(of_column), F.col("_key") == F.col("_category"), "left")
        else:
            others = [F.col(f"`{k}`") for k in df.columns if not isinstance(
                df.schema[k].dataType, T.MapType)]
            salted = left.withColumns({
                "_key": F.sha2("_key", 256),
                "_salt": F.pmod(F.xxhash64(*others), F.lit(SALT_PARTS)),
            })
            hashed = of_column.withColumn("_category", F.sha2("_category", 256))
            copies = hashed.withColumn(
                "_part", F.explode(F.sequence(F.lit(0), F.lit(SALT_PARTS - 1)))
            )
            joined = salted.join(
                copies,
                (F.col("_key") == F.col("_category")) & (F.col("_salt") == F.col("_part")),
                "left",
            ).drop("_salt", "_part")
        out = joined.withColumn(c, F.coalesce("_code", F.lit(UNKNOWN_CODE))).drop(
            "_key", "_category", "_code"
        )
    return out.select(*[name(k) for k in df.columns])


class Preprocessor:
    """fit / transform over a panel: dates parsed, numbers filled and scaled, texts coded."""

    def __init__(
        self,
        formats: Sequence[str] = (),
        as_date: bool = False,
        impute_from: str = "fit",
        small_rows: int = SMALL_ROWS,
        broadcast_categories: int = BROADCAST_CATEGORIES,
    ):
        if impute_from not in ("fit", "batch"):
            raise ValueError("impute_from is 'fit' or 'batch'")
        self.formats = tuple(formats)
        self.as_date = as_date
        self.impute_from = impute_from
        self.small_rows = small_rows
        self.broadcast_categories = broadcast_categories
        self.state: PrepState | None = None

    def parsed(self, df: DataFrame, roles: Roles) -> DataFrame:
        return nan_to_null(parse_dates(df, roles.date, self.formats, self.as_date))

    def fit(self, df: DataFrame, roles: Roles) -> Preprocessor:
        parsed = self.parsed(df, roles)
        numeric = [c for c in roles.numeric if c in df.columns]
        categorical = [c for c in roles.categorical if c in df.columns]
        codes, n_codes = None, 0
        if categorical:
            codes, n_codes = fit_codes(parsed, categorical, self.broadcast_categories)
        self.state = PrepState(
            roles=roles.with_(numeric=tuple(numeric), categorical=tuple(categorical)),
            scales=fit_scales(parsed, numeric, self.small_rows),
            codes=codes,
            n_codes=n_codes,
        )
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Lazy: one projection plus one code lookup per categorical column."""
        if self.state is None:
            raise ValueError("fit the preprocessor or load its state first")
        state = self.state
        parsed = self.parsed(df, state.roles)
        if self.impute_from == "batch":
            fill = fit_medians(parsed, list(state.scales), self.small_rows)
        else:
            fill = {c: s.median for c, s in state.scales.items()}
        out = scale(impute(parsed, fill), state.scales)
        if state.codes is not None:
            out = encode(out, state.roles.categorical, state.codes, state.n_codes,
                         self.broadcast_categories)
        return out

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        return self.fit(df, roles).transform(df)
