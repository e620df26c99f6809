"""Which column is the date, the target, the series key or a feature.

All evidence comes from one aggregate over the table, without a shuffle of values and
without any distinct count: the small-integer test keeps a bit mask of the values seen,
and "more than one value" is minimum differs from maximum.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.calendar import parse_timestamp
from shelfwise.functions.columns import (
    FRACTIONAL,
    as_double,
    is_numeric,
    is_temporal,
    name,
    one_row_per,
)

# Name patterns, limits and scores of the role rules.
TARGET_NAMES = r"(sales|revenue|demand|orders?|qty|quantity|units|count|volume|amount)"
ID_NAMES = r"(id$|_id|index|store|shop|item|sku|product)"
SMALL_INT_RANGE = (-1, 12)
SMALL_INT_MAX_DISTINCT = 12
DATE_MIN_RATIO = 0.6
NAMED_TARGET_CONFIDENCE = 0.9
VARIANCE_TARGET_CONFIDENCE = 0.5
DATE_NOTE = "Date column uncertain — consider setting it via config override."
NO_TARGET = "No numeric target column could be detected."
VARIANCE_NOTE = "Target guessed by variance ('{}') — verify via config."


@dataclass(frozen=True)
class Roles:
    """Column roles of one panel; ``tiebreak`` orders rows that share a date."""

    date: str
    target: str
    series: str | None = None
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    frequency: str | None = None
    tiebreak: tuple[str, ...] = ()
    confidence: dict[str, float] = field(default_factory=dict)
    notes: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [c for c in (self.series, self.date) if c]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def with_(self, **changes: Any) -> Roles:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_dict(stored: dict[str, Any]) -> Roles:
        tuples = ("numeric", "categorical", "tiebreak", "notes")
        return Roles(**{k: tuple(v) if k in tuples else v for k, v in stored.items()})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row in the documented schema layout."""
        return spark.createDataFrame(
            [(self.date, self.target, list(self.numeric), list(self.categorical),
              self.frequency, self.series, dict(self.confidence), list(self.notes))],
            "date_column string, target_column string, numerical_features array<string>, "
            "categorical_features array<string>, frequency string, group_column string, "
            "confidence map<string,double>, notes array<string>",
        )


def _small_int_mask(c: Column) -> Column:
    """Bit mask of the values seen, for values inside the small-integer range."""
    low, high = SMALL_INT_RANGE
    bit = F.when(
        (c == F.floor(c)) & c.between(low, high),
        F.call_function("shiftleft", F.lit(1), (c - low).cast("int")),
    )
    return F.bit_or(bit)


def _evidence_struct(
    position: int, f: T.StructField, aliases: dict[str, Column], parse: bool
) -> Column:
    """Aggregates for one column, registered in ``aliases`` and read back as a struct.

    Only what a rule can ask of this column is computed.
    """

    def keep(label: str, aggregate: Column) -> Column:
        alias = f"{label}_{position}"
        aliases[alias] = aggregate
        return F.col(alias)

    numeric, temporal = is_numeric(f.dataType), is_temporal(f.dataType)
    key_like = re.search(ID_NAMES, f.name, re.I) is not None
    c = name(f.name)
    fields: dict[str, Column] = {
        "position": F.lit(position),
        "column": F.lit(f.name),
        "is_numeric": F.lit(numeric),
        "is_temporal": F.lit(temporal),
        "is_small_int": F.lit(False),
        "variance": F.lit(None).cast("double"),
        "varies": F.lit(None).cast("boolean"),
        "parse_ratio": F.lit(1.0 if temporal else None).cast("double"),
    }
    if numeric:
        x = F.nanvl(as_double(f.name, f.dataType), F.lit(None).cast("double"))
        low, high = SMALL_INT_RANGE
        in_range = (x == F.floor(x)) & x.between(low, high)
        mask = keep("mask", F.coalesce(_small_int_mask(x), F.lit(0)))
        all_small = keep("small", F.coalesce(F.bool_and(in_range), F.lit(True)))
        fields["is_small_int"] = all_small & (F.bit_count(mask) <= SMALL_INT_MAX_DISTINCT)
        if not key_like:
            fields["variance"] = keep("var", F.var_samp(x))
    if key_like and not isinstance(f.dataType, (T.MapType, T.VariantType)):
        value = F.nanvl(c, F.lit(None)) if isinstance(f.dataType, FRACTIONAL) else c
        differs = F.min(value) != F.max(value)
        fields["varies"] = keep("varies", F.coalesce(differs, F.lit(False)))
    named_date = "date" in f.name.lower() or "time" in f.name.lower()
    text = isinstance(f.dataType, T.StringType)
    if parse and not numeric and not temporal and (text or named_date):
        parsed = parse_timestamp(c.cast("string")).isNotNull().cast("double")
        fields["parse_ratio"] = keep("ratio", F.coalesce(F.avg(parsed), F.lit(0.0)))
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def column_evidence(df: DataFrame, parse: bool = True) -> DataFrame:
    """One row per column: type flags, small-integer test, variance, date parse ratio.

    Texts are only tried as dates if no column is a date already (never without
    ``parse``); ``varies`` is only known for columns named like a key.
    """
    fields = df.schema.fields
    parse = parse and not any(is_temporal(f.dataType) for f in fields)
    aliases: dict[str, Column] = {}
    structs = [_evidence_struct(i, f, aliases, parse) for i, f in enumerate(fields)]
    rows = F.count(F.lit(1)).alias("n_rows")
    return one_row_per(df.agg(rows, *[a.alias(k) for k, a in aliases.items()]), structs)


def date_candidates(df: DataFrame) -> DataFrame:
    """Candidate date columns with their parse ratio; ``chosen`` marks the winner."""
    ranked = W.orderBy(F.col("is_temporal").desc(), F.col("parse_ratio").desc(), "position")
    return (
        column_evidence(df)
        .where(F.col("parse_ratio").isNotNull())
        .select(
            "column",
            "parse_ratio",
            ((F.row_number().over(ranked) == 1) & (F.col("parse_ratio") > 0)).alias("chosen"),
        )
    )


def classify_features(df: DataFrame, exclude: list[str | None]) -> DataFrame:
    """``numeric`` or ``categorical`` for every column outside ``exclude``."""
    numeric = F.col("is_numeric") & ~F.col("is_small_int")
    return (
        column_evidence(df.drop(*[c for c in exclude if c]), parse=False)
        .select("column", F.when(numeric, "numeric").otherwise("categorical").alias("kind"))
    )


def target_by_variance(df: DataFrame, exclude: list[str | None] = ()) -> DataFrame:
    """The numeric, non-key column with the highest sample variance (one row)."""
    return (
        column_evidence(df.drop(*[c for c in exclude if c]), parse=False)
        .where("is_numeric")
        .agg(F.max_by("column", "variance").alias("column"), F.max("variance").alias("variance"))
    )


def frequency(df: DataFrame, date: str) -> DataFrame:
    """Typical gap between dates as ``D``, ``W`` or ``nD`` (one row; NULL if unclear).

    Gaps of a day or more can only lie between the last time of one day and the first of
    the next day present, so two times per day are enough: the windowed table is bounded
    by the calendar, not by the data.
    """
    kind = df.schema[date].dataType
    times = parse_timestamp(name(date)) if isinstance(kind, T.StringType) else name(date)
    known = df.select(times.alias("t")).where(F.col("t").isNotNull())
    days = known.groupBy(F.col("t").cast("date").alias("day")).agg(
        F.min("t").alias("first"), F.max("t").alias("last")
    )
    previous = F.lag("last").over(W.orderBy("day"))
    gap = F.timestamp_diff("DAY", previous, F.col("first"))
    times_of_day = F.lit(1) + (F.col("first") != F.col("last")).cast("int")
    found = days.select(gap.alias("gap"), times_of_day.alias("times")).agg(
        F.floor(F.median(F.when(F.col("gap") > 0, F.col("gap")))).cast("long").alias("gap"),
        # With gaps between days, three of these mean three different times.
        (F.sum("times") >= 3).alias("enough"),
    )
    return found.select(
        F.when(F.col("gap").isNull() | ~F.col("enough"), F.lit(None).cast("string"))
        .when(F.col("gap") == 1, "D")
        .when(F.col("gap") == 7, "W")
        .otherwise(F.concat(F.col("gap").cast("string"), F.lit("D")))
        .alias("frequency")
    )


def _pick_date(rows: list[Row], confidence: dict, notes: list) -> str | None:
    typed = [r for r in rows if r.is_temporal]
    if typed:
        confidence["date"] = 1.0
        return typed[0].column
    guesses = [r for r in rows if r.parse_ratio]
    best = max(guesses, key=lambda r: r.parse_ratio, default=None)
    ratio = best.parse_ratio if best else 0.0
    if ratio < DATE_MIN_RATIO:
        notes.append(DATE_NOTE)
    confidence["date"] = round(ratio, 3)
    return best.column if best else None


def _pick_target(rows: list[Row], date: str | None, confidence: dict, notes: list) -> str:
    usable = [
        r for r in rows
        if r.is_numeric and r.column != date and not re.search(ID_NAMES, r.column, re.I)
    ]
    named = [r for r in usable if re.search(TARGET_NAMES, r.column, re.I)]
    if named:
        confidence["target"] = NAMED_TARGET_CONFIDENCE
        return named[0].column
    if not usable:
        raise ValueError(NO_TARGET)
    widest = max(usable, key=lambda r: -1.0 if r.variance is None else r.variance)
    confidence["target"] = VARIANCE_TARGET_CONFIDENCE
    notes.append(VARIANCE_NOTE.format(widest.column))
    return widest.column


def detect_roles(df: DataFrame, overrides: dict[str, Any] | None = None) -> Roles:
    """Roles of a table; ``overrides`` uses the keys of the documented schema layout.

    Given roles cost nothing: when every role is given no job runs at all. Otherwise one
    aggregate covers all columns, and one more finds the frequency.
    """
    given = overrides or {}
    confidence: dict[str, float] = {}
    notes: list[str] = []
    names_given = all(given.get(k) for k in ("date_column", "target_column", "group_column"))
    lists_given = "numerical_features" in given and "categorical_features" in given
    rows: list[Row] = []
    if not (names_given and lists_given):
        rows = sorted(column_evidence(df).collect(), key=lambda r: r.position)

    date = given.get("date_column") or _pick_date(rows, confidence, notes)
    target = given.get("target_column") or _pick_target(rows, date, confidence, notes)
    series = given.get("group_column") or next(
        (r.column for r in rows
         if r.column not in (date, target) and r.varies and re.search(ID_NAMES, r.column, re.I)),
        None,
    )
    features = [r for r in rows if r.column not in (date, target, series)]
    numeric = [r.column for r in features if r.is_numeric and not r.is_small_int]
    categorical = [r.column for r in features if not r.is_numeric or r.is_small_int]
    step = given.get("frequency")
    if not step and date:
        step = frequency(df, date).first()[0]
    return Roles(
        date=date,
        target=target,
        series=series,
        numeric=tuple(given.get("numerical_features", numeric)),
        categorical=tuple(given.get("categorical_features", categorical)),
        frequency=step,
        confidence=confidence,
        notes=tuple(notes),
    )
