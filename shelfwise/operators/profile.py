"""Table profile: missing values, distinct counts, constants, duplicates, warnings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import (
    FRACTIONAL,
    VALUE_SLOTS,
    group_value,
    name,
    one_row_per,
    python_list,
    to_long,
    typed_value,
)

# Limits of the profile rules and their warning texts.
HIGH_CARDINALITY = 50
HEAVY_MISSING_SHARE = 0.4
CONSTANT_TEXT = "Constant columns (no signal): "
DUPLICATES_TEXT = " duplicate rows."
HEAVY_MISSING_TEXT = "Columns >40% missing: "


@dataclass(frozen=True)
class Profile:
    """The profile on the driver: one entry per column, never per row."""

    n_rows: int
    n_columns: int
    missing: dict[str, int] = field(default_factory=dict)
    constant_columns: list[str] = field(default_factory=list)
    high_cardinality: list[str] = field(default_factory=list)
    duplicate_rows: int = 0
    statistics: dict[str, dict] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _exact_counts(df: DataFrame) -> DataFrame:
    """Rows, missing and distinct values per column, from one scan.

    Every value becomes a (column, value) row and is counted in two steps, so repeated
    values are combined before the shuffle and a hot value is one row per map task.
    """
    values = {f.name: typed_value(f.name, f.dataType) for f in df.schema.fields}
    slots = [F.col(f"value.{k}").alias(k) for k in VALUE_SLOTS]
    per_value = (
        to_long(df, values)
        .select("column", *slots)
        .groupBy("column", *VALUE_SLOTS)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = reduce(or_, [F.col(k).isNotNull() for k in VALUE_SLOTS])
    missing = F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"), missing.alias("missing"), F.count_if(known).alias("nunique")
    )


def _approximate_counts(df: DataFrame) -> DataFrame:
    """The same table with HyperLogLog distinct counts and no shuffle of values."""
    aggregates, structs = [F.count(F.lit(1)).alias("n_rows")], []
    for i, f in enumerate(df.schema.fields):
        present = name(f.name).isNotNull()
        if isinstance(f.dataType, FRACTIONAL):
            present = present & ~F.isnan(name(f.name))
        key = group_value(f.name, f.dataType)
        aggregates += [
            F.count_if(~present).alias(f"missing_{i}"),
            F.approx_count_distinct(key).alias(f"distinct_{i}"),
        ]
        structs.append(F.struct(
            F.lit(f.name).alias("column"),
            F.col("n_rows").alias("n_rows"),
            F.col(f"missing_{i}").alias("missing"),
            F.col(f"distinct_{i}").alias("nunique"),
        ))
    return one_row_per(df.agg(*aggregates), structs)


def profile_columns(
    df: DataFrame,
    high_cardinality: int = HIGH_CARDINALITY,
    heavy_missing_share: float = HEAVY_MISSING_SHARE,
    exact: bool = True,
) -> DataFrame:
    """One row per column with counts and quality flags."""
    spark = df.sparkSession
    fields = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), isinstance(f.dataType, T.StringType))
         for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string, is_text boolean",
    )
    counts = _exact_counts(df) if exact else _approximate_counts(df)
    rows = F.coalesce(F.col("n_rows"), F.lit(0))
    distinct = F.coalesce(F.col("nunique"), F.lit(0))
    missing = F.coalesce(F.col("missing"), F.lit(0))
    return F.broadcast(fields).join(counts, "column", "left").select(
        "position",
        "column",
        "dtype",
        rows.alias("n_rows"),
        distinct.alias("nunique"),
        missing.alias("missing"),
        (distinct + (missing > 0).cast("int") <= 1).alias("is_constant"),
        (F.col("is_text") & (distinct > high_cardinality)).alias("is_high_cardinality"),
        (missing > heavy_missing_share * rows).alias("is_heavy_missing"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first of each row, missing values equal (one row)."""
    keys = [group_value(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    keyed = df.select(*keys)
    per_row = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_table(
    df: DataFrame,
    high_cardinality: int = HIGH_CARDINALITY,
    heavy_missing_share: float = HEAVY_MISSING_SHARE,
    exact: bool = True,
) -> DataFrame:
    """One-row summary with the flagged columns and the warning texts."""
    columns = profile_columns(df, high_cardinality, heavy_missing_share, exact)

    def flagged(flag: str) -> Column:
        hits = F.collect_list(
            F.when(F.col(flag), F.struct("position", "column"))
        )
        return F.transform(F.array_sort(hits), lambda s: s["column"])

    summary = columns.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        flagged("is_constant").alias("constant_columns"),
        flagged("is_high_cardinality").alias("high_cardinality"),
        flagged("is_heavy_missing").alias("heavy_missing"),
    ).withColumn("duplicate_rows", duplicate_rows(df).scalar())
    constant, heavy = F.col("constant_columns"), F.col("heavy_missing")
    texts = F.array(
        F.when(F.size(constant) > 0,
               F.concat(F.lit(CONSTANT_TEXT), python_list(constant))),
        F.when(F.col("duplicate_rows") > 0,
               F.concat(F.col("duplicate_rows").cast("string"), F.lit(DUPLICATES_TEXT))),
        F.when(F.size(heavy) > 0,
               F.concat(F.lit(HEAVY_MISSING_TEXT), python_list(heavy))),
    )
    return summary.withColumn("warnings", F.array_compact(texts))


def profile(
    df: DataFrame,
    high_cardinality: int = HIGH_CARDINALITY,
    exact: bool = True,
) -> Profile:
    """Run the profile and bring its summary (a few values per column) to the driver."""
    columns = sorted(
        profile_columns(df, high_cardinality, exact=exact).collect(), key=lambda r: r.position
    )
    duplicates = duplicate_rows(df).first()[0]
    constant = [r.column for r in columns if r.is_constant]
    heavy = [r.column for r in columns if r.is_heavy_missing]
    texts = (
        (constant, CONSTANT_TEXT + str(constant)),
        (duplicates, str(duplicates) + DUPLICATES_TEXT),
        (heavy, HEAVY_MISSING_TEXT + str(heavy)),
    )
    return Profile(
        n_rows=max((r.n_rows for r in columns), default=0),
        n_columns=len(columns),
        missing={r.column: r.missing for r in columns},
        constant_columns=constant,
        high_cardinality=[r.column for r in columns if r.is_high_cardinality],
        duplicate_rows=duplicates,
        statistics={
            r.column: {"dtype": r.dtype, "nunique": r.nunique, "missing": r.missing}
            for r in columns
        },
        warnings=[text for found, text in texts if found],
    )
