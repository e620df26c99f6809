"""Type tests and column expressions that do not depend on any operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
FRACTIONAL = (T.DoubleType, T.FloatType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans: a flag column counts as numeric."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def numeric_columns(df: DataFrame, skip: Iterable[str | None] = ()) -> list[str]:
    """Names of the numeric columns, in table order."""
    left_out = set(skip)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in left_out]


def name(column: str) -> Column:
    """A reference to a top-level column, whatever characters its name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_double(column: str, dtype: T.DataType) -> Column:
    """Numeric column as a double (booleans as 0/1)."""
    c = name(column)
    return (c.cast("int") if isinstance(dtype, T.BooleanType) else c).cast("double")


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Make NaN and NULL one kind of missing value."""
    fields = [
        f for f in df.schema.fields
        if isinstance(f.dataType, FRACTIONAL) and (columns is None or f.name in columns)
    ]
    if not fields:
        return df
    return df.withColumns({
        f.name: F.nanvl(name(f.name), F.lit(None).cast(f.dataType)) for f in fields
    })


def group_value(column: str, dtype: T.DataType) -> Column:
    """The column in a form that groups like its values: NaN as NULL, no long texts.

    Texts beyond 64 characters go through SHA-256, so a distinct count never shuffles
    whole documents; nested values are compared as JSON.
    """
    c = name(column)
    if isinstance(dtype, FRACTIONAL):
        return F.nanvl(c, F.lit(None).cast(dtype))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        c = F.to_json(c)
    elif isinstance(dtype, T.BinaryType):
        c = F.hex(c)
    elif not isinstance(dtype, T.StringType):
        return c
    return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


VALUE_SLOTS = {"whole": "bigint", "number": "double", "text": "string", "time": "timestamp_ntz"}


def typed_value(column: str, dtype: T.DataType) -> Column:
    """A struct with the value in the slot of its kind, so columns of all types unpivot.

    Two structs are equal exactly when the values are; no number is turned into text.
    """
    c = group_value(column, dtype)
    if isinstance(dtype, T.BooleanType):
        slot, c = "whole", c.cast("int")
    elif isinstance(dtype, T.IntegralType):
        slot = "whole"
    elif isinstance(dtype, FRACTIONAL):
        slot = "number"
    elif isinstance(dtype, T.DateType):
        slot, c = "whole", F.unix_date(c)
    elif isinstance(dtype, T.TimestampType):
        slot, c = "whole", F.unix_micros(c)
    elif isinstance(dtype, T.TimestampNTZType):
        slot = "time"
    else:
        slot = "text"
    return F.struct(*[
        (c if k == slot else F.lit(None)).cast(t).alias(k) for k, t in VALUE_SLOTS.items()
    ])


def to_long(df: DataFrame, values: dict[str, Column], keep: Sequence[str] = (),
            name_as: str = "column", value_as: str = "value") -> DataFrame:
    """One row per (row, entry of ``values``); all entries share a type."""
    wide = df.select(*[name(k) for k in keep], *[c.alias(k) for k, c in values.items()])
    return wide.unpivot(
        [name(k) for k in keep], [name(k) for k in values], name_as, value_as
    )


def one_row_per(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per struct."""
    return df.select(F.inline(F.array(*structs)))


def settled(small: DataFrame) -> DataFrame:
    """A result of bounded size (per column, model or top-n) as a local table, so that
    several readers do not compute it again."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def python_list(items: Column) -> Column:
    """An array of strings in the notation ['a', 'b']."""
    return F.concat(F.lit("['"), F.concat_ws("', '", items), F.lit("']"))


def half_up(c: Column) -> Column:
    """Round to a whole number, ties upwards (toward plus infinity)."""
    return F.floor(c + F.lit(0.5))


def array_mean(numbers: Column) -> Column:
    """Mean of an array of doubles, added from left to right; NULL if it is empty."""
    return F.try_divide(F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x), F.size(numbers))
