"""Tables in: CSV, JSON, Parquet and in-memory frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import name, nan_to_null

# Texts that mean "no value" in CSV input.
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    rows: int | None = None,
    **options: Any,
) -> DataFrame:
    """CSV with a header. A schema saves the inference scan over the data.

    Columns left as text have the usual "no value" words turned into NULL; numeric columns
    that hold such words are cast once those words are gone. ``rows``: only the first rows, in the
    order of the files' names and of the lines in each file.
    """
    reader = spark.read.option("header", True).options(**options)
    if schema is not None:
        df = reader.option("mode", "PERMISSIVE").schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    if rows is not None:
        df = _first_lines(df, rows)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        df = df.withColumns({
            c: F.when(~name(c).isin(*NULL_TOKENS), name(c)) for c in texts
        })
        if schema is None:
            df = _numbers_with_gaps(df, texts)
    return nan_to_null(df)


def _first_lines(df: DataFrame, rows: int) -> DataFrame:
    """A top-n by file, block and line: every task keeps at most ``rows`` rows."""
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = df.select("*", *[F.col(p).alias(f"_at{i}") for i, p in enumerate(place)],
                      F.monotonically_increasing_id().alias("_line"))
    return lines.orderBy("_at0", "_at1", "_line").limit(rows).drop("_at0", "_at1", "_line")


def _numbers_with_gaps(df: DataFrame, texts: list[str]) -> DataFrame:
    """Cast text columns whose every known value is a number (one aggregate)."""
    readable = [
        F.bool_and(F.when(name(c).isNotNull(), name(c).try_cast("double").isNotNull())).alias(c)
        for c in texts
    ]
    found = df.agg(*readable).first()
    return df.withColumns({c: name(c).cast("double") for c in texts if found[c]})


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON records (one per line) with an explicit schema."""
    return nan_to_null(spark.read.schema(schema).json(path))


def from_json_column(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Records posted as JSON text, each an array of rows under ``history``."""
    body = f"history array<struct<{schema}>>" if isinstance(schema, str) else T.StructType(
        [T.StructField("history", T.ArrayType(schema))]
    )
    parsed = df.select(F.from_json(name(column), body).alias("body"))
    return nan_to_null(parsed.select(F.inline("body.history")))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return nan_to_null(spark.read.parquet(*([path] if isinstance(path, str) else path)))


def from_frame(df: DataFrame) -> DataFrame:
    """A frame as a source. Frames cannot change, so no copy is made."""
    return nan_to_null(df)
