"""Helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows as Parquet below the shared checkpoint folder and read them from there.

    Unlike a checkpoint, later readers scan only the columns they need. The files go when the
    session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, k: int) -> Column:
    """crc32 of the key as text, modulo ``k``; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % k


def texts(column: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(column, F.lit(""))


def utf8(series: pd.Series) -> Iterator[bytes]:
    """The UTF-8 bytes of every text of a batch; null gives none."""
    for value in series:
        yield b"" if value is None else value.encode("utf-8", "surrogatepass")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}{n}"
    return name


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; input columns of the same name give way."""
    clash = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in clash]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])
