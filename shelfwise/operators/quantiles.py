"""Exact quantiles of many columns in a fixed number of scans, without bringing a column together.

Up to ``SMALL_ROWS`` values per column, Spark's exact ``percentile`` does it: its buffer is
then bounded. With more, ranks are found by radix selection: doubles become 64-bit numbers in the
same order (their sign, exponent and mantissa), a scan counts the values per leading digit, and the
next one looks only into the bins that hold a wanted rank, one digit further. A digit has
``DIGIT_BITS`` bits, so no table ever has more than 2^13 bins per wanted rank, however the values lie
and however often one repeats. Five scans reach the last bit; a bin with one
value is settled, and once no bin in question holds more values than a table has bins, the next scan is the last.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.columns import as_double, name, to_long

SMALL_ROWS = 200_000
DIGIT_BITS = 13
#: Bits below the first digit (sign and exponent), and of a double's mantissa.
MANTISSA = 52


@dataclass(frozen=True)
class _Bin:
    """``inside`` values of a column share the leading digits ``prefix`` (bits from ``shift`` on),
    ``below`` are smaller; the 0-based ``ranks`` are wanted from it. Its keys lie in [low, high]."""

    column: str
    prefix: int
    below: int
    inside: int
    ranks: list[int]
    low: int = 0
    high: int = -1


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, NaN as NULL."""
    none = F.lit(None).cast("double")
    return df.select(*[
        F.nanvl(as_double(c, df.schema[c].dataType), none).alias(c) for c in columns
    ])


def _guess(x: Column) -> Column:
    """The binary exponent of a normal number, or one off where the logarithm rounds."""
    return F.greatest(F.least(F.floor(F.log2(F.abs(x))), F.lit(1023)), F.lit(-1022))


def _ratio(x: Column, guess: Column) -> Column:
    return F.abs(x) / F.pow(F.lit(2.0), guess.cast("double"))


def _key(x: Column, guess: Column, ratio: Column) -> Column:
    a = F.abs(x)
    exponent = F.when(ratio < 1, guess - 1).when(ratio >= 2, guess + 1).otherwise(guess)
    mantissa = F.when(ratio < 1, ratio * 2).when(ratio >= 2, ratio / 2).otherwise(ratio)
    one, half = F.lit(float(1 << MANTISSA)), F.lit(2.0**537)
    normal = F.shiftleft((exponent + 1023).cast("bigint"), MANTISSA) + ((mantissa - 1) * one).cast("bigint")
    bits = (
        F.when(a == 0, F.lit(0))
        .when(a == F.lit(math.inf), F.lit(2047 << MANTISSA))
        .when(a < F.lit(2.0**-1022), (a * half * half).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(x < 0, -bits).otherwise(bits)


def order_keys(numbers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as BIGINTs in the order of the doubles: the bits of |x|, negative for x < 0.

    Plain arithmetic, exact throughout. It goes in steps, each a projection of its own, so that
    what a step uses several times is computed once.
    """
    many = range(len(columns))
    x, g, r = ([F.col(f"{k}{i}") for i in many] for k in "xgr")
    first = numbers.select(*[name(c).alias(f"x{i}") for i, c in enumerate(columns)])
    second = first.select(*x, *[_guess(x[i]).alias(f"g{i}") for i in many])
    third = second.select(*x, *g, *[_ratio(x[i], g[i]).alias(f"r{i}") for i in many])
    return third.select(*[_key(x[i], g[i], r[i]).alias(c) for i, c in enumerate(columns)])


def value_of(key: int) -> float:
    """The double with that order key."""
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


def _narrowed(keys: DataFrame, bins: list[_Bin], shift: int, further: int) -> list[_Bin]:
    """One scan: the bins of ``further`` remaining bits that hold the wanted ranks."""
    step = shift - further
    kept = {}
    for column in dict.fromkeys(b.column for b in bins):
        key = name(column)
        inside = F.shiftright(key, shift).isin([b.prefix for b in bins if b.column == column])
        kept[column] = F.when(inside, key) if shift < 64 else key
    counted = (
        to_long(keys, kept)
        .where(F.col("value").isNotNull())
        .groupBy("column", F.shiftright("value", further).alias("digits"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    parent = F.shiftright("digits", step) if shift < 64 else F.lit(0).cast("bigint")
    # One row per bin in question: bounded by columns x wanted quantiles.
    limits = keys.sparkSession.createDataFrame(
        [(b.column, b.prefix, b.below, b.ranks) for b in bins],
        "column string, prefix bigint, below bigint, ranks array<bigint>",
    )
    placed = (
        counted.withColumn("prefix", parent)
        .join(F.broadcast(limits), ["column", "prefix"])
        .withColumn("upto", F.col("below") + F.sum("n").over(
            W.partitionBy("column", "prefix").orderBy("digits")
        ))
        .withColumn("start", F.col("upto") - F.col("n"))
    )
    hits = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("upto")))
    found = placed.select("column", "digits", "start", "n", "low", "high", hits.alias("hits")).where(F.size("hits") > 0)
    return [_Bin(r["column"], r["digits"], r["start"], r["n"], list(r["hits"]), r["low"], r["high"])
            for r in found.collect()]


def values_at_ranks(numbers: DataFrame, wanted: dict[str, Sequence[int]], sizes: dict[str, int],
                    digit_bits: int = DIGIT_BITS) -> dict[tuple[str, int], float]:
    """The value at every wanted (column, 0-based rank)."""
    bins = [_Bin(c, 0, 0, sizes[c], sorted(set(ranks))) for c, ranks in wanted.items()]
    keys, shift, further = order_keys(numbers, list(wanted)), 64, MANTISSA
    settled: list[_Bin] = []
    while bins:
        bins = _narrowed(keys, bins, shift, further)
        settled += [b for b in bins if b.low == b.high]  # one value, however often
        bins = [b for b in bins if b.low < b.high]
        shift = further
        few = max((b.inside for b in bins), default=0) <= 1 << digit_bits
        further = 0 if few else max(0, shift - digit_bits)
    return {(b.column, r): value_of(b.low) for b in settled for r in b.ranks}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    small_rows: int = SMALL_ROWS,
    sizes: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, missing values left out.

    The result has columns x probabilities numbers, so it comes to the driver; a column
    without any value gives ``None`` throughout. ``sizes`` (known values per column) saves
    the counting scan.
    """
    if not columns:
        return {}
    numbers = _numbers(df, columns)
    size = sizes or numbers.agg(*[F.count(name(c)).alias(c) for c in columns]).first()
    small = [c for c in columns if 0 < size[c] <= small_rows]
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if small:
        row = numbers.agg(*[F.percentile(name(c), wanted).alias(c) for c in small]).first()
        result.update({c: list(row[c]) for c in small})

    places = {c: [p * (size[c] - 1) for p in probabilities] for c in columns if size[c] > small_rows}
    ranks = {c: [r for p in at for r in (math.floor(p), math.ceil(p))] for c, at in places.items()}
    values = values_at_ranks(numbers, ranks, {c: size[c] for c in places}) if places else {}

    def at(column: str, place: float) -> float:
        first, last = values[column, math.floor(place)], values[column, math.ceil(place)]
        share = place - math.floor(place)
        return first if first == last else (1 - share) * first + share * last

    return {**result, **{c: [at(c, p) for p in ps] for c, ps in places.items()}}
