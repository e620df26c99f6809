"""Mergeable summaries: drift references and profiles that new rows extend without the old ones.

A summary is a small table, one row per column, with counts and a sketch. Summaries of parts (a day,
a run, a posted batch) are merged by adding their counts and merging their sketches; the parts'
rows are never read again. Quantiles come from KLL sketches: the rank of an edge is off by at most
about ``RANK_ERROR`` of the rows (for ``KLL_SIZE`` items). Distinct counts come from HyperLogLog with
a standard error of about ``DISTINCT_ERROR`` (exact for small counts).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import FRACTIONAL, as_double, group_value, name, one_row_per
from shelfwise.operators.drift import BINS, DriftReference
from shelfwise.operators.profile import DUPLICATES_TEXT, HEAVY_MISSING_SHARE, HIGH_CARDINALITY

KLL_SIZE = 4096
RANK_ERROR = 0.002
HLL_BITS = 14
DISTINCT_ERROR = 0.008


def _merged(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- drift references -----------------------------------------------------------------


def column_sketches(df: DataFrame, columns: Sequence[str], size: int = KLL_SIZE) -> DataFrame:
    """One row per column: n (known values), low, high and a sketch; one scan."""
    aggregates, structs = [], []
    for i, c in enumerate(columns):
        x = F.nanvl(as_double(c, df.schema[c].dataType), F.lit(None).cast("double"))
        aggregates += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                       F.kll_sketch_agg_double(x, size).alias(f"s{i}")]
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("low"),
            F.col(f"b{i}").alias("high"), F.col(f"s{i}").alias("sketch")))
    return one_row_per(df.agg(*aggregates), structs)


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of all parts as one row per column."""
    return _merged(parts).groupBy("column").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_reference(sketches: DataFrame, bins: int = BINS) -> DriftReference:
    """Edges and bin counts from merged sketches: as ``fit_reference``, within the stated error.

    The outer edges are the exact extremes; inner ones are values of the column. A bin's count is
    the difference of two ranks.
    """
    edges, counts = {}, {}
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = sketches.select("column", "n", "low", "high", F.when(
        F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", shares)).alias("q"), "sketch")
    rows = found.drop("sketch").collect()  # one row per column
    for r in rows:
        inner = {e for e in r["q"] or [] if r["low"] <= e <= r["high"]}
        edges[r["column"]] = sorted(inner | {r["low"], r["high"]}) if r["n"] else []
    # Ranks are asked for literals: one branch per column.
    asked = {c: [math.nextafter(x, -math.inf) for x in e[1:-1]] for c, e in edges.items() if len(e) > 2}
    found = [F.when(F.col("column") == c, F.kll_sketch_get_rank_double("sketch", F.array(*[F.lit(x) for x in below])))
             for c, below in asked.items()]
    ranks = sketches.select("column", "n", F.coalesce(*found, F.lit(None).cast("array<double>")).alias("ranks"))
    for r in ranks.collect():
        upto = [0, *[round(x * r["n"]) for x in r["ranks"] or []], r["n"]]
        many = max(len(edges[r["column"]]) - 1, 0)
        counts[r["column"]] = [b - a for a, b in zip(upto, upto[1:])][:many] if many else []
    order = [r["column"] for r in rows]
    return DriftReference({c: edges[c] for c in order}, {c: counts[c] for c in order})


# ---- profiles -------------------------------------------------------------------------


def _present(field: T.StructField) -> Column:
    known = name(field.name).isNotNull()
    return known & ~F.isnan(name(field.name)) if isinstance(field.dataType, FRACTIONAL) else known


def profile_state(df: DataFrame, bits: int = HLL_BITS) -> DataFrame:
    """One row per column (position, column, dtype, is_text, n_rows, missing, sketch of values), and
    one for whole rows (position -1). One scan; neither values nor rows are shuffled."""
    fields = df.schema.fields
    keys = [group_value(f.name, f.dataType) for f in fields]
    aggregates = [F.count(F.lit(1)).alias("n_rows"),
                  F.hll_sketch_agg(F.xxhash64(*[k for key in keys for k in (key, key.isNull())]), bits).alias("rows")]
    structs = [F.struct(F.lit(-1).alias("position"), F.lit(None).cast("string").alias("column"),
                        F.lit(None).cast("string").alias("dtype"), F.lit(False).alias("is_text"),
                        F.col("n_rows").alias("n_rows"), F.lit(0).cast("bigint").alias("missing"),
                        F.col("rows").alias("sketch"))]
    for i, (f, key) in enumerate(zip(fields, keys)):
        present = _present(f)
        aggregates += [F.count_if(~present).alias(f"m{i}"),
                       F.hll_sketch_agg(F.when(present, F.xxhash64(key)), bits).alias(f"s{i}")]
        structs.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(isinstance(f.dataType, T.StringType)).alias("is_text"),
            F.col("n_rows").alias("n_rows"), F.col(f"m{i}").alias("missing"), F.col(f"s{i}").alias("sketch")))
    return one_row_per(df.agg(*aggregates), structs)


def merge_states(*parts: DataFrame) -> DataFrame:
    """The state of all parts; their columns must be the same."""
    return _merged(parts).groupBy("position", "column", "dtype", "is_text").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("missing").alias("missing"),
        F.hll_union_agg("sketch").alias("sketch"))


def profile_of(
    state: DataFrame, high_cardinality: int = HIGH_CARDINALITY,
    heavy_missing_share: float = HEAVY_MISSING_SHARE,
) -> DataFrame:
    """One row per column, as ``profile_columns``; distinct counts are estimates."""
    distinct, missing = F.hll_sketch_estimate("sketch"), F.col("missing")
    return state.where("position >= 0").select(
        "position", "column", "dtype", "n_rows", distinct.alias("nunique"), "missing",
        (distinct + (missing > 0).cast("int") <= 1).alias("is_constant"),
        (F.col("is_text") & (distinct > high_cardinality)).alias("is_high_cardinality"),
        (missing > heavy_missing_share * F.col("n_rows")).alias("is_heavy_missing"))


def duplicates_of(state: DataFrame) -> DataFrame:
    """One row: n_rows, duplicate_rows (estimated) and a warning where they exceed the error."""
    n, copies = F.col("n_rows"), F.greatest(F.col("n_rows") - F.hll_sketch_estimate("sketch"), F.lit(0))
    sure = F.col("duplicate_rows") > 3 * DISTINCT_ERROR * n
    return state.where("position = -1").select("n_rows", copies.alias("duplicate_rows")).withColumn(
        "warning", F.when(sure, F.concat(F.lit("About "), F.col("duplicate_rows").cast("string"), F.lit(DUPLICATES_TEXT))))
