"""Population stability index: how far current data moved away from a reference.

The reference is summarised once (``fit_reference``): bin edges and counts per column, at
most eleven numbers each. Checking current data is then one scan with partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import as_double, is_numeric, name, to_long
from shelfwise.operators.ordering import positions_by_sort
from shelfwise.operators.quantiles import SMALL_ROWS, exact_quantiles

# Number of bins, limits and the floor of a share.
BINS = 10
PSI_LIMIT = 0.25
DRIFT_SHARE = 0.4
SHARE_FLOOR = 1e-6

REFERENCE_SCHEMA = "column string, edges array<double>, counts array<long>, n_values long"


def shared_numeric(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of both tables that are numeric in the reference."""
    there = set(current.columns)
    return [
        f.name for f in reference.schema.fields if f.name in there and is_numeric(f.dataType)
    ]


def psi_edges(
    reference: DataFrame, columns: Sequence[str], bins: int = BINS, small_rows: int = SMALL_ROWS,
    exact: bool = True,
) -> dict[str, list[float]]:
    """Distinct quantile edges per column, in order; empty without values.

    ``exact=False`` takes them from a sketch of one scan; they are then values of the column.
    """
    shares = [i / bins for i in range(bins + 1)]
    if exact:
        found = exact_quantiles(reference, columns, shares, small_rows)
    else:
        sketches = [F.percentile_approx(_number(reference, c), shares).alias(f"q{i}")
                    for i, c in enumerate(columns)]
        row = reference.agg(*sketches).first() if sketches else ()
        found = {c: row[i] or [] for i, c in enumerate(columns)}
    return {c: sorted({e for e in q if e is not None}) for c, q in found.items()}


def _number(df: DataFrame, column: str) -> Column:
    """The column as DOUBLE, NaN as NULL."""
    return F.nanvl(as_double(column, df.schema[column].dataType), F.lit(None).cast("double"))


def edges_frame(spark: SparkSession, edges: dict[str, list[float]]) -> DataFrame:
    rows = [(c, i, e) for c, es in edges.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "column string, edge int, value double")


def _bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin of a value: 0..k-1, the last one closed on both sides, -1 out of range.

    A sum of comparisons with literals: stays inside generated code, no join.
    """
    if len(edges) < 2:
        return F.when(x.isNotNull(), F.lit(-1))
    passed = sum((x >= F.lit(e)).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0)
    inside = x.between(F.lit(edges[0]), F.lit(edges[-1]))
    return F.when(inside, passed).when(x.isNotNull(), F.lit(-1)).cast("int")


def histogram(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Rows per (column, bin); bin -1 counts values outside the edges."""
    bins = {c: _bin(_number(df, c), e) for c, e in edges.items()}
    return (
        to_long(df, bins, value_as="bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class DriftReference:
    """Edges and bin counts of the reference, per column."""

    edges: dict[str, list[float]]
    counts: dict[str, list[int]]

    @property
    def columns(self) -> list[str]:
        return list(self.edges)

    def only(self, columns: Sequence[str]) -> DriftReference:
        kept = [c for c in self.columns if c in set(columns)]
        return DriftReference({c: self.edges[c] for c in kept}, {c: self.counts[c] for c in kept})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.edges[c], self.counts[c], sum(self.counts[c])) for c in self.columns]
        return spark.createDataFrame(rows, REFERENCE_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> DriftReference:
        rows = df.collect()  # one row per column
        return DriftReference(
            {r["column"]: list(r["edges"]) for r in rows},
            {r["column"]: list(r["counts"]) for r in rows},
        )


def fit_reference(
    reference: DataFrame, columns: Sequence[str], bins: int = BINS, small_rows: int = SMALL_ROWS,
    exact: bool = True,
) -> DriftReference:
    """Summarise the reference distribution of the columns."""
    edges = psi_edges(reference, columns, bins, small_rows, exact)
    counts = {c: [0] * max(len(e) - 1, 0) for c, e in edges.items()}
    for r in histogram(reference, edges).collect() if edges else []:  # columns x bins rows
        if r["bin"] >= 0:
            counts[r["column"]][r["bin"]] = r["n"]
    return DriftReference(edges, counts)


def column_psi(reference: DriftReference, current: DataFrame) -> DataFrame:
    """Unrounded PSI per column, with the number of current values and of those out of range.

    Every bin takes part, empty ones included. A column with fewer than two edges, or
    without values on one side, scores 0.
    """
    spark = current.sparkSession
    bins = [
        (c, b, n)
        for c in reference.columns
        for b, n in [(-1, 0), *enumerate(reference.counts[c])]
    ]
    wanted = spark.createDataFrame(bins, "column string, bin int, ref_n long")
    # Both sides have at most eleven rows per column.
    table = wanted.join(F.broadcast(histogram(current, reference.edges)), ["column", "bin"], "left")
    in_range = F.col("bin") >= 0
    n = F.coalesce("n", F.lit(0))
    table = table.select("column", "bin", "ref_n", n.alias("cur_n"))
    totals = table.groupBy("column").agg(
        F.sum(F.when(in_range, F.col("ref_n")).otherwise(0)).alias("ref_total"),
        F.sum(F.when(in_range, F.col("cur_n")).otherwise(0)).alias("cur_total"),
        F.sum(F.when(~in_range, F.col("cur_n")).otherwise(0)).alias("n_out_of_range"),
    )

    def share(count: str, total: str) -> Column:
        return F.greatest(
            F.col(count) / F.greatest(F.col(total), F.lit(1)), F.lit(SHARE_FLOOR)
        )

    ref, cur = share("ref_n", "ref_total"), share("cur_n", "cur_total")
    term = F.when(in_range, (cur - ref) * F.ln(cur / ref)).otherwise(0.0)
    scored = (
        table.join(F.broadcast(totals), "column")
        .groupBy("column", "n_out_of_range", "ref_total", "cur_total")
        .agg(F.sum(term).alias("score"))
    )
    empty = (F.col("ref_total") == 0) | (F.col("cur_total") + F.col("n_out_of_range") == 0)
    return scored.select(
        "column", F.when(empty, 0.0).otherwise(F.col("score")).alias("score"), "n_out_of_range",
        (F.col("cur_total") + F.col("n_out_of_range")).alias("n_values"),
    )


def column_verdicts(scores: DataFrame, psi_limit: float = PSI_LIMIT) -> DataFrame:
    """Rounded score and drift flag per column; the flag uses the unrounded score."""
    return scores.select(
        "column",
        F.bround("score", 4).alias("psi"),
        (F.col("score") > psi_limit).alias("drifted"),
        "n_out_of_range",
        *(["n_values"] if "n_values" in scores.columns else []),
    )


def dataset_verdict(
    verdicts: DataFrame, drift_share: float = DRIFT_SHARE, method: str = "psi"
) -> DataFrame:
    """One-row report from any table of (column, psi, drifted) and maybe n_values.

    With ``n_values``, the verdict is null where no column has a value to compare: no data is
    no sign of health.
    """
    n = F.count(F.lit(1))
    drifted = F.count_if("drifted")
    columns = F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("column", F.struct("psi", "drifted"))
    )))
    share = drifted / F.greatest(n, F.lit(1))
    verdict, compared = share >= drift_share, []
    if "n_values" in verdicts.columns:
        most = F.coalesce(F.max("n_values"), F.lit(0).cast("bigint"))
        verdict, compared = F.when(most > 0, verdict), [most.alias("n_compared")]
    return verdicts.agg(
        F.lit(method).alias("method"),
        F.greatest(n, F.lit(1)).alias("n_columns"),
        drifted.alias("n_drifted"),
        F.bround(share, 3).alias("drift_share"),
        verdict.alias("dataset_drift"),
        *compared,
        columns.alias("columns"),
    )


def check_drift(
    reference: DataFrame | DriftReference,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    psi_limit: float = PSI_LIMIT,
    drift_share: float = DRIFT_SHARE,
) -> DataFrame:
    """Full report for the shared numeric columns (or for ``columns``)."""
    return dataset_verdict(
        drift_columns(reference, current, columns, psi_limit), drift_share
    )


def drift_columns(
    reference: DataFrame | DriftReference,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    psi_limit: float = PSI_LIMIT,
) -> DataFrame:
    """Per-column verdicts; only the compared columns are read."""
    if isinstance(reference, DriftReference):
        shared = [c for c in reference.columns if c in set(current.columns)]
        chosen = [c for c in columns or shared if c in shared]
        fitted = reference.only(chosen)
    else:
        chosen = list(columns or shared_numeric(reference, current))
        fitted = fit_reference(reference.select(*chosen), chosen)
    return column_verdicts(column_psi(fitted, current), psi_limit)


def bootstrap(df: DataFrame, seed: int = 42) -> DataFrame:
    """Resample with replacement: as many rows as there are, each draw any row alike.

    Rows get a place 0..n-1 from a global sort by their hashes. The n draws are hashes of the numbers
    0..n-1 and the seed, modulo n; counted per place, they say how often each row is taken. So
    the same seed gives the same rows, however the table is partitioned, and equal rows, even very
    many, are spread like others.
    """
    n = df.count()
    if not n:
        return df
    values = [name(c) if not isinstance(t, T.MapType) else F.to_json(name(c))
              for c, t in ((f.name, f.dataType) for f in df.schema.fields)]
    keyed = df.withColumns({"_a": F.xxhash64(*values), "_b": F.hash(*values), "_all": F.lit(0),
                            "_c": F.monotonically_increasing_id()})
    order = [F.col("_a"), F.col("_b"), F.col("_c")]  # the last only spreads equal rows
    placed = positions_by_sort(keyed, ["_all"], order, "_place", "_n")
    draws = df.sparkSession.range(n).select(
        F.pmod(F.xxhash64("id", F.lit(seed).cast("bigint")), F.lit(n)).alias("_place"))
    times = draws.groupBy("_place").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    taken = placed.join(times, "_place").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return taken.select(*[name(c) for c in df.columns])
