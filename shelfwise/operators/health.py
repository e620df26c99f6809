"""Model health: approved model, last training, metrics, drift and a status text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import health_status

DEFAULT_VERSION = "v1"
NO_DATA_NOTE = "no reference/current data"
NO_ROWS_NOTE = "no current rows to compare"
UNKNOWN_TIME = "unknown"


REPORT_FIELDS = {"detected": "dataset_drift", "share": "drift_share", "method": "method"}
EMPTY_REPORT = "struct<detected:boolean,share:double,method:string>"


def _summary(report: DataFrame | None) -> Column:
    """The one-row drift report as a struct value; NULL without a report."""
    if report is None:
        return F.lit(None).cast(EMPTY_REPORT)
    fields = [F.col(c).alias(k) for k, c in REPORT_FIELDS.items()]
    return report.select(F.struct(*fields)).scalar()


def health_report(
    run: DataFrame,
    data_drift: DataFrame | None = None,
    prediction_drift: DataFrame | None = None,
    last_retrain: str | None = None,
    error: str | None = None,
) -> DataFrame:
    """One-row report. ``run``: one row with best_model, metrics and maybe model_version.

    The drift inputs are one-row reports. ``rows_compared``: values of the column with the most
    values in the data report, if it says so; without any there is no verdict.
    """
    version = F.col("model_version") if "model_version" in run.columns else F.lit(None)
    out = run.select(
        F.col("best_model").alias("approved_model"),
        F.coalesce(version.cast("string"), F.lit(DEFAULT_VERSION)).alias("model_version"),
        F.lit(last_retrain or UNKNOWN_TIME).alias("last_retrain"),
        "metrics",
    )
    for prefix, report in (("data", data_drift), ("prediction", prediction_drift)):
        out = out.withColumn("_report", _summary(report))
        out = out.withColumns({
            f"{prefix}_drift_{k}": F.col(f"_report.{k}") for k in REPORT_FIELDS
        }).drop("_report")
    known = data_drift is not None and "n_compared" in data_drift.columns
    compared = data_drift.select("n_compared").scalar() if known else F.lit(None).cast("bigint")
    lacking = NO_DATA_NOTE if data_drift is None else NO_ROWS_NOTE
    note = F.when(F.col("data_drift_detected").isNull() & F.lit(error is None), lacking)
    return out.withColumns({
        "rows_compared": compared,
        "note": note,
        "drift_error": F.lit(error[:200] if error else None).cast("string"),
        "status": health_status(F.col("data_drift_detected")),
    })


def retrain_decision(report: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """One row: does the data call for a retrain? Without a reference it always does."""
    if report is None:
        base = spark.range(1).select(F.lit(None).cast("double").alias("drift_share"),
                                     F.lit(True).alias("drift"))
    else:
        base = report.select("drift_share", F.col("dataset_drift").alias("drift"))
    branch = F.when(F.col("drift"), "retrain_model").otherwise("skip_retrain")
    return base.withColumn("branch", branch)
