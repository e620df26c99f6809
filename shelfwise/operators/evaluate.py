"""Forecast errors, the choice of the best model and its promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: added to the actual value in the relative error.
RELATIVE_EPSILON = 1e-6
METRICS = ("mae", "rmse", "rmspe")


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE, and RMSPE over positive actuals (NULL if there are none)."""
    error = actual - predicted
    relative = error / (actual + F.lit(RELATIVE_EPSILON))
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "rmspe": F.sqrt(F.avg(F.when(actual > 0, relative * relative))),
    }


def forecast_metrics(scored: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Metrics per model from long rows with ``y`` and ``p``."""
    metrics = error_metrics(F.col("y"), F.col("p"))
    return scored.groupBy(*by).agg(*[m.alias(k) for k, m in metrics.items()])


def scored_long(windows: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """One row per (model, window, step): ``y`` from ``future``, ``p`` from the model's array.

    All models are scored in the same pass over the windows.
    """
    models = F.array(*[
        F.struct(F.lit(m).alias("model_name"), c.alias("prediction"))
        for m, c in predictions.items()
    ])
    per_model = windows.select("future", F.inline(models))
    pairs = F.arrays_zip(F.col("future").alias("y"), F.col("prediction").alias("p"))
    return per_model.select("model_name", F.posexplode(pairs).alias("_at", "_pair")).select(
        "model_name", (F.col("_at") + 1).alias("step"), "_pair.y", "_pair.p"
    )


def rescored(
    test: DataFrame, rival: DataFrame, keys: Sequence[str], own: str = "_challenger"
) -> DataFrame:
    """Metrics of two models over the windows both predicted: `champion` and `challenger`.

    ``test``: keys, ``future`` and the challenger's array ``own``; ``rival``: keys and the
    champion's array ``prediction``. Both are scored in one pass over the joined windows, on the
    steps that both predict. A model without a common window has no row.
    """
    places = [F.col(f"`{c}`").cast(test.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(keys)]
    asked = rival.select(*places, F.col("prediction").alias("_champion"))
    same = [test[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    both = test.join(asked, same).select("future", own, "_champion")
    steps = F.least(F.size(own), F.size("_champion"), F.size("future"))
    cut = both.select(*[F.slice(c, F.lit(1), steps).alias(c) for c in both.columns])
    return forecast_metrics(scored_long(
        cut, {"champion": F.col("_champion"), "challenger": F.col(own)}))


def select_best(
    metrics: DataFrame, metric: str = "rmspe", order: Sequence[str] | None = None
) -> DataFrame:
    """The model with the least metric (one row).

    Models without the metric are skipped; if none has it, RMSE decides. Ties go to the
    first in ``order`` (by name if not given).
    """
    rank: Column = F.col("model_name")
    if order is not None:
        rank = F.coalesce(
            F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_name")), F.lit(0)
        )

    def least(name: str) -> Column:
        value = F.nanvl(F.col(name), F.lit(None).cast("double"))
        return F.min_by("model_name", F.when(value.isNotNull(), F.struct(value, rank)))

    return metrics.agg(
        F.coalesce(least(metric), least("rmse")).alias("best_model"),
        F.when(least(metric).isNotNull(), metric).otherwise("rmse").alias("selected_by"),
    )


def promote_champion(runs: DataFrame, metric: str = "rmspe") -> DataFrame:
    """Compare the newest run with the approved one (one row).

    ``runs``: run_time, model_name, approved and the metrics. The challenger wins only if
    it is better; without a champion it always wins.
    """
    value = F.nanvl(F.col(metric), F.lit(None).cast("double"))
    approved = F.col("approved")
    when = F.col("run_time")
    picked = runs.agg(
        F.max_by(F.when(approved, F.col("model_name")), F.when(approved, when)).alias("champion"),
        F.max_by(F.when(approved, value), F.when(approved, when)).alias("champion_metric"),
        F.max_by(F.when(~approved, F.col("model_name")), F.when(~approved, when)).alias("challenger"),
        F.max_by(F.when(~approved, value), F.when(~approved, when)).alias("challenger_metric"),
    )
    better = F.coalesce(
        F.col("challenger_metric") < F.col("champion_metric"),
        F.col("champion_metric").isNull() & F.col("challenger_metric").isNotNull(),
    )
    promoted = F.col("challenger").isNotNull() & (F.col("champion").isNull() | better)
    return picked.withColumn("promoted", promoted).withColumn(
        "approved_model", F.when(promoted, F.col("challenger")).otherwise(F.col("champion"))
    )
