"""Sentences and labels shown to the business user."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message texts and limits that users of the reference rely on.
INSIGHT_UP = "Demand trending UP ~%d%% — consider increasing inventory & staffing."
INSIGHT_DOWN = "Demand trending DOWN ~%d%% — consider reducing stock to avoid waste."
INSIGHT_STABLE = "Demand roughly stable — maintain current inventory levels."
INSIGHT_LIMIT = 0.05
STATUS_DRIFT = "DRIFT DETECTED — retraining recommended"
STATUS_HEALTHY = "HEALTHY — no significant drift"
STATUS_WAITING = "MONITORING — awaiting production data"
LABEL_LIMIT = 1.0


def insight(delta: Column) -> Column:
    percent = F.abs(F.bround(delta * 100, 0)).cast("bigint")
    return (
        F.when(delta > INSIGHT_LIMIT, F.format_string(INSIGHT_UP, percent))
        .when(delta < -INSIGHT_LIMIT, F.format_string(INSIGHT_DOWN, percent))
        .otherwise(F.lit(INSIGHT_STABLE))
    )


def trend_label(trend_pct: Column) -> Column:
    return (
        F.when(trend_pct > LABEL_LIMIT, "increasing")
        .when(trend_pct < -LABEL_LIMIT, "decreasing")
        .otherwise("stable")
    )


def stock_action(percent: Column) -> Column:
    """Advice for a whole-number percentage."""
    return (
        F.when(percent > LABEL_LIMIT, F.format_string("Increase %d%%", percent))
        .when(percent < -LABEL_LIMIT, F.format_string("Reduce %d%%", F.abs(percent)))
        .otherwise("Hold")
    )


def health_status(drifted: Column) -> Column:
    return (
        F.when(drifted, STATUS_DRIFT)
        .when(~drifted, STATUS_HEALTHY)
        .otherwise(STATUS_WAITING)
    )
