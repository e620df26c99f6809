"""Serving: stored state and fresh history in, forecasts of all series out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators import forecast as ops
from shelfwise.operators.ordering import AUTO, Layout
from shelfwise.operators.prep import Preprocessor
from shelfwise.sources import state


class Forecaster:
    """The approved model with everything it needs to serve."""

    def __init__(self, spark: SparkSession, path: str, anchor: str = "next", step_days: int = 1):
        run = state.current_run(spark, path)
        if run is None:
            raise ValueError(f"no run found below {path}")
        self.best = run["best_model"]
        self.horizon, self.lookback = run["horizon"], run["lookback"]
        self.features = list(run["feature_columns"])
        self.run = run
        self.preprocessor: Preprocessor = state.load_preprocessor(
            spark, f"{state.run_folder(run, path)}/preprocessor")
        self.model = state.load_model(spark, run["model_path"])
        self.anchor, self.step_days = anchor, step_days

    def inputs(self, history: DataFrame, layout: Layout = AUTO) -> DataFrame:
        """The window per series that the model is asked about."""
        prepared = state.engineered(history, self.preprocessor, self.run)
        lags, rolls = state.lags_and_rolls(self.run)
        return ops.forecast_inputs(
            prepared, self.preprocessor.state.roles, self.features, self.lookback, self.horizon,
            self.anchor, lags, rolls, step_days=self.step_days,
            sequence=self.model.needs_sequence, layout=layout,
        )

    def rows(self, history: DataFrame, layout: Layout = AUTO) -> DataFrame:
        """One row per (series, step): date and forecast, with the recent average.

        Series without enough history for a window give no rows.
        """
        predicted = self.model.predict(self.inputs(history, layout))
        return ops.forecast_rows(predicted, self.preprocessor.state.roles, self.step_days)

    def unserved(self, history: DataFrame, layout: Layout = AUTO) -> DataFrame:
        """Series of the history with too little of it for a forecast."""
        roles = self.preprocessor.state.roles
        if roles.series is None:
            raise ValueError("the run has no series column")
        served = self.inputs(history, layout).select(roles.series)
        return history.select(roles.series).distinct().join(served, roles.series, "left_anti")

    def forecast(self, history: DataFrame, layout: Layout = AUTO) -> DataFrame:
        """One document per series."""
        roles = self.preprocessor.state.roles
        return ops.forecast_document(self.rows(history, layout), roles, self.best)
