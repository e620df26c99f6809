"""The approved model, scored again on the data that a challenger is tested on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import evaluate
from shelfwise.operators.features import feature_frame
from shelfwise.operators.models import AnyModel
from shelfwise.operators.ordering import AUTO, Layout
from shelfwise.operators.prep import Preprocessor
from shelfwise.operators.windows import sliding_windows
from shelfwise.sources import state


@dataclass(frozen=True)
class Champion:
    """A stored run with everything it needs to be asked about other data."""

    run: Row
    preprocessor: Preprocessor
    model: AnyModel

    def predictions(self, raw: DataFrame, layout: Layout = AUTO) -> DataFrame:
        """series, date (and tie-break columns) and ``prediction`` of every window of the rows,
        prepared and engineered by the run's own settings."""
        roles = self.preprocessor.state.roles
        lags, rolls = state.lags_and_rolls(self.run)
        frame = feature_frame(
            state.engineered(raw, self.preprocessor, self.run), roles, lags, rolls, layout)
        windows = sliding_windows(
            frame, roles, self.run["lookback"], self.run["horizon"],
            list(self.run["feature_columns"]), self.model.needs_sequence, layout)
        keys = [F.col(f"`{c}`") for c in (*roles.keys, *roles.tiebreak)]
        return self.model.predict(windows).select(*keys, "prediction")


def load_champion(spark: SparkSession, path: str) -> Champion | None:
    """The approved run, or None before the first one."""
    run = state.current_run(spark, path)
    if run is None:
        return None
    pre = state.load_preprocessor(spark, f"{state.run_folder(run, path)}/preprocessor")
    return Champion(run, pre, state.load_model(spark, run["model_path"]))


def duel(
    test: DataFrame, challenger: AnyModel, champion: Champion, raw: DataFrame,
    layout: Layout = AUTO,
) -> DataFrame:
    """Metrics of ``champion`` and ``challenger`` on the test windows that both can be asked about.

    ``test``: the challenger's test windows; ``raw``: the rows they were made from. The champion's
    windows are found by series and date: lookback, lags and features may differ.
    """
    own = challenger.predict(test, "_challenger")
    roles = champion.preprocessor.state.roles
    keys = [*roles.keys, *roles.tiebreak]
    rival = champion.predictions(raw, layout)
    return evaluate.rescored(own, rival, keys)
