"""Direct multi-step forecasters: boosted trees, MLlib regressors, baselines in SQL functions.

Every candidate gives an array with one predicted value per step. The boosted trees grow the trees
of all steps together, and ridge regression solves all steps from one Gram matrix; MLlib candidates fit one regressor per step, and users add their own by
passing any ``pyspark.ml`` regressor.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import array_mean
from shelfwise.operators import boosting, linear
from shelfwise.session import ensure_checkpoint_dir

# Default size of the boosted trees; weekday factors of the simple baseline.
GBT_DEFAULTS = {
    "maxIter": 300,
    "maxDepth": 6,
    "stepSize": 0.05,
    "subsamplingRate": 0.9,
    "featureSubsetStrategy": "0.9",
}
SUNDAY_FACTOR = 0.3
FRIDAY_SATURDAY_FACTOR = 0.8

#: Training rows a task takes at least: boosting starts thousands of short jobs.
ROWS_PER_TASK = 50_000

RIDGE_DEFAULTS = {"regParam": 0.1, "elasticNetParam": 0.0, "maxIter": 100}


def boosted_trees(**params: Any) -> GBTRegressor:
    """MLlib's tree regressor in the same size; ``params`` override it."""
    settings = {"seed": 42, "checkpointInterval": 10, **GBT_DEFAULTS, **params}
    return GBTRegressor(featuresCol="features", labelCol="label", **settings)


def ridge(**params: Any) -> LinearRegression:
    return LinearRegression(
        featuresCol="features", labelCol="label", **{**RIDGE_DEFAULTS, **params}
    )


def tabular_input() -> Column:
    """Lookback and current features as one vector."""
    return array_to_vector(F.col("tabular"))


def sequence_input() -> Column:
    """All lookback rows (target and features), flattened in time order."""
    return array_to_vector(F.flatten("steps"))


def input_vector(inputs: Callable[[], Column] | str) -> Column:
    """A function's column, or a SQL expression of an array of doubles as a vector."""
    return array_to_vector(F.expr(inputs)) if isinstance(inputs, str) else inputs()


@dataclass(frozen=True)
class DirectForecaster:
    """One regressor per forecast step, fitted side by side.

    ``estimator`` makes a fresh regressor; ``inputs`` builds its feature vector: one of the
    two functions above, or a SQL expression (an array of doubles), which can be stored.
    Inputs may also be computed for incomplete windows that are dropped afterwards.
    """

    name: str
    estimator: Callable[[], Estimator]
    inputs: Callable[[], Column] | str = tabular_input
    needs_sequence: bool = False
    parallel_fits: int = 7

    def fit(self, windows: DataFrame, horizon: int) -> DirectModel:
        """Fit on the ``future`` array of ``windows``; the vectors are kept while fitting."""
        ensure_checkpoint_dir(windows.sparkSession)  # boosting cuts its lineage there
        labels = [F.col("future")[h].alias(f"y{h}") for h in range(horizon)]
        kept = windows.select(input_vector(self.inputs).alias("features"), *labels)
        kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
        data = kept.coalesce(max(1, -(-kept.count() // ROWS_PER_TASK)))

        def fit_step(h: int) -> Model:
            return self.estimator().fit(data.select("features", F.col(f"y{h}").alias("label")))

        try:
            with ThreadPoolExecutor(self.parallel_fits) as pool:
                steps = list(pool.map(fit_step, range(horizon)))
        finally:
            kept.unpersist()
        return DirectModel(self.name, steps, self.inputs, self.needs_sequence)


@dataclass(frozen=True)
class DirectModel:
    """Fitted steps; ``predict`` adds an array column (clipped only when served)."""

    name: str
    steps: list[Model] = field(default_factory=list)
    inputs: Callable[[], Column] | str = tabular_input
    needs_sequence: bool = False

    @property
    def horizon(self) -> int:
        return len(self.steps)

    def predict(self, windows: DataFrame, into: str = "prediction") -> DataFrame:
        kept = windows.columns
        out = windows.withColumn("features", input_vector(self.inputs))
        for h, model in enumerate(self.steps):
            out = model.setPredictionCol(f"_p{h}").transform(out)
        values = F.array(*[F.col(f"_p{h}") for h in range(self.horizon)])
        return out.select(*kept, values.alias(into))


# MLlib's names of the settings of boosted trees.
MLLIB_NAMES = {
    "maxIter": "trees", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "rows",
    "featureSubsetStrategy": "columns", "maxBins": "bins", "minInstancesPerNode": "least_rows",
    "seed": "seed",
}


@dataclass(frozen=True)
class BoostedForecaster:
    """Boosted trees of all steps, grown together over shared histograms.

    ``inputs``: a SQL expression of an array of doubles over the windows.
    """

    name: str = "gbt"
    size: boosting.TreeSize = boosting.TreeSize()
    inputs: str = "tabular"
    needs_sequence: bool = False

    def fit(self, windows: DataFrame, horizon: int) -> BoostedModel:
        data = windows.select(
            F.expr(self.inputs).alias("features"), F.slice("future", 1, horizon).alias("future"))
        return BoostedModel(self.name, boosting.fit_trees(data, size=self.size), self.inputs)


@dataclass(frozen=True)
class BoostedModel:
    name: str
    ensemble: boosting.Ensemble
    inputs: str = "tabular"
    needs_sequence: bool = False

    @property
    def horizon(self) -> int:
        return self.ensemble.steps

    def predict(self, windows: DataFrame, into: str = "prediction") -> DataFrame:
        return windows.withColumn(into, boosting.predicted(self.ensemble, F.expr(self.inputs)))


def gbt_candidate(**params: Any) -> BoostedForecaster:
    """The default trees; ``params`` override their size, by our names or MLlib's."""
    named = {MLLIB_NAMES.get(k, k): v for k, v in params.items()}
    return BoostedForecaster(size=boosting.TreeSize(**named))


def mllib_gbt_candidate(**params: Any) -> DirectForecaster:
    """One chain of MLlib's boosted trees per step."""
    return DirectForecaster("mllib_gbt", lambda: boosted_trees(**params))


#: All lookback rows (target and features), flattened in time order, as SQL.
SEQUENCE = "flatten(steps)"


@dataclass(frozen=True)
class LinearForecaster:
    """Ridge regression of all steps from one Gram matrix.

    ``inputs``: a SQL expression of an array of doubles over the windows.
    """

    name: str = "ridge"
    penalty: float = RIDGE_DEFAULTS["regParam"]
    inputs: str = SEQUENCE
    needs_sequence: bool = True

    def fit(self, windows: DataFrame, horizon: int) -> LinearModel:
        data = windows.select(
            F.expr(self.inputs).alias("features"), F.slice("future", 1, horizon).alias("future"))
        lines = linear.fit_lines(data, penalty=self.penalty)
        return LinearModel(self.name, lines, self.inputs, self.needs_sequence)


@dataclass(frozen=True)
class LinearModel:
    name: str
    lines: linear.Lines
    inputs: str = SEQUENCE
    needs_sequence: bool = True

    @property
    def horizon(self) -> int:
        return self.lines.steps

    def predict(self, windows: DataFrame, into: str = "prediction") -> DataFrame:
        return windows.withColumn(into, linear.predicted(self.lines, F.expr(self.inputs)))


def ridge_candidate(regParam: float = RIDGE_DEFAULTS["regParam"]) -> LinearForecaster:
    """The sequence-window candidate: ridge regression over every lookback row."""
    return LinearForecaster(penalty=regParam)


def mllib_ridge_candidate(**params: Any) -> DirectForecaster:
    """The same with one MLlib regressor per step."""
    return DirectForecaster("mllib_ridge", lambda: ridge(**params), sequence_input, True)


def default_candidates() -> list[BoostedForecaster | LinearForecaster]:
    return [gbt_candidate(), ridge_candidate()]


def moving_average(horizon: int) -> Column:
    """Repeat the mean of the lookback for every step."""
    return F.array_repeat(array_mean(F.col("past")), horizon)


def weekday_factor(date: Column) -> Column:
    day = F.weekday(date)  # Monday 0
    return (
        F.when(day == 6, SUNDAY_FACTOR)
        .when(day.isin(4, 5), FRIDAY_SATURDAY_FACTOR)
        .otherwise(1.0)
    )


def weekday_baseline(date: str, horizon: int) -> Column:
    """Mean of the lookback times a weekday factor, for the dates from the window on.

    The dates follow the calendar, as in serving; the window's rows may have gaps.
    """
    day, mean = F.col(date).cast("date"), array_mean(F.col("past"))
    return F.array(*[
        F.greatest(mean * weekday_factor(F.date_add(day, h)), F.lit(0.0)) for h in range(horizon)
    ])


@dataclass(frozen=True)
class BaselineForecaster:
    """A baseline as a candidate: there is nothing to fit, but it is selected, stored and served
    like a model. ``name``: moving_average or weekday (which needs the ``date`` column)."""

    name: str = "moving_average"
    date: str | None = None
    needs_sequence: bool = False

    def fit(self, windows: DataFrame, horizon: int) -> BaselineModel:
        return BaselineModel(self.name, self.date, horizon)


@dataclass(frozen=True)
class BaselineModel:
    name: str
    date: str | None
    horizon: int
    needs_sequence: bool = False

    def predict(self, windows: DataFrame, into: str = "prediction") -> DataFrame:
        if self.name == "moving_average":
            return windows.withColumn(into, moving_average(self.horizon))
        if self.name == "weekday" and self.date:
            return windows.withColumn(into, weekday_baseline(self.date, self.horizon))
        raise ValueError(f"no baseline {self.name} (date column: {self.date})")


#: What a run can hold: anything with a name, a horizon and ``predict``.
AnyModel = BoostedModel | LinearModel | DirectModel | BaselineModel
AnyForecaster = BoostedForecaster | LinearForecaster | DirectForecaster | BaselineForecaster
