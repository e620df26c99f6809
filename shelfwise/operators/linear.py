"""Ridge regression for all forecast steps from one Gram matrix.

Features and the targets of all steps are centred and scaled (one aggregate), and their products
are added up in a second one: a matrix of (features + steps) squared, whatever the number of rows.
The normal equations of every step are then solved on the driver; an eigendecomposition of the
features' part serves all steps, whose penalties differ.

The penalty is MLlib's: ``regParam`` over the deviation of the target, on standardised features.
A feature without variance gets the coefficient 0; without a penalty, directions that no row tells
apart get none of the weight (the solution of least length).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Eigenvalues of the correlation matrix below this share of the largest one count as zero.
NOTHING = 1e-13

LINE_SCHEMA = "step int, intercept double, coefficients array<double>"


@dataclass(frozen=True)
class Lines:
    """Intercepts per step, and coefficients (steps x features)."""

    intercepts: np.ndarray
    coefficients: np.ndarray

    @property
    def steps(self) -> int:
        return len(self.intercepts)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients.T + self.intercepts

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, float(a), b.tolist()) for s, (a, b) in enumerate(zip(self.intercepts, self.coefficients))]
        return spark.createDataFrame(rows, LINE_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> Lines:
        rows = sorted(df.collect(), key=lambda r: r["step"])  # one row per step
        return Lines(np.array([r["intercept"] for r in rows]), np.array([r["coefficients"] for r in rows]))


def fit_lines(df: DataFrame, features: str = "features", labels: str = "future", penalty: float = 0.1) -> Lines:
    """``df``: two columns of arrays of doubles without missing values, all of one length.

    Three passes read it and nothing wide is kept, so it should be cheap to read (see
    ``windows.chunk_windows``).
    """
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    if not n:
        raise ValueError("no rows to fit")
    whole = df.select(array_to_vector(F.concat(features, labels)).alias("row"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="row", outputCol="scaled").fit(whole)
    scaled = MLUtils.convertVectorColumnsFromML(scaler.transform(whole).select("scaled"), "scaled")
    products = RowMatrix(scaled).computeGramianMatrix().toArray()
    means, deviations = scaler.mean.toArray(), scaler.std.toArray() * np.sqrt(max(n - 1, 0) / n)
    return solved(products / max(n - 1, 1), means, deviations, width, penalty)


def solved(
    correlations: np.ndarray, means: np.ndarray, deviations: np.ndarray, width: int, penalty: float
) -> Lines:
    """The lines that solve the normal equations of every step."""
    values, axes = np.linalg.eigh(correlations[:width, :width])
    values = np.maximum(values, 0.0)
    scales = np.where(deviations[:width] > 0, deviations[:width], np.inf)
    steps = len(means) - width
    coefficients = np.zeros((steps, width))
    for s in range(steps):
        spread = deviations[width + s]
        if spread > 0:
            weight = values + penalty / spread
            known = weight > NOTHING * values.max(initial=0)
            turned = axes.T @ correlations[:width, width + s]
            inverse = np.divide(1.0, weight, out=np.zeros(width), where=known)
            coefficients[s] = (axes @ (turned * inverse)) * spread / scales
    return Lines(means[width:] - coefficients @ means[:width], coefficients)


def predicted(lines: Lines, features: Column) -> Column:
    """An array with one prediction per step, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def along(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(lines.predict(np.stack(batch.to_numpy()))) if len(batch) else [], dtype=object)

    return along(features)
