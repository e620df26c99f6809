"""Ridge regression from one Gram matrix against MLlib and the normal equations."""

import random

import numpy as np
import pytest
from frames import panel
from pyspark.sql import functions as F

from shelfwise import Forecaster, TrainConfig, save, train
from shelfwise.operators import linear, models

SCHEMA = "features array<double>, future array<double>"


def rows(n=400, seed=1):
    draw = random.Random(seed)
    x = [[draw.gauss(1e5, 2e4), draw.gauss(0, 1e-3), float(draw.randint(0, 1)), draw.gauss(5, 1)] for _ in range(n)]
    return [(v, [2 * v[0] - 1e6 * v[1] + draw.gauss(0, 500), 100 * v[3] + draw.gauss(0, 3), draw.gauss(0, 1)]) for v in x]


@pytest.mark.parametrize("penalty", [0.0, 0.1, 50.0, 1e9])
def test_equals_mllib(spark, penalty):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    ours = models.LinearForecaster("r", penalty, "features", False).fit(df, 3)
    theirs = models.DirectForecaster("m", lambda: models.ridge(regParam=penalty, solver="normal"), "features").fit(df, 3)
    for s, model in enumerate(theirs.steps):
        assert ours.lines.coefficients[s] == pytest.approx(model.coefficients.toArray(), rel=1e-6, abs=1e-9)
        assert ours.lines.intercepts[s] == pytest.approx(model.intercept, rel=1e-6)
    a, b = (m.predict(df).select("future", F.posexplode("prediction").alias("h", "p")) for m in (ours, theirs))
    wanted = {(tuple(r[0]), r.h): r.p for r in b.collect()}
    assert all(r.p == pytest.approx(wanted[tuple(r[0]), r.h], rel=1e-6) for r in a.collect())


def test_normal_equations(spark):
    data = rows(60)
    found = linear.fit_lines(spark.createDataFrame(data, SCHEMA).repartition(3), penalty=0.0)
    x = np.array([[1.0, *v] for v, _ in data])
    wanted, *_ = np.linalg.lstsq(x, np.array([y for _, y in data]), rcond=None)
    assert found.predict(x[:, 1:]) == pytest.approx(x @ wanted, rel=1e-6)


def test_copies_and_constants(spark):
    """A feature given twice shares its weight; one that never changes gets none."""
    df = spark.createDataFrame([([v[0], v[0], 3.0], [y[0]]) for v, y in rows(80)], SCHEMA)
    found = linear.fit_lines(df, penalty=0.0)
    a, b, c = found.coefficients[0]
    assert a == pytest.approx(b) and c == 0 and a + b == pytest.approx(2, rel=0.3)
    flat = linear.fit_lines(spark.createDataFrame([([1.0, 2.0], [4.0])] * 5, SCHEMA))
    assert flat.predict(np.array([[9.0, 9.0]])) == pytest.approx(np.array([[4.0]]))
    one = linear.fit_lines(spark.createDataFrame([([1.0], [4.0])], SCHEMA))
    assert one.predict(np.array([[5.0]])) == pytest.approx(np.array([[4.0]]))
    with pytest.raises(ValueError, match="no rows"):
        linear.fit_lines(spark.createDataFrame([], SCHEMA))


def test_storage_and_serving(spark, tmp_path):
    raw, path = panel(spark, days=120), str(tmp_path / "state")
    trained = train(raw, TrainConfig(candidates=[models.ridge_candidate()], schema_overrides={
        "date_column": "day", "target_column": "sales", "group_column": "shop"}))
    save(trained, spark, path)
    served = Forecaster(spark, path)
    assert (served.model.lines.coefficients == trained.best_model.lines.coefficients).all()
    assert served.model.needs_sequence and served.forecast(raw).count() == 3
