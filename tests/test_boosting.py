"""Boosted trees against a booster that tries every split, and storage of the ensemble."""

import random

import numpy as np
import pytest
from frames import panel
from pyspark.sql import functions as F

from shelfwise import Forecaster, TrainConfig, save, train
from shelfwise.operators import boosting, models
from shelfwise.operators.boosting import TreeSize

OVERRIDES = {"date_column": "day", "target_column": "sales", "group_column": "shop"}


def small_frame(n=160, seed=4):
    """Few distinct values, so that every value is a bin edge."""
    draw = random.Random(seed)
    x = [[float(draw.randint(0, 6)), draw.choice([-1.5, 0.0, 2.25]), float(draw.randint(0, 25)), 7.0] for _ in range(n)]
    y = [[3 * a + b * c + draw.gauss(0, 1), (a - 3) ** 2 + draw.gauss(0, 1)] for a, b, c, _ in x]
    return x, y


def frame(spark, x, y, parts):
    return spark.createDataFrame(list(zip(x, y)), "features array<double>, future array<double>").repartition(parts)


class Brute:
    """One tree: every feature and every value of it as a threshold, in every node."""

    def __init__(self, x, r, rows, size):
        self.size, self.x, self.r = size, x, r
        self.nodes = {}
        self.grow(0, rows, 0)

    def value(self, rows):
        return self.size.rate * self.r[rows].sum() / (len(rows) + self.size.l2)

    def score(self, rows):
        return self.r[rows].sum() ** 2 / (len(rows) + self.size.l2)

    def grow(self, node, rows, level):
        self.nodes[node] = (-1, 0.0, self.value(rows))
        if level == self.size.depth:
            return
        best = None
        for f in range(self.x.shape[1]):
            for edge in np.unique(self.x[:, f])[:-1]:
                left = rows[self.x[rows, f] <= edge]
                right = rows[self.x[rows, f] > edge]
                if len(left) < self.size.least_rows or len(right) < self.size.least_rows:
                    continue
                gain = self.score(left) + self.score(right) - self.score(rows)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, edge, left, right)
        if best:
            _, f, edge, left, right = best
            self.nodes[node] = (f, edge, self.value(rows))
            self.grow(2 * node + 1, left, level + 1)
            self.grow(2 * node + 2, right, level + 1)

    def predict(self):
        out = np.empty(len(self.x))
        for i, row in enumerate(self.x):
            node = 0
            while self.nodes[node][0] >= 0:
                f, edge, _ = self.nodes[node]
                node = 2 * node + 1 + int(row[f] > edge)
            out[i] = self.nodes[node][2]
        return out


@pytest.mark.parametrize("in_task", [0, 1000])
@pytest.mark.parametrize("size", [TreeSize(4, 3, 0.3, 1.0, 1.0, 64), TreeSize(3, 4, 0.5, 1.0, 1.0, 64, least_rows=6)])
def test_same_trees_as_brute_force(spark, monkeypatch, size, in_task):
    monkeypatch.setattr(boosting, "IN_TASK_ROWS", in_task)
    x, y = small_frame()
    found = boosting.fit_trees(frame(spark, x, y, 3), size=size)
    x, y = np.array(x), np.array(y)
    assert found.base == pytest.approx(y.mean(axis=0))
    left = y - y.mean(axis=0)
    for t in range(size.trees):
        for step in range(2):
            tree = Brute(x, left[:, step], np.arange(len(x)), size)
            for node, (f, edge, value) in tree.nodes.items():
                assert found.feature[step, t, node] == f
                if f >= 0:
                    assert found.threshold[step, t, node] == edge
                else:
                    assert found.value[step, t, node] == pytest.approx(value, abs=1e-9)
            left[:, step] -= tree.predict()
    assert found.predict(x) == pytest.approx(y - left)


@pytest.mark.parametrize("direct", [0, 16])
def test_passes_and_partitions_give_the_same_trees(spark, monkeypatch, direct):
    x, y = small_frame(900)
    size = TreeSize(4, 4, 0.2, 0.7, 0.6, 16)
    one = boosting.fit_trees(frame(spark, x, y, 1), size=size)
    monkeypatch.setattr(boosting, "IN_TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "DIRECT_SUMS", direct)
    monkeypatch.setattr(boosting, "TASK_ROWS", 250)
    monkeypatch.setattr(boosting, "CUT_AFTER", 2)
    many = boosting.fit_trees(frame(spark, x, y, 9), size=size)
    assert (one.feature == many.feature).all() and (one.threshold == many.threshold).all()
    assert one.value == pytest.approx(many.value, rel=1e-12, abs=1e-12)


def test_sampling(spark):
    hashes = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    taken = [boosting.drawn(hashes, seed, 0.9) for seed in (1, 2)]
    assert all(abs(t.mean() - 0.9) < 0.01 for t in taken) and (taken[0] != taken[1]).mean() > 0.15
    x, y = small_frame(300)
    found = boosting.fit_trees(frame(spark, x, y, 2), size=TreeSize(30, 2, 0.3, 0.5, 0.5, 32))
    roots = {tuple(found.feature[s, :, 0]) for s in range(2)}
    assert len(roots) == 2 and len({f for r in roots for f in r}) > 1


def test_edge_cases(spark):
    constant = boosting.fit_trees(frame(spark, [[1.0], [2.0]] * 20, [[5.0]] * 40, 2), size=TreeSize(2, 2))
    assert constant.predict(np.array([[1.0], [9.0]])) == pytest.approx(np.full((2, 1), 5.0))
    flat = boosting.fit_trees(frame(spark, [[3.0, 3.0]] * 10, [[float(i)] for i in range(10)], 2), size=TreeSize(2, 2, rows=1.0))
    assert flat.predict(np.array([[0.0, 1.0]])) == pytest.approx(np.array([[4.5]]))
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_trees(frame(spark, [[1.0]], [[1.0]], 1).limit(0))
    none = boosting.fit_trees(frame(spark, [[1.0], [2.0]], [[1.0], [3.0]], 1), size=TreeSize(0, 2))
    assert none.predict(np.array([[1.0]])) == pytest.approx(np.array([[2.0]]))


def test_storage_and_serving(spark, tmp_path):
    raw, path = panel(spark, days=120), str(tmp_path / "state")
    settings = TrainConfig(candidates=[models.gbt_candidate(maxIter=12, maxDepth=3, stepSize=0.3)], schema_overrides=OVERRIDES,
                           baselines={"moving_average": models.moving_average(7)})
    trained = train(raw, settings)
    found = {r.model_name: r for r in trained.metrics.collect()}
    assert trained.best == "gbt" and found["gbt"].rmse < found["moving_average"].rmse
    save(trained, spark, path)
    served = Forecaster(spark, path)
    assert served.model.horizon == 7 and served.forecast(raw).count() == 3
    a, b = trained.best_model.ensemble, served.model.ensemble
    x = np.random.default_rng(2).normal(100, 40, (500, 30))
    assert (a.predict(x) == b.predict(x)).all()


def test_names_of_the_settings():
    size = models.gbt_candidate(maxIter=5, stepSize=0.2, bins=16).size
    assert (size.trees, size.rate, size.bins, size.depth) == (5, 0.2, 16, 6)


def test_near_mllib(spark):
    """Both learn the same function about as well."""
    x, y = small_frame(600)
    df = frame(spark, x, y, 2).cache()
    ours = models.BoostedForecaster("gbt", TreeSize(40, 3, 0.2), "features").fit(df, 2).predict(df)
    theirs = models.DirectForecaster("m", lambda: models.boosted_trees(maxIter=40, maxDepth=3, stepSize=0.2), "features").fit(
        df, 2).predict(df)
    errors = []
    for made in (ours, theirs):
        e = made.select(*[F.sqrt(F.avg(F.pow(F.col("future")[s] - F.col("prediction")[s], 2))) for s in range(2)]).first()
        errors.append(list(e))
    assert all(o < 1.15 * t for o, t in zip(*errors))
