"""Whitening against numpy's eigenvalues and exact integers."""

import math
import random

import numpy as np
import pytest
from odd_tables import SMALL

from shelfwise.llm import queries, whitening


def matrices():
    draw = np.random.default_rng(1)
    a = draw.standard_normal((40, 40))
    yield "random", a @ a.T
    yield "identity", np.eye(9) * 3.0
    yield "clusters", np.diag([5.0] * 4 + [5.0 + 1e-9] * 3 + [1.0] * 5)
    q, _ = np.linalg.qr(draw.standard_normal((30, 30)))
    yield "repeated", q @ np.diag([7.0] * 10 + [7.0 - 1e-12] * 5 + list(np.linspace(1, 2, 15))) @ q.T
    yield "rank two", np.outer(a[0], a[0]) + np.outer(a[1], a[1])
    yield "decoupled", np.diag(np.arange(1.0, 8.0))
    yield "wide range", q @ np.diag(np.logspace(8, -8, 30)) @ q.T
    yield "small", np.array([[2.0, 1.0], [1.0, 2.0]])
    yield "one", np.array([[4.0]])
    yield "tiny", (a @ a.T) * 1e-200


@pytest.mark.parametrize("name,matrix", list(matrices()), ids=[n for n, _ in matrices()])
def test_leading_pairs(name, matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_pairs(matrix, 16)
    k, norm = min(16, len(matrix)), np.abs(matrix).max()
    wanted = np.linalg.eigvalsh(matrix)[::-1][:k]
    assert np.abs(values - wanted).max() <= 1e-12 * norm * len(matrix)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() < 1e-12 * norm * len(matrix)
    assert (vectors[np.arange(k), np.abs(vectors).argmax(axis=1)] > 0).all()


def test_zero_and_empty_matrix():
    assert len(whitening.leading_pairs(np.zeros((5, 5)))[0]) == 0
    assert len(whitening.leading_pairs(np.zeros((0, 0)))[0]) == 0


def grid(v):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)


def check(rows, vectors):
    """``vectors``: id to grid vector of all rows that take part."""
    fit = np.array(sorted(set(vectors.values())))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(16, len(values), int((values > 1e-12 * np.trace(cov)).sum()))
    assert len(rows) == len(vectors) * k
    by = {(r["vec_id"], r["component"]): r for r in rows}
    white = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in vectors])
    # Cov(whitened, x) = component * sqrt(e): gives the components back from the result alone.
    once = {x: i for i, x in reversed(list(enumerate(vectors.values())))}
    w = white[[once[tuple(x)] for x in fit.tolist()]]
    parts = (w.T @ centred / n) / np.sqrt(values[:k])[:, None]
    assert np.abs(parts @ parts.T - np.eye(k)).max() < 1e-9
    assert np.abs(parts @ cov - values[:k, None] * parts).max() < 1e-9 * values[0]
    for i, x in vectors.items():
        for c in range(k):
            r = by[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)))
            assert r["whitened"] == pytest.approx(float((x - sums / n) @ parts[c] / math.sqrt(values[c])), abs=1e-7)
            assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-8


def test_query(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = queries.op12_whitening(spark, SMALL)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows.collect(), {r["vec_id"]: grid(r["embedding"]) for r in table})


def test_odd_vectors(spark):
    draw = random.Random(2)
    make = lambda n: [draw.uniform(-2, 2) for _ in range(n)]
    good = {i: make(5) for i in range(40)}
    good |= {40: good[0], 41: good[0], 42: [1e3, -1e3, 0.0, 1e-9, 5.0]}
    bad = {50: None, 51: [], 52: [1.0, None, 0.0, 0.0, 0.0], 53: [float("nan")] * 5, 54: [float("inf")] * 5,
           55: make(4), 56: [1e300, 0.0, 0.0, 0.0, 0.0]}
    rows = [(i, v, i, 0.5) for i, v in (good | bad).items()] + [(None, good[1], 1, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component double").repartition(4)
    found = whitening.whiten(df).collect()
    check(found, {i: grid(v) for i, v in good.items()} | {None: grid(good[1])})


def test_no_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)
    check(whitening.whiten(line).collect(), {i: grid([i, 2 * i]) for i in range(5)})


def test_deviation_beyond_64_bits():
    x = np.array([[2**40, 0], [0, 1]])
    assert whitening.deviations(x, 2, x.sum(axis=0)) == [None, None]
    x = np.array([[2**29, 0], [0, 1]])
    assert whitening.deviations(x, 2, x.sum(axis=0)) == [2**58 + 1] * 2
