import random

import pytest

from shelfwise.operators import drift, health

CASES = [  # reference, current, PSI, values out of range
    (range(100), range(100), 0.0, 0),
    (range(100), range(5, 105), 0.0328333, 5),
    (range(100), range(50, 150), 6.1029788, 50),
    (range(100), [i / 2 for i in range(100)], 5.1473825, 0),
    ([1] * 8 + [2, 3], [1, 2, 3, 3], 1.4209517, 0),
    ([5, 5, 5], [5, 6], 0.0, 2),
]


def column(spark, values, c="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{c} double")


@pytest.mark.parametrize("reference, current, want, outside", CASES)
def test_psi_goldens(spark, reference, current, want, outside):
    fitted = drift.fit_reference(column(spark, reference), ["x"])
    row = drift.column_psi(fitted, column(spark, current)).first()
    assert row.score == pytest.approx(want, abs=1e-6)
    assert row.n_out_of_range == outside


def test_edges_and_bins(spark):
    fitted = drift.fit_reference(column(spark, [1] * 8 + [2, 3]), ["x"])
    assert fitted.edges["x"] == pytest.approx([1, 1.2, 2.1, 3])
    assert fitted.counts["x"] == [8, 1, 1]
    bins = drift.histogram(column(spark, [-1, 0, 1, 2, 3]), {"x": [0.0, 1.0, 2.0]})
    assert {r.bin: r.n for r in bins.collect()} == {-1: 2, 0: 1, 1: 2}


def test_missing_sides(spark):
    some, none = column(spark, range(10)), column(spark, [None, float("nan")])
    for r, c in ((some, none), (none, some), (none, none)):
        fitted = drift.fit_reference(r, ["x"])
        assert drift.column_psi(fitted, c).first()["score"] == 0.0
    # all values out of range still count as values: empty bins drive the score
    far = drift.column_psi(drift.fit_reference(some, ["x"]), column(spark, [99, 99])).first()
    assert far.score > 5 and far.n_out_of_range == 2


def test_score_is_never_negative(spark):
    rng = random.Random(3)
    for _ in range(3):
        a = column(spark, [rng.gauss(0, 1) for _ in range(200)])
        b = column(spark, [rng.gauss(0.5, 2) for _ in range(150)])
        fitted = drift.fit_reference(a, ["x"])
        assert drift.column_psi(fitted, b).first()["score"] >= 0
        assert drift.column_psi(fitted, a).first()["score"] == pytest.approx(0, abs=1e-12)


def test_report_over_shared_columns(spark):
    rows = [(float(i), float(i % 10), i % 2 == 0, "t", 1.0) for i in range(200)]
    ref = spark.createDataFrame(rows, "a double, b double, flag boolean, text string, only_ref double")
    moved = [(float(i) + 150, float(i % 10), i % 2 == 0, "u") for i in range(200)]
    cur = spark.createDataFrame(moved, "a double, b double, flag boolean, text string")
    r = drift.check_drift(ref, cur).first()
    assert (r.method, r.n_columns, r.n_drifted, r.drift_share) == ("psi", 3, 1, 0.333)
    assert r.dataset_drift is False and set(r["columns"]) == {"a", "b", "flag"}
    assert r["columns"]["a"].drifted is True
    assert drift.check_drift(ref, cur, ["a"]).first()["dataset_drift"] is True


def test_limits(spark):
    v = spark.createDataFrame([("a", 0.25), ("b", 0.2500001), ("c", 1.0), ("d", 0.0), ("e", 0.0)],
                              "column string, score double").selectExpr("*", "0L as n_out_of_range")
    verdicts = drift.column_verdicts(v)
    assert {r["column"]: r.drifted for r in verdicts.collect()} == {
        "a": False, "b": True, "c": True, "d": False, "e": False
    }
    assert drift.dataset_verdict(verdicts).first()["dataset_drift"] is True  # 2 of 5 is enough


def test_no_columns(spark):
    v = spark.createDataFrame([], "column string, psi double, drifted boolean")
    r = drift.dataset_verdict(v).first()
    assert r.n_columns == 1 and r.n_drifted == 0 and r.dataset_drift is False


def test_stored_reference(spark, tmp_path):
    from shelfwise.sources.state import load_reference, save_reference

    fitted = drift.fit_reference(column(spark, range(50)), ["x"])
    assert load_reference(spark, str(tmp_path / "none")) is None
    save_reference(fitted, spark, str(tmp_path / "ref"))
    assert load_reference(spark, str(tmp_path / "ref")) == fitted


def test_bracketed_edges_match_sorted_ones(spark):
    rng = random.Random(8)
    df = column(spark, [round(rng.gauss(50, 20), 3) for _ in range(3000)])
    assert drift.psi_edges(df, ["x"], small_rows=50) == drift.psi_edges(df, ["x"])


def test_bootstrap(spark):
    df = column(spark, range(1000))
    rows = lambda d: sorted(r[0] for r in d.collect())
    one = drift.bootstrap(df, seed=1)
    assert one.count() == 1000 and set(rows(one)) <= set(range(1000))
    assert abs(one.distinct().count() - 632) < 50
    assert rows(one) == rows(drift.bootstrap(df.repartition(7), seed=1))
    assert rows(one) != rows(drift.bootstrap(df, seed=2))
    assert drift.check_drift(df, one).first()["dataset_drift"] is False


def test_bootstrap_of_equal_rows_and_none(spark):
    same = column(spark, [5] * 300)
    assert drift.bootstrap(same, seed=1).count() == 300
    assert drift.bootstrap(same.limit(0), seed=1).count() == 0
    odd = spark.createDataFrame([(1, None, {"a": 1}), (None, [1.0], None)], "x int, y array<double>, z map<string,int>")
    assert drift.bootstrap(odd, seed=3).count() == 2


def test_health_texts(spark):
    run = spark.sql("select 'gbt' as best_model, map('gbt', 1.0) as metrics")
    report = lambda flag: spark.createDataFrame(
        [("psi", flag, 0.5)], "method string, dataset_drift boolean, drift_share double")
    cases = {True: "DRIFT DETECTED", False: "HEALTHY", None: "MONITORING"}
    for flag, start in cases.items():
        r = health.health_report(run, report(flag), report(False), "2024-01-01 00:00 UTC").first()
        assert r.status.startswith(start) and r.model_version == "v1"
    r = health.health_report(run).first()
    assert r.note == "no reference/current data" and r.last_retrain == "unknown"
    r = health.health_report(run, error="e" * 300).first()
    assert len(r.drift_error) == 200 and r.note is None


def test_retrain_decision(spark):
    assert health.retrain_decision(None, spark).first()["branch"] == "retrain_model"
    for flag, branch in ((True, "retrain_model"), (False, "skip_retrain")):
        report = spark.createDataFrame([(0.1, flag)], "drift_share double, dataset_drift boolean")
        assert health.retrain_decision(report).first()["branch"] == branch


def test_small_scales(spark):
    """A shift scores the same whatever the unit."""
    scores = []
    for unit in (1.0, 1e-10):
        fitted = drift.fit_reference(column(spark, [i * unit for i in range(100)]), ["x"])
        moved = column(spark, [i * unit for i in range(50, 150)])
        scores.append(drift.column_psi(fitted, moved).first()["score"])
    assert scores[0] == pytest.approx(scores[1]) and scores[0] > 6


def test_sketched_edges(spark):
    exact = drift.fit_reference(column(spark, range(1000)), ["x"])
    near = drift.fit_reference(column(spark, range(1000)), ["x"], exact=False)
    assert near.edges["x"] == pytest.approx(exact.edges["x"], abs=1.0)
    assert drift.fit_reference(column(spark, [None]), ["x"], exact=False).edges == {"x": []}
