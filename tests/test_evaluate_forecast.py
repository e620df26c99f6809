from datetime import date, timedelta

import pytest
from frames import ROLES, TICKS, panel, panel_rows, ticks
from pyspark.sql import functions as F

from shelfwise.functions.calendar import CALENDAR_FEATURES
from shelfwise.functions.text import insight
from shelfwise.operators import evaluate, forecast, models
from shelfwise.operators.features import calendar_features, feature_columns, feature_frame
from shelfwise.operators.roles import Roles
from shelfwise.operators.windows import sliding_windows, split_windows


def test_metric_goldens(spark):
    rows = [("m", 100.0, 110.0), ("m", 0.0, 5.0), ("m", 50.0, 40.0), ("z", 0.0, 1.0), ("z", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "model_name string, y double, p double")
    r = {x.model_name: x for x in evaluate.forecast_metrics(df).collect()}
    assert r["m"].mae == pytest.approx(8.33333, abs=1e-5)
    assert r["m"].rmse == pytest.approx(8.66025, abs=1e-5)
    assert r["m"].rmspe == pytest.approx(0.158114, abs=1e-6)
    assert r["z"].rmspe is None and r["z"].rmse >= r["z"].mae


def metrics(spark, *rows):
    return spark.createDataFrame(rows, "model_name string, mae double, rmse double, rmspe double")


def test_selection(spark):
    nan = float("nan")
    best = lambda *rows, **k: evaluate.select_best(metrics(spark, *rows), **k).first()
    assert best(("a", 1.0, 5.0, 0.2), ("b", 2.0, 4.0, 0.3))["best_model"] == "a"
    assert best(("a", 1.0, 5.0, None), ("b", 2.0, 4.0, 0.3))["best_model"] == "b"
    r = best(("a", 1.0, 5.0, nan), ("b", 2.0, 4.0, None))
    assert (r.best_model, r.selected_by) == ("b", "rmse")
    tie = [("a", 1.0, 5.0, 0.2), ("b", 1.0, 5.0, 0.2)]
    assert best(*tie, order=["b", "a"])["best_model"] == "b"
    assert best(*tie, metric="mae")["best_model"] == "a"


def test_promotion(spark):
    schema = "run_time string, model_name string, approved boolean, rmspe double"
    def run(*rows):
        df = spark.createDataFrame(rows, schema).withColumn("run_time", F.to_timestamp("run_time"))
        return evaluate.promote_champion(df).first()
    old, better = ("2024-01-01", "a", True, 0.3), ("2024-01-08", "b", False, 0.2)
    assert run(old, better).approved_model == "b"
    assert run(old, ("2024-01-08", "b", False, 0.3)).approved_model == "a"
    assert run(old, ("2024-01-08", "b", False, None)).approved_model == "a"
    assert run(("2024-01-01", "a", True, None), better).approved_model == "b"
    assert run(better).approved_model == "b"
    assert run(old).approved_model == "a"
    newest = run(old, better, ("2024-01-15", "c", False, 0.9))
    assert (newest.challenger, newest.promoted) == ("c", False)


@pytest.mark.parametrize("delta, text", [
    (0.05, "Demand roughly stable"), (0.0501, "Demand trending UP ~5%"),
    (-0.0501, "Demand trending DOWN ~5%"), (0.125, "Demand trending UP ~12%"),
])
def test_insight(spark, delta, text):
    df = spark.createDataFrame([(delta,)], "d double")
    assert df.select(insight(F.col("d"))).first()[0].startswith(text)


def test_recommendations_golden(spark):
    df = spark.createDataFrame([("s", 10.0), ("t", -1.2), ("u", 0.5)], "shop string, trend_pct double")
    got = {(r.shop, r["product"]): r.action
           for r in forecast.inventory_recommendations(df, ROLES).collect()}
    assert [got["s", p] for p in ("Milk", "Coffee", "Bread", "Snacks")] == [
        "Increase 13%", "Increase 9%", "Increase 4%", "Increase 11%"]
    assert got["t", "Milk"] == "Reduce 2%" and got["t", "Bread"] == "Hold"
    assert got["u", "Milk"] == "Hold"


def test_calendar_goldens(spark):
    df = spark.sql("select explode(array(date'2024-01-01', date'2021-01-03')) as d")
    a, b = calendar_features(df, "d").orderBy(F.col("d").desc()).collect()
    assert (a.dow, a.is_weekend) == (0, 0)
    assert (b.weekofyear, b.is_weekend, b.dow, b.year) == (53, 1, 6, 2021)
    assert set(calendar_features(df, "d").columns) == {"d", *CALENDAR_FEATURES}
    clash = calendar_features(df.withColumnRenamed("d", "day"), "day")
    assert "cal_day" in clash.columns and clash.schema["day"].dataType.typeName() == "date"


def expected_inputs(anchor, lookback):
    """Brute force over the sorted panel, lags and means up to 14."""
    by_shop = {}
    for r in sorted(panel_rows()):
        by_shop.setdefault(r[0], []).append(r)
    out = {}
    for shop, rows in by_shop.items():
        sales = [r[2] for r in rows]
        n = len(sales)
        i = n if anchor == "next" else n - 7
        day = rows[0][1] + timedelta(days=i)
        carried = rows[min(i, n - 1)][3]
        features = [carried, day.weekday(), day.day, day.month, day.year,
                    day.isocalendar()[1], int(day.weekday() >= 5),
                    sales[i - 1], sales[i - 7], sales[i - 14],
                    sum(sales[i - 7:i]) / 7, sum(sales[i - 14:i]) / 14]
        out[shop] = (sales[i - lookback:i] + features, sum(sales[-lookback:]) / lookback,
                     rows[-1][1])
    return out


@pytest.mark.parametrize("anchor", ["next", "last_complete"])
@pytest.mark.parametrize("sequence", [False, True])
def test_forecast_inputs(spark, anchor, sequence):
    df = panel(spark).drop("promo", "kind")
    roles = Roles("day", "sales", "shop", numeric=("temp",))
    names = feature_columns(feature_frame(df, roles), roles)
    found = forecast.forecast_inputs(df, roles, names, 14, 7, anchor, sequence=sequence)
    want = expected_inputs(anchor, 14)
    got = {r.shop: r for r in found.collect()}
    assert set(got) == set(want)
    for shop, (vector, recent, last) in want.items():
        assert got[shop].tabular == pytest.approx(vector)
        assert got[shop].recent_average == pytest.approx(recent)
        assert got[shop].last_date == last
        if sequence:
            assert len(got[shop].steps) == 14 and [s[0] for s in got[shop].steps] == got[shop].past


def test_only_the_newest_rows_are_shuffled(spark):
    roles = Roles("day", "sales", "shop", numeric=("temp",))
    df = panel(spark).drop("promo", "kind")
    names = feature_columns(feature_frame(df, roles), roles)
    short = forecast.forecast_inputs(df, roles, names)
    full = forecast.forecast_inputs(df.withColumn("unused", F.lit(1)), roles, names)
    assert short.exceptAll(full).count() == 0 and full.exceptAll(short).count() == 0
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_gap_in_an_unused_column_drops_its_row(spark):
    roles = Roles("day", "sales", "shop", numeric=("temp",))
    df = panel(spark).drop("promo", "kind")
    gap = F.when(F.col("day") != "2023-03-30", 1)
    got = forecast.forecast_inputs(df.withColumn("unused", gap), roles, [])
    whole = forecast.forecast_inputs(df, roles, [])
    kept = {r.shop: r.past for r in got.collect()}
    for r in whole.collect():
        at = 14 - 3  # 2023-03-30 is third from the end
        assert kept[r.shop][1:] == r.past[:at] + r.past[at + 1:]


def test_short_series_give_no_row(spark):
    df = panel(spark, days=25, shops=1).drop("promo", "kind", "temp")
    roles = Roles("day", "sales", "shop")
    assert forecast.forecast_inputs(df, roles, []).count() == 0


def test_sub_daily_inputs(spark):
    names = ["load"]
    found = forecast.forecast_inputs(ticks(spark), TICKS, names, lookback=5)
    assert found.count() == 4 and all(len(r.tabular) == 6 for r in found.collect())


def test_forecast_rows_and_document(spark):
    base = spark.createDataFrame(
        [("s", 100.0, date(2024, 2, 27), [90.0, -5.0, 120.04])],
        "shop string, recent_average double, last_date date, prediction array<double>")
    rows = forecast.forecast_rows(base, ROLES)
    got = [(r.step, str(r.date), r.forecast) for r in rows.orderBy("step").collect()]
    assert got == [(1, "2024-02-28", 90.0), (2, "2024-02-29", 0.0), (3, "2024-03-01", 120.04)]
    doc = forecast.forecast_document(rows, ROLES, "gbt").first()
    assert doc.model == "gbt" and doc.horizon == 3 and doc.recent_average == 100.0
    assert [(p.date, p.value) for p in doc.points][2] == ("2024-03-01", 120.0)
    assert doc.trend_pct == -30.0 and doc.trend_label == "decreasing"
    weekly = forecast.forecast_rows(base, ROLES, step_days=7).orderBy("step").collect()
    assert str(weekly[0].date) == "2024-03-05"
    band = forecast.forecast_band(rows).orderBy("step").first()
    assert (band.lower, band.upper) == (pytest.approx(79.2), pytest.approx(100.8))


def test_chart(spark):
    df = panel(spark, shops=1)
    rows = forecast.weekday_forecast(df, ROLES)
    chart = forecast.chart_series(df, rows, ROLES).orderBy("date").collect()
    assert len(chart) == 28
    assert [r.forecast is None for r in chart[:21]] == [True] * 20 + [False]
    assert all(r.actual is None for r in chart[21:])


def windows_for_models(spark):
    roles = ROLES.with_(numeric=(), categorical=())
    frame = feature_frame(panel(spark).drop("temp", "promo", "kind"), roles)
    return split_windows(sliding_windows(frame, roles, sequence=True))


def test_ridge_matches_its_closed_form(spark):
    import numpy as np

    windows = windows_for_models(spark)
    candidate = models.DirectForecaster(
        "plain", lambda: models.ridge(regParam=0.0, solver="normal"), lambda: models.array_to_vector(F.slice("past", 1, 3)))
    model = candidate.fit(windows, 2)
    got = sorted((r.shop, r.day, r.prediction) for r in model.predict(windows).collect())
    rows = sorted((r.shop, r.day, r.past[:3], r.future[:2]) for r in windows.collect())
    X = np.array([[1, *r[2]] for r in rows])
    Y = np.array([r[3] for r in rows])
    fit, *_ = np.linalg.lstsq(X, Y, rcond=None)
    assert np.allclose(X @ fit, [g[2] for g in got], rtol=1e-6)


def test_models_beat_the_moving_average(spark):
    windows = windows_for_models(spark).cache()
    test = windows.where(~F.col("is_train"))
    scored, predictions = test, {"moving_average": models.moving_average(7)}
    for c in (models.gbt_candidate(maxIter=10, maxDepth=4, stepSize=0.3), models.ridge_candidate()):
        model = c.fit(windows.where("is_train"), 7)
        assert model.predict(test).columns == [*test.columns, "prediction"]
        scored = model.predict(scored, f"by_{c.name}")
        predictions[c.name] = F.col(f"by_{c.name}")
    long = evaluate.scored_long(scored, predictions)
    assert long.count() == 3 * 7 * test.count()
    found = {r.model_name: r.rmse for r in evaluate.forecast_metrics(long).collect()}
    windows.unpersist()
    assert found["gbt"] < found["moving_average"] and found["ridge"] < found["moving_average"]
