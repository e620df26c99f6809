"""Train, store, serve, watch and train again, end to end on a small panel."""

import json
import re

import pytest
from frames import PANEL_SCHEMA, panel, panel_rows
from pyspark.sql import functions as F

from shelfwise import Forecaster, TrainConfig, detect_roles, health, retrain_if_needed, save, train
from shelfwise.operators import models
from shelfwise.operators.ordering import Layout
from shelfwise.plans.champion import load_champion
from shelfwise.plans.monitor import align, decide, promoted
from shelfwise.sources import state
from shelfwise.sources.readers import from_json_column, read_csv, read_json
from shelfwise.streaming.posted_batches import watch_posted


def small_config(**changes):
    settings = dict(
        candidates=[models.gbt_candidate(maxIter=2, maxDepth=2), models.ridge_candidate()],
        baselines={"moving_average": models.moving_average(7)},
    )
    return TrainConfig(**{**settings, **changes})


def write_csv(path, rows):
    path.write_text("shop,day,sales,temp,promo,kind\n" + "\n".join(
        ",".join("" if v is None else str(v) for v in r) for r in rows) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    raw = read_csv(spark, write_csv(folder / "raw.csv", panel_rows(gaps=True)))
    trained = train(raw, small_config())
    path = str(folder / "state")
    save(trained, spark, path)
    return raw, trained, path


def test_training(stored):
    raw, trained, _ = stored
    roles = trained.roles
    assert (roles.date, roles.target, roles.series) == ("day", "sales", "shop")
    assert roles.numeric == ("temp",) and roles.categorical == ("promo", "kind")
    found = {r.model_name: r for r in trained.metrics.collect()}
    assert set(found) == {"gbt", "ridge", "moving_average"}
    assert all(r.rmse >= r.mae > 0 for r in found.values())
    assert trained.best == min(found, key=lambda m: found[m].rmspe)
    assert trained.features[:3] == ["temp", "promo", "kind"]
    assert trained.sample.count() == 228  # 3 series of 76 rows
    assert trained.sample.columns.count("sales") == 1


def test_run_log(spark, stored):
    _, trained, path = stored
    info = state.model_info(state.read_runs(spark, f"{path}/runs")).first()
    assert info.approved_model == trained.best and (info.horizon, info.lookback) == (7, 14)
    assert info.schema.target_column == "sales" and set(info.metrics) >= {"gbt", "ridge"}
    run = state.current_run(spark, path)
    assert state.load_reference(spark, f"{run.folder}/reference") == trained.reference
    saved = state.last_saved(spark, run.model_path)
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d UTC", saved)
    assert state.last_saved(spark, f"{path}/none") == "unknown"


def test_state_survives_storage(spark, stored):
    raw, trained, path = stored
    again = state.load_preprocessor(spark, f"{state.current_run(spark, path).folder}/preprocessor")
    assert again.state.roles == trained.preprocessor.state.roles
    a, b = trained.preprocessor.transform(raw), again.transform(raw)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("anchor", ["next", "last_complete"])
def test_forecast_of_all_series(spark, stored, anchor):
    raw, trained, path = stored
    served = Forecaster(spark, path, anchor)
    docs = served.forecast(raw).collect()
    assert {d.shop for d in docs} == {"s0", "s1", "s2"}
    for d in docs:
        assert d.model == trained.best and d.horizon == 7
        assert [p.step for p in d.points] == list(range(1, 8))
        assert d.points[0].date == "2023-04-02"
        assert all(p.value >= 0 for p in d.points)
    one = served.forecast(raw.where("shop = 's1'")).collect()
    assert len(one) == 1
    cut = raw.where("shop <> 's2' or day < '2023-01-20'")
    assert [r.shop for r in served.unserved(cut).collect()] == ["s2"]


def test_health(spark, stored):
    raw, _, path = stored
    quiet = health(spark, path).first()
    assert quiet.status.startswith("MONITORING") and quiet.data_drift_detected is None
    same = health(spark, path, align(spark, path, raw)).first()
    assert same.status.startswith("HEALTHY") and same.prediction_drift_detected is False
    moved = raw.withColumn("sales", raw.sales * 3 + 500)
    own = health(spark, path, align(spark, path, moved), watch="temp").first()
    assert own.prediction_drift_detected is False
    assert state.load_sample(spark, state.current_run(spark, path).folder).count() == 228
    far = health(spark, path, align(spark, path, moved)).first()
    assert far.status.startswith("DRIFT") and far.prediction_drift_detected is True


def test_conditional_retraining(spark, stored, tmp_path):
    raw, _, path = stored
    config = small_config(candidates=[models.ridge_candidate()], baselines={})
    assert retrain_if_needed(spark, raw, path, config) is None
    fresh = str(tmp_path / "fresh")
    assert decide(spark, fresh).first()["branch"] == "retrain_model"
    assert retrain_if_needed(spark, raw, fresh, config, "v2").best == "ridge"
    assert state.latest_run(state.read_runs(spark, f"{fresh}/runs")).first()["model_version"] == "v2"
    with pytest.raises(ValueError, match="Not enough data"):
        retrain_if_needed(spark, raw.limit(50), fresh, config)


def test_one_series_and_layouts(spark, tmp_path):
    df = panel(spark)
    ridge = dict(candidates=[models.ridge_candidate()], baselines={})
    one = train(df, small_config(single_group="s1", **ridge))
    split = train(df, small_config(single_group="s1", layout=Layout("blocks", 30), **ridge))
    a, b = one.metrics.first(), split.metrics.first()
    assert (a.mae, a.rmse) == (pytest.approx(b.mae), pytest.approx(b.rmse))
    with pytest.raises(ValueError, match="Too few windows"):
        train(panel(spark, days=40, shops=1), small_config(**ridge))
    thin = df.where("day <> date'2023-02-01'")
    full = train(thin, small_config(densify_days=1, **ridge))
    assert full.sample.count() == one.sample.count() * 3
    staged = str(tmp_path / "staged")
    part = train(df, small_config(fit_on="train", staging=staged, **ridge))
    assert spark.read.parquet(staged).count() == df.count()
    cut = one.preprocessor.state.scales["temp"].mean
    assert part.preprocessor.state.scales["temp"].mean != cut


def test_csv_gaps(spark, tmp_path):
    f = tmp_path / "g.csv"
    f.write_text("a,b,c\n1,NA,x\n2,3.5,null\nNaN,4,y\n")
    df = read_csv(spark, str(f))
    assert dict(df.dtypes)["b"] == "double"
    rows = df.collect()
    assert [r.a for r in rows] == [1.0, 2.0, None] and [r.b for r in rows] == [None, 3.5, 4.0]
    assert [r.c for r in rows] == ["x", None, "y"]
    assert read_csv(spark, str(f), rows=2).count() == 2
    assert read_csv(spark, str(f), schema="a double, b string, c string").dtypes[1][1] == "string"


def test_posted_json(spark, tmp_path):
    schema = "shop string, day string, sales double"
    body = json.dumps({"history": [{"shop": "s", "day": "2024-01-01", "sales": 5.0}] * 2})
    df = spark.createDataFrame([(body,)], "body string")
    assert from_json_column(df, "body", schema).count() == 2
    (tmp_path / "r.json").write_text('{"shop":"s","day":"2024-01-01","sales":1.5}\n')
    assert read_json(spark, str(tmp_path / "r.json"), schema).first()["sales"] == 1.5


def test_posted_batches(spark, stored, tmp_path):
    raw, _, path = stored
    inbox = tmp_path / "inbox"
    raw.coalesce(1).write.json(str(inbox))
    moved = raw.withColumn("sales", raw.sales * 3 + 500)
    moved.coalesce(1).write.mode("append").json(str(inbox))
    query = watch_posted(
        spark, str(inbox), raw.schema, path, str(tmp_path / "reports"), str(tmp_path / "check"), 1
    )
    query.awaitTermination(300)
    reports = spark.read.parquet(str(tmp_path / "reports")).orderBy("batch").collect()
    assert len(reports) == 2
    assert {r.status[:5] for r in reports} == {"HEALT", "DRIFT"}


def test_detected_types_of_csv(spark, tmp_path):
    raw = read_csv(spark, write_csv(tmp_path / "x.csv", panel_rows(days=30, shops=2)))
    assert raw.columns == [f.split()[0] for f in PANEL_SCHEMA.split(", ")]
    assert detect_roles(raw).frequency == "D"


def test_one_series_without_a_key_column(spark):
    rows = [(r[1], r[2]) for r in panel_rows(days=120, shops=1)]
    df = spark.createDataFrame(rows, "day date, sales double")
    config = small_config(candidates=[models.ridge_candidate()], baselines={}, fit_on="train")
    trained = train(df, config)
    assert trained.roles.series is None and trained.best == "ridge"
    from shelfwise.operators import forecast

    inputs = forecast.forecast_inputs(df, trained.roles, trained.features, sequence=True)
    served = forecast.forecast_rows(trained.best_model.predict(inputs), trained.roles)
    doc = forecast.forecast_document(served, trained.roles, "ridge").first()
    assert doc.horizon == 7 and doc.points[0].date == "2023-05-02"
    assert abs(doc.trend_pct) < 100


def test_text_dates(spark, tmp_path):
    raw = panel(spark).withColumn("day", F.date_format("day", "dd/MM/yyyy"))
    raw = raw.withColumn("day", F.when(F.rand(1) < 0.01, "unreadable").otherwise(F.col("day")))
    config = small_config(date_formats=("dd/MM/yyyy",), schema_overrides={
        "date_column": "day", "target_column": "sales", "group_column": "shop"})
    trained = train(raw, config)
    assert trained.roles.date == "day"
    save(trained, spark, str(tmp_path / "state"))
    assert Forecaster(spark, str(tmp_path / "state")).forecast(raw).count() > 0


def test_reference_covers_every_series(spark, tmp_path):
    """12 shops, 150 days: the sales of most shops fall to a hundredth."""
    days = spark.range(150).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    shops = spark.range(12).select(F.concat(F.lit("shop"), F.lpad("id", 2, "0")).alias("shop"), "id")
    raw = shops.crossJoin(days).select(
        "shop", "day", (100.0 + 10 * F.col("id") + F.abs(F.hash("shop", "day")) % 40).alias("sales"), "id").cache()
    path = str(tmp_path / "state")
    overrides = {"date_column": "day", "target_column": "sales", "group_column": "shop"}
    save(train(raw.drop("id"), small_config(schema_overrides=overrides)), spark, path)
    fallen = raw.withColumn("sales", F.when(F.col("id") < 7, F.col("sales") / 100).otherwise(F.col("sales")))
    report = health(spark, path, align(spark, path, fallen.drop("id"))).first()
    assert "DRIFT DETECTED" in str(report)


def test_run_serves_with_its_own_settings(spark, tmp_path):
    raw, path = panel(spark, gaps=True), str(tmp_path / "state")
    perfect = {"moving_average": F.col("future")}  # a baseline that cannot be beaten
    config = small_config(candidates=[models.ridge_candidate()], baselines=perfect,
                          lags=(1, 2), rolls=(3,), densify_days=1, schema_overrides={
                              "date_column": "day", "target_column": "sales", "group_column": "shop"})
    trained = train(raw, config)
    assert trained.best == "ridge"
    save(trained, spark, path)
    ready = Forecaster(spark, path)
    assert ready.forecast(raw).count() > 0
    assert "sales_lag2" in ready.features and "sales_lag7" not in ready.features
    assert ready.unserved(raw).count() + ready.forecast(raw).count() == raw.select("shop").distinct().count()
    assert set(trained.features) <= set(align(spark, path, raw).columns)
    assert health(spark, path, align(spark, path, raw)).count() == 1


def test_custom_inputs_are_stored(spark, tmp_path):
    mean = "array(aggregate(past, 0D, (total, x) -> total + x) / greatest(size(past), 1))"
    line = models.DirectForecaster("line", models.ridge, mean)
    trained = train(panel(spark), small_config(candidates=[line], baselines={}))
    save(trained, spark, str(tmp_path / "state"))
    again = Forecaster(spark, str(tmp_path / "state"))
    assert again.model.inputs == mean and again.forecast(panel(spark)).count() == 3
    own = models.DirectModel("own", [], lambda: F.col("past"))
    with pytest.raises(ValueError, match="cannot be stored"):
        state.save_model(own, spark, str(tmp_path / "own"))


def test_only_a_better_run_is_approved(spark, tmp_path):
    raw, path = panel(spark), str(tmp_path / "state")
    ridge = small_config(candidates=[models.ridge_candidate()], baselines={})
    trained = train(raw, ridge)
    save(trained, spark, path, "v1")
    save(trained, spark, path, "v2", approved=False)
    run = state.current_run(spark, path)
    assert run.model_version == "v1" and state.read_runs(spark, f"{path}/runs").count() == 2
    champion = load_champion(spark, path)
    assert not promoted(train(raw, ridge, champion))  # equal is not better
    poor = small_config(candidates=[models.ridge_candidate(regParam=1e9)], baselines={},
                        selection_metric="rmse")
    worse = train(raw, poor, champion)
    assert worse.best == "ridge" and not promoted(worse)
    save(worse, spark, path, "v3", approved=promoted(worse))
    assert state.current_run(spark, path).model_version == "v1"
    assert state.read_runs(spark, f"{path}/runs").count() == 3


def test_row_cap_takes_the_first_rows(spark):
    df, ridge = panel(spark), dict(candidates=[models.ridge_candidate()], baselines={})
    one, two = (train(d, small_config(rows=180, **ridge)) for d in (df, df.orderBy(F.rand(3))))
    assert one.metrics.first() == two.metrics.first() or one.metrics.first().mae == pytest.approx(
        two.metrics.first().mae)
