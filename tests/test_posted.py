"""Posted batches with the tails of their series, champions scored again, and the run log."""

import math
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pytest
from frames import ROLES, TICK_SCHEMA, TICKS, panel, tick_rows
from pyspark.sql import functions as F

from shelfwise import Forecaster, TrainConfig, health, retrain_if_needed, save, train
from shelfwise.operators import evaluate, models, sketches, tails
from shelfwise.operators.features import with_features
from shelfwise.operators.ordering import Layout
from shelfwise.plans.champion import duel, load_champion
from shelfwise.plans.monitor import align, extend_reference, remember
from shelfwise.sources import files, state
from shelfwise.sources.readers import read_csv
from shelfwise.streaming.posted_batches import watch_posted

OVERRIDES = {"date_column": "day", "target_column": "sales", "group_column": "shop"}


def config(**changes):
    settings = dict(candidates=[models.ridge_candidate()], schema_overrides=OVERRIDES)
    return TrainConfig(**{**settings, **changes})


def days(df, first, last=None):
    kept = df.where(F.col("day") >= F.lit(first).cast("date"))
    return kept if last is None else kept.where(F.col("day") < F.lit(last).cast("date"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    raw = panel(spark, days=120).cache()
    path = str(tmp_path_factory.mktemp("posted") / "state")
    save(train(days(raw, "2023-01-01", "2023-04-20"), config()), spark, path)
    return raw, path


def test_a_short_batch_has_features(spark, stored):
    raw, path = stored
    week = days(raw, "2023-04-20", "2023-04-27")
    assert align(spark, path, week, tails=False).count() == 0
    got = align(spark, path, week)
    assert got.groupBy("shop").count().agg(F.min("count"), F.max("count")).first()[:] == (7, 7)
    whole = align(spark, path, days(raw, "2023-01-01", "2023-04-27"), tails=False)
    wanted = days(whole, "2023-04-20").select(*got.columns)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def test_health_of_a_short_batch(spark, stored):
    raw, path = stored
    week = days(raw, "2023-04-20", "2023-04-27")
    seen = health(spark, path, align(spark, path, week.withColumn("sales", F.col("sales") * 50))).first()
    assert seen.status.startswith("DRIFT") and seen.rows_compared == 21
    none = health(spark, path, align(spark, path, week, tails=False)).first()
    assert none.status.startswith("MONITORING") and none.data_drift_detected is None
    assert (none.rows_compared, none.note) == (0, "no current rows to compare")


def test_batches_follow_each_other(spark, stored):
    raw, path = stored
    whole = align(spark, path, days(raw, "2023-01-01"), tails=False).cache()
    for start, end in (("2023-04-20", "2023-04-25"), ("2023-04-25", "2023-05-02")):
        batch = days(raw, start, end)
        got = align(spark, path, batch)
        assert got.exceptAll(days(whole, start, end).select(*got.columns)).count() == 0
        assert got.count() == batch.count()
        remember(spark, path, batch)
    folder = state.current_run(spark, path).folder
    tail, version = state.load_tail(spark, folder)
    assert version == 2 and tail.groupBy("shop").count().agg(F.max("count")).first()[0] == 14
    before = sorted(map(str, tail.collect()))
    assert remember(spark, path, days(raw, "2023-04-25", "2023-05-02"), 2) == 2
    assert sorted(map(str, state.load_tail(spark, folder)[0].collect())) == before
    assert files.names(spark, f"{folder}/tails") == ["0000000000", "0000000001", "0000000002"]
    assert state.load_tail(spark, folder, before=1)[1] == 0


def test_reference_grows_with_batches(spark, tmp_path):
    raw, path = panel(spark, days=120).cache(), str(tmp_path / "state")
    save(train(days(raw, "2023-01-01", "2023-04-20"), config()), spark, path)
    doubled = days(raw, "2023-04-20").withColumn("sales", F.col("sales") * 2)
    current = align(spark, path, doubled)
    plain, first = (health(spark, path, current, extended=e).first() for e in (False, True))
    assert abs(first.data_drift_share - plain.data_drift_share) < 0.15 and plain.data_drift_share > 0
    assert extend_reference(spark, path, current) == 1 and extend_reference(spark, path, current, 1) == 1
    folder = state.current_run(spark, path).folder
    merged = {r["column"]: r for r in sketches.merge_sketches(state.load_sketches(spark, folder)[0]).collect()}
    known = align(spark, path, days(raw, "2023-01-01", "2023-04-20"), tails=False)
    assert merged["sales"].n == known.count() + current.count()
    assert merged["sales"].high == current.agg(F.max("sales")).first()[0]
    assert state.load_reference(spark, f"{folder}/reference").edges["sales"][-1] < merged["sales"].high
    again = health(spark, path, current, extended=True).first()
    assert again.status and again.rows_compared == current.count()


def test_a_posted_row_replaces_a_remembered_one(spark):
    tail = spark.createDataFrame([("a", date(2024, 1, 1), 5.0), ("b", date(2024, 1, 1), 6.0), (None, date(2024, 1, 1), 1.0)],
                                 "shop string, day date, sales double")
    posted = spark.createDataFrame([("a", date(2024, 1, 1), 7), ("a", date(2024, 1, 2), 8), (None, date(2024, 1, 1), 2)],
                                   "shop string, day date, sales int")
    roles = ROLES.with_(numeric=(), categorical=())
    got = {(r.shop, r.day.day, r.sales, r._posted) for r in tails.continued(tail, posted, roles).collect()}
    assert got == {("a", 1, 7.0, True), ("a", 2, 8.0, True), (None, 1, 2.0, True)}
    kept = {(r.shop, r.day.day, r.sales) for r in tails.next_tail(tail, posted, roles, 1).collect()}
    assert kept == {("a", 2, 8.0), ("b", 1, 6.0), (None, 1, 2.0)}


@pytest.mark.parametrize("layout", [Layout("series"), Layout("blocks", 40, 3600)])
def test_hot_series_in_batches_equal_one_piece(spark, layout):
    rows = sorted(tick_rows(600), key=lambda r: r[1:3])
    whole = with_features(spark.createDataFrame(rows, TICK_SCHEMA), TICKS, layout=layout)
    tail, parts = None, []
    for a, b in ((0, 90), (90, 95), (95, 400), (400, 600)):
        batch = spark.createDataFrame(rows[a:b], TICK_SCHEMA)
        parts.append(tails.posted_features(tail, batch, TICKS, layout=layout))
        tail = tails.next_tail(tail, batch, TICKS, tails.reach()).cache()
        assert tail.groupBy("sensor").count().agg(F.max("count")).first()[0] <= 14
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    plain = [F.round(c, 6).alias(c) if t == "double" else c for c, t in whole.dtypes]
    got, whole = got.select(*plain), whole.select(*plain)
    assert got.count() == 600 and got.exceptAll(whole).count() == 0


def test_filled_calendar_reaches_back(spark, tmp_path):
    raw = panel(spark, days=120).where("dayofweek(day) <> 4")
    path = str(tmp_path / "state")
    save(train(days(raw, "2023-01-01", "2023-04-20"), config(densify_days=1)), spark, path)
    got = align(spark, path, days(raw, "2023-04-24"))
    whole = align(spark, path, days(raw, "2023-01-01").where("day < '2023-04-20' or day >= '2023-04-24'"), tails=False)
    wanted = days(whole, "2023-04-24").select(*got.columns)
    assert got.count() == wanted.count() > 0 and got.exceptAll(wanted).count() == 0


def test_stream_reaches_across_batches(spark, stored, tmp_path):
    raw, _ = stored
    path, inbox = str(tmp_path / "state"), str(tmp_path / "inbox")
    save(train(days(raw, "2023-01-01", "2023-04-20"), config()), spark, path)
    for start, end in (("2023-04-20", "2023-04-24"), ("2023-04-24", "2023-04-27")):
        days(raw, start, end).coalesce(1).write.mode("append").json(inbox)
        watch_posted(spark, inbox, raw.schema, path, str(tmp_path / "reports"), str(tmp_path / "check")
                     ).awaitTermination(300)
    found = spark.read.parquet(str(tmp_path / "reports")).orderBy("batch").collect()
    assert [r.rows_compared for r in found] == [12, 9]
    tail, version = state.load_tail(spark, state.current_run(spark, path).folder)
    assert version == 2 and tail.agg(F.max("day")).first()[0] == date(2023, 4, 26)


# ---- champions ------------------------------------------------------------------------


def steady(spark, level, start=date(2023, 1, 2), n=150, seed=5):
    rng = random.Random(seed)
    rows = [(f"s{s}", start + timedelta(days=d), level * (1 + 0.05 * s) + 3 * math.sin(d / 5) + rng.random())
            for s in range(3) for d in range(n)]
    return spark.createDataFrame(rows, "shop string, day date, sales double")


def test_a_better_model_replaces_one_with_a_better_old_score(spark, tmp_path):
    """Sales change their regime; the stored metric of the old model was taken before that."""
    path, settings = str(tmp_path / "state"), config(selection_metric="rmse")
    save(train(steady(spark, 1000.0), settings), spark, path, "v1")
    rng = random.Random(9)
    jumpy = spark.createDataFrame(
        [(f"s{s}", date(2023, 6, 1) + timedelta(days=d), 20.0 + 18 * (-1) ** d + 4 * rng.random())
         for s in range(3) for d in range(150)], "shop string, day date, sales double")
    old = state.current_run(spark, path)
    found = retrain_if_needed(spark, jumpy, path, settings, "v2")
    new = {r.model_name: r.rmse for r in found.duel.collect()}
    assert new["challenger"] > old.metrics["ridge"].rmse  # by stored metrics it would be refused
    assert new["challenger"] < new["champion"]
    assert state.current_run(spark, path).model_version == "v2"


def test_duel_uses_common_windows_and_each_models_settings(spark, tmp_path):
    path, raw = str(tmp_path / "state"), steady(spark, 100.0)
    mean = "array(aggregate(past, 0D, (total, x) -> total + x) / greatest(size(past), 1))"
    line = models.DirectForecaster("line", lambda: models.ridge(regParam=0.0, solver="normal"), mean)
    save(train(raw, config(candidates=[line], lookback=7, horizon=5, lags=(1, 2), rolls=(3,))), spark, path)
    champion = load_champion(spark, path)
    trained = train(raw, config(candidates=[line]), champion)
    scored = {r.model_name: r for r in trained.duel.collect()}
    rows = {s: [r.sales for r in raw.where(f"shop = '{s}'").orderBy("day").collect()] for s in ("s0", "s1", "s2")}
    steps = [m.coefficients[0] for m in champion.model.steps], [m.intercept for m in champion.model.steps]
    errors = []
    for y in rows.values():
        y = y[14:]  # the challenger's features drop the first rows
        n = len(y) - 20
        for i in range(int(n * 0.8), n):
            at = i + 14
            x = sum(y[at - 7: at]) / 7
            errors += [y[at + h] - (steps[0][h] * x + steps[1][h]) for h in range(5)]
    assert scored["champion"].rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / len(errors)))
    assert scored["challenger"].mae > 0


def test_no_common_window(spark):
    test = spark.createDataFrame([("a", [1.0, 2.0], [1.0, 1.0])], "k string, future array<double>, _challenger array<double>")
    rival = spark.createDataFrame([("b", [1.0])], "k string, prediction array<double>")
    assert evaluate.rescored(test, rival, ["k"]).count() == 0
    same = spark.createDataFrame([("a", [3.0])], "k string, prediction array<double>")
    got = {r.model_name: r.mae for r in evaluate.rescored(test, same, ["k"]).collect()}
    assert got == {"champion": 2.0, "challenger": 0.0}  # one step, that both predict


def test_baselines_are_stored_by_name(spark, tmp_path):
    raw = steady(spark, 100.0)
    alone = train(raw, config(candidates=[], baselines={"moving_average": models.moving_average(7)}))
    with pytest.raises(ValueError, match="cannot be served"):
        save(alone, spark, str(tmp_path / "none"))
    assert state.current_run(spark, str(tmp_path / "none")) is None
    for kind in ("moving_average", "weekday"):
        path = str(tmp_path / kind)
        trained = train(raw, config(candidates=[models.BaselineForecaster(kind, "day")]))
        assert trained.best == kind
        save(trained, spark, path)
        rows = Forecaster(spark, path).rows(raw).where("shop = 's0'").orderBy("step").collect()
        mean = raw.where("shop = 's0'").orderBy(F.desc("day")).limit(14).agg(F.avg("sales")).first()[0]
        factor = [0.3 if r.date.weekday() == 6 else 0.8 if r.date.weekday() in (4, 5) else 1.0 for r in rows]
        wanted = [mean * (f if kind == "weekday" else 1) for f in factor]
        assert [r.forecast for r in rows] == pytest.approx(wanted)
    with pytest.raises(ValueError, match="no baseline"):
        models.BaselineModel("other", None, 7).predict(raw)


# ---- run log and readers --------------------------------------------------------------


def run_frame(spark, version, approved=True, when=datetime(2024, 1, 1)):
    row = (when, "ridge", version, 7, 14, {}, ("day", "sales", "shop", "D"), [], [], "m", [1], [7], None, "f", approved, None)
    return spark.createDataFrame([row], state.RUN_SCHEMA)


def test_later_versions_win_whatever_the_clock_says(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert state.append_run(run_frame(spark, "v1", when=datetime(2030, 1, 1)), path) == 1
    assert state.append_run(run_frame(spark, "v2", when=datetime(2020, 1, 1)), path) == 2
    assert state.latest_run(state.read_runs(spark, path)).first().model_version == "v2"
    assert state.append_run(run_frame(spark, "v3", approved=False), path) == 3
    assert state.latest_run(state.read_runs(spark, path)).first().model_version == "v2"


def test_of_two_writers_one_is_approved(spark, tmp_path):
    path = str(tmp_path / "runs")
    state.append_run(run_frame(spark, "v0"), path)
    seen = state.last_version(spark, path)  # both decide on this version
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda v: state.append_run(run_frame(spark, v), path, seen), ["a", "b", "c", "d"]))
    runs = state.read_runs(spark, path)
    assert sorted(got) == [2, 3, 4, 5] and runs.count() == 5
    assert runs.where("log_version > 1 and approved").count() == 1


def test_a_file_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/x.json"
    assert files.create_new(spark, path, "one\n") and not files.create_new(spark, path, "two\n")
    assert [r.value for r in spark.read.text(path).collect()] == ["one"]
    assert files.names(spark, f"{tmp_path}/none") == []


def test_row_cap_reads_text_dates(spark):
    from shelfwise.operators import prep

    rows = [("a", "02/01/2024"), ("a", "01/02/2024"), ("a", "03/12/2023"), ("a", "?")]
    df = spark.createDataFrame(rows, "shop string, day string")
    got = prep.row_cap(df, ROLES, 2, ["dd/MM/yyyy"]).collect()
    assert [r.day for r in got] == ["03/12/2023", "02/01/2024"]
    assert prep.row_cap(df, ROLES, 9, ["dd/MM/yyyy"]).collect()[-1].day == "?"


def test_csv_rows_are_the_first_lines(spark, tmp_path):
    for f, start in (("b.csv", 5000), ("a.csv", 0)):
        (tmp_path / f).write_text("n,t\n" + "\n".join(f"{start + i},x" for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = [r.n for r in read_csv(spark, str(tmp_path), rows=5010).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == list(range(5010))
