"""Both layouts against brute force: lags, means, windows, positions."""

from collections import defaultdict

import pytest
from frames import ROLES, TICKS, panel, panel_rows, tick_rows, ticks
from pyspark.sql import functions as F

from shelfwise.operators.features import feature_frame, lag_features, rolling_features
from shelfwise.operators.ordering import Layout, last_rows, measured_layout, with_positions
from shelfwise.operators.roles import Roles
from shelfwise.operators.windows import (
    horizon_long,
    latest_window,
    sliding_windows,
    split_windows,
    window_count,
)

LAYOUTS = [Layout("series"), Layout("blocks", 7, 3600), Layout("blocks", 40, 60), Layout("sorted", 25),
           Layout("auto")]


def sensors():
    groups = defaultdict(list)
    for r in sorted(tick_rows(), key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    return groups


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_positions(spark, layout):
    want = {r[2]: (i, len(g)) for g in sensors().values() for i, r in enumerate(g)}
    got = {r.seq: (r._pos, r._n) for r in with_positions(ticks(spark), TICKS, layout).collect()}
    assert got == want


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_lags_and_means(spark, layout):
    want = {}
    for g in sensors().values():
        v = [r[3] for r in g]
        for i, r in enumerate(g):
            lag = [v[i - n] if i >= n else None for n in (1, 7, 14)]
            mean = [sum(v[i - n:i]) / n if i >= n else None for n in (7, 14)]
            want[r[2]] = (*lag, *(None if m is None else round(m, 6) for m in mean))
    lagged = lag_features(ticks(spark), TICKS, layout=layout)
    both = rolling_features(lagged, TICKS, layout=layout)
    names = ["value_lag1", "value_lag7", "value_lag14", "value_roll7", "value_roll14"]
    got = {
        r["seq"]: tuple(None if r[c] is None else round(r[c], 6) for c in names)
        for r in both.collect()
    }
    assert got == want
    assert set(both.columns) == {"sensor", "at", "seq", "value", "load", *names}


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_windows(spark, layout):
    L, H = 5, 3
    found = sliding_windows(ticks(spark), TICKS, L, H, ["load"], sequence=True, layout=layout)
    got = {r.seq: r for r in found.collect()}
    n = 0
    for g in sensors().values():
        for i in range(L, len(g) - H + 1):
            n += 1
            r = got[g[i][2]]
            assert r.past == [x[3] for x in g[i - L:i]]
            assert r.future == [x[3] for x in g[i:i + H]]
            assert r.tabular == r.past + [g[i][4]]
            assert r.steps == [[x[3], x[4]] for x in g[i - L:i]]
            assert r.window_index == i - L and r.n_windows == len(g) - L - H + 1
            assert r.end_date == g[i + H - 1][1].date()
    assert len(got) == n


def test_layouts_agree_on_a_daily_panel(spark):
    a = feature_frame(panel(spark), ROLES, layout=Layout("series"))
    b = feature_frame(panel(spark), ROLES, layout=Layout("blocks", 20))
    assert a.count() > 100
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_series_without_key(spark):
    rows = [(r[1], r[2]) for r in panel_rows(days=40, shops=1)]
    df = spark.createDataFrame(rows, "day date, sales double")
    roles = Roles("day", "sales")
    ordered = [v for _, v in sorted(rows)]
    for layout in (Layout("series"), Layout("blocks", 9)):
        got = [r.sales_lag7 for r in lag_features(df, roles, layout=layout).orderBy("day").collect()]
        assert got == [None] * 7 + ordered[:-7]


def test_missing_series_key_is_its_own_series(spark):
    rows = [(None, r[1], r[2]) for r in panel_rows(days=20, shops=1)]
    df = spark.createDataFrame(rows, "shop string, day date, sales double")
    roles = Roles("day", "sales", "shop")
    for layout in (Layout("series"), Layout("blocks", 16)):
        found = lag_features(df, roles, layout=layout)
        assert found.where("sales_lag14 is not null").count() == 6


def test_measured_layout(spark):
    assert measured_layout(ticks(spark), TICKS, 100).kind == "blocks"
    assert measured_layout(ticks(spark), TICKS, 10_000).kind == "series"
    assert measured_layout(ticks(spark), TICKS, 2).kind == "sorted"
    assert measured_layout(panel(spark), ROLES, 1000).kind == "series"


def test_tie_break_is_no_feature(spark):
    from shelfwise.operators.features import feature_columns
    from shelfwise.sources.state import reference_sample

    assert feature_columns(ticks(spark), TICKS) == ["load"]
    assert reference_sample(ticks(spark), TICKS).columns == ["value", "load"]


def test_last_rows(spark):
    got = {(r.sensor, r._back): r.seq for r in last_rows(ticks(spark), TICKS, 3).collect()}
    want = {(s, b + 1): r[2] for s, g in sensors().items() for b, r in enumerate(g[::-1][:3])}
    assert got == want


def test_last_rows_limits_before_the_shuffle(spark):
    plan = last_rows(ticks(spark), TICKS, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_split_is_chronological_per_series(spark):
    w = split_windows(sliding_windows(ticks(spark), TICKS, 5, 3, []))
    rows = defaultdict(list)
    for r in w.collect():
        rows[r.sensor].append((r.window_index, r.is_train))
    for group in rows.values():
        flags = [t for _, t in sorted(group)]
        assert flags == sorted(flags, reverse=True)
        assert sum(flags) == int(0.8 * len(flags))


def test_window_count_latest_and_long(spark):
    # 46 rows, 14 back and 7 ahead: 26 windows
    df = panel(spark, days=46, shops=2)
    counted = {r.shop: r.n_windows for r in window_count(df, ROLES).collect()}
    assert counted == {"s0": 26, "s1": 26}
    windows = sliding_windows(df, ROLES, features=["temp"])
    assert windows.count() == 52
    assert [r.window_index for r in latest_window(windows).collect()] == [25, 25]
    assert horizon_long(windows, ["shop", "day"]).count() == 52 * 7
    short = panel(spark, days=34, shops=1)
    # lags and means up to 14 leave 20 rows: not one full window
    frame = feature_frame(short, ROLES.with_(categorical=("promo",)))
    assert sliding_windows(frame, ROLES).count() == 0


def test_plan_of_the_daily_layout_has_one_shuffle(spark):
    frame = feature_frame(panel(spark), ROLES, layout=Layout("series"))
    windows = sliding_windows(frame, ROLES, sequence=True, layout=Layout("series"))
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort") == 1


def test_auto_measures(spark):
    """One hour that holds most rows of a series is not one window partition."""
    hot = spark.range(900).selectExpr(
        "'a' AS sensor", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 60) AS at",
        "id AS seq", "id * 1.0D AS value", "0.5D AS load")
    assert measured_layout(hot, TICKS).kind == "series"
    assert measured_layout(hot, TICKS, max_rows=300).kind == "sorted"
    days = hot.withColumn("at", F.col("at") + F.expr("make_dt_interval(cast(seq % 9 AS int))"))
    assert measured_layout(days, TICKS, max_rows=300).kind == "blocks"
    assert Layout().resolve(days, TICKS) == "series"
