import math

import pytest
from frames import ROLES, panel, panel_rows

from shelfwise.operators import prep
from shelfwise.operators.features import densify
from shelfwise.operators.roles import Roles


def test_encoder_golden(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("10",), ("2",)], "c string")
    for bound in (100, 2):
        codes, n = prep.fit_codes(df, ["c"], bound)
        got = {r.category: r.code for r in codes.collect()}
        assert got == {"10": 0, "2": 1, "NA": 2, "a": 3, "b": 4} and n == 5
        new = spark.createDataFrame([("a",), ("zzz",), (None,)], "c string")
        out = prep.encode(new, ["c"], codes, n, bound).collect()
        assert sorted(r.c for r in out) == [-1.0, 2.0, 3.0]


def test_many_categories_and_a_hot_one(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 400}", f"é{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, c string, d string").repartition(6)
    small, n_small = prep.fit_codes(df, ["c", "d"])
    large, n_large = prep.fit_codes(df, ["c", "d"], bound=10)
    as_set = lambda t: {(r["column"], r.category, r.code) for r in t.collect()}
    assert as_set(small) == as_set(large) and n_small == n_large
    names = sorted({r[1] for r in rows}, key=str.encode)
    want = {r[0]: names.index(r[1]) for r in rows}
    for codes, bound in ((small, 50_000), (large, 10)):
        out = prep.encode(df, ["c", "d"], codes, n_large, bound)
        assert out.columns == ["id", "c", "d"]
        assert {r.id: r.c for r in out.collect()} == want


def test_scaler_golden(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, k double")
    s = prep.fit_scales(df, ["x", "k"])
    assert s["x"].std == pytest.approx(1.2472191, abs=1e-7) and s["k"].std == 1.0
    out = [r.k for r in prep.scale(df, s).collect()]
    assert out == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("small_rows", [3, 1000])
def test_scaler_after_filling(spark, small_rows):
    values = [None, 3.0, float("nan"), 10.0, 1.0, 2.0, None, 8.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = prep.fit_scales(df, ["x"], small_rows)["x"]
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    assert s.median == 3.0 == known[2]
    filled = known + [3.0] * 3
    mean = sum(filled) / 8
    assert s.mean == pytest.approx(mean)
    assert s.std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in filled) / 8))


def test_preprocessor(spark):
    df = panel(spark, gaps=True)
    pre = prep.Preprocessor()
    out = pre.fit_transform(df, ROLES)
    assert out.columns == df.columns and out.count() == df.count()
    stats = out.selectExpr("avg(temp)", "stddev_pop(temp)", "count_if(temp is null)").first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    assert stats[2] == 0
    assert {r.kind for r in out.select("kind").distinct().collect()} == {0.0, 1.0, 2.0}
    # target, date and series stay as they are
    assert out.select("shop", "day", "sales").exceptAll(df.select("shop", "day", "sales")).count() == 0


def test_fill_from_batch(spark):
    fit = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 3.0)], "d string, x double")
    roles = Roles("d", "y", numeric=("x",))
    new = spark.createDataFrame([("2024-01-03", None), ("2024-01-04", 9.0)], "d string, x double")
    one = prep.Preprocessor().fit(fit, roles).transform(new).collect()
    assert sorted(r.x for r in one) == [0.0, 7.0]
    two = prep.Preprocessor(impute_from="batch").fit(fit, roles).transform(new).collect()
    assert [r.x for r in two] == [7.0, 7.0]


def test_parse_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("05/02/2024",), ("soon",), (None,)], "d string")
    out = prep.parse_dates(df, "d", ["dd/MM/yyyy"], as_date=True)
    assert sorted(str(r.d) for r in out.collect()) == ["2024-01-05", "2024-02-05"]
    assert prep.parse_dates(df, "d").count() == 1


def test_filter_cap_and_sort(spark):
    df = panel(spark)
    assert prep.filter_series(df, "shop", "s1").count() == 90
    assert prep.filter_series(df, "shop", None).count() == 270
    zero = spark.createDataFrame([(0,), (1,)], "g int")
    assert prep.filter_series(zero, "g", 0).count() == 1  # 0 names a series
    capped = [(r.shop, r.day) for r in prep.row_cap(df, ROLES, 100).collect()]
    assert capped == sorted((r[0], r[1]) for r in panel_rows())[:100]


def test_panel_combines_rows_of_one_day(spark):
    from pyspark.sql import functions as F

    df = panel(spark, days=5)
    twice = prep.to_panel(df.union(df), "shop", "day", {"sales": F.sum("sales")})
    assert twice.count() == 15


def test_densify(spark):
    df = panel(spark, days=10, shops=2).where("day not in (date'2023-01-04', date'2023-01-05')")
    full = densify(df, ROLES, fill=0.0)
    assert full.count() == 20 and full.where("sales = 0").count() == 4
    assert full.columns == df.columns


def test_long_categories_are_not_collected(spark):
    rows = [(i, f"{i % 4}" + "x" * 5000) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, c string")
    small, n = prep.fit_codes(df, ["c"])
    large, m = prep.fit_codes(df, ["c"], max_bytes=1000)
    assert n == m == 4 and sorted(small.collect()) == sorted(large.collect())
    got = prep.encode(df, ["c"], large, m, max_bytes=1000)
    assert {(r.id, r.c) for r in got.collect()} == {(i, float(i % 4)) for i in range(40)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
