import pytest
from frames import panel

from shelfwise.operators.profile import duplicate_rows, profile, profile_columns, profile_table
from shelfwise.operators.roles import (
    Roles,
    classify_features,
    column_evidence,
    detect_roles,
    frequency,
    target_by_variance,
)


def messy(spark):
    rows = [
        (float(i % 3), None if i % 2 else 1, "x", f"name {i}", None, float("nan"))
        for i in range(60)
    ]
    rows += rows[:5] + [(-0.0, 1, "x", "name 0", None, float("nan"))]
    schema = "a double, b int, same string, label string, nothing string, gap double"
    return spark.createDataFrame(rows, schema)


def test_profile(spark):
    p = profile(messy(spark))
    assert (p.n_rows, p.n_columns) == (66, 6)
    assert p.missing == {"a": 0, "b": 32, "same": 0, "label": 0, "nothing": 66, "gap": 66}
    assert {c: s["nunique"] for c, s in p.statistics.items()} == {
        "a": 3, "b": 1, "same": 1, "label": 60, "nothing": 0, "gap": 0
    }
    assert p.constant_columns == ["same", "nothing", "gap"]  # b holds 1 and NULL
    assert p.high_cardinality == ["label"]
    assert p.duplicate_rows == 6  # -0.0 equals 0.0
    assert p.warnings == [
        "Constant columns (no signal): ['same', 'nothing', 'gap']",
        "6 duplicate rows.",
        "Columns >40% missing: ['b', 'nothing', 'gap']",
    ]
    assert profile_table(messy(spark)).first()["warnings"] == p.warnings


def test_approximate_profile(spark):
    exact = {r["column"]: r for r in profile_columns(messy(spark)).collect()}
    rough = {r["column"]: r for r in profile_columns(messy(spark), exact=False).collect()}
    for c, r in exact.items():
        assert rough[c].missing == r.missing and rough[c].is_constant == r.is_constant
        assert abs(rough[c].nunique - r.nunique) <= 4


def test_long_texts_and_complex_values(spark):
    base = "z" * 5000
    df = spark.createDataFrame(
        [(base + "1", [1, 2], b"a"), (base + "2", [1, 2], b"b"), (base + "1", [1], b"a")],
        "t string, l array<int>, b binary",
    )
    assert [r.nunique for r in profile_columns(df).orderBy("position").collect()] == [2, 2, 2]
    assert duplicate_rows(df).first()[0] == 0
    assert duplicate_rows(df.union(df)).first()[0] == 3


def test_empty_table(spark):
    p = profile(spark.createDataFrame([], "a int, b string"))
    assert p.n_rows == 0 and p.duplicate_rows == 0 and p.constant_columns == ["a", "b"]


RETAIL = ("Store int, Date string, Sales double, Open int, Promo int, DayOfWeek int, "
          "StoreType string, Temp double")


def retail(spark):
    rows = [
        (s, f"2015-{1 + d // 28:02d}-{1 + d % 28:02d}", 100.0 + d, d % 2, d % 3, d % 7,
         "ab"[s % 2], 20.5 + d)
        for s in (1, 2) for d in range(60)
    ]
    return spark.createDataFrame(rows, RETAIL)


def test_retail_roles(spark):
    r = detect_roles(retail(spark))
    assert (r.date, r.target, r.series, r.frequency) == ("Date", "Sales", "Store", "D")
    assert r.numeric == ("Temp",)
    assert r.categorical == ("Open", "Promo", "DayOfWeek", "StoreType")
    assert r.confidence == {"date": 1.0, "target": 0.9} and r.notes == ()
    assert Roles.from_dict(r.to_dict()) == r
    assert r.to_frame(spark).first()["group_column"] == "Store"


def test_overrides(spark):
    df = retail(spark)
    r = detect_roles(df, {"target_column": "Temp", "numerical_features": [], "frequency": "W"})
    assert r.target == "Temp" and r.numeric == () and r.frequency == "W"
    everything = {
        "date_column": "Date", "target_column": "Sales", "group_column": "Store",
        "numerical_features": ["Temp"], "categorical_features": [], "frequency": "D",
    }
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    assert detect_roles(df, everything).numeric == ("Temp",)
    assert len(tracker.getJobIdsForGroup(None)) == before  # no job


def test_uncertain_date_and_variance_target(spark):
    rows = [("2024-01-01" if i < 50 else "?", i, i * 100.0, i) for i in range(100)]
    df = spark.createDataFrame(rows, "when_seen string, a int, wide double, item_id int")
    r = detect_roles(df)
    assert r.date == "when_seen" and r.confidence["date"] == 0.5
    assert r.target == "wide" and r.confidence["target"] == 0.5
    assert r.series == "item_id" and len(r.notes) == 2
    assert target_by_variance(df).first()["column"] == "wide"
    with pytest.raises(ValueError, match="target"):
        detect_roles(df.select("when_seen", "item_id"))


def test_first_typed_date_wins(spark):
    df = spark.sql("select '2024-01-01' as a, date'2024-01-01' as b, timestamp'2024-01-01' as c, 5 as v")
    assert detect_roles(df).date == "b"


def test_small_integers(spark):
    rows = [(i % 3 - 1, i % 15 - 1, float(i % 4), i / 2, None, i % 2 == 0, i % 14 - 1)
            for i in range(60)]
    df = spark.createDataFrame(
        rows, "flag int, wide int, whole double, half double, empty int, yes boolean, all14 int")
    kinds = {r["column"]: r.kind for r in classify_features(df, []).collect()}
    assert kinds == {
        "flag": "categorical", "wide": "numeric", "whole": "categorical", "half": "numeric",
        "empty": "categorical", "yes": "categorical", "all14": "numeric",  # 14 values are too many
    }
    assert column_evidence(df).count() == 7


@pytest.mark.parametrize("days, want", [
    ([0, 1, 2, 3], "D"), ([0, 7, 14, 21], "W"), ([0, 30, 60], "30D"), ([0, 1], None),
    ([0, 0, 0], None), ([0, 1, 3], "D"), ([0, 2, 5], "2D"),
])
def test_frequency(spark, days, want):
    rows = [(d,) for d in days]
    df = spark.createDataFrame(rows, "d int").selectExpr("date_add(date'2024-01-01', d) as day")
    assert frequency(df, "day").first()[0] == want
    texts = df.selectExpr("cast(day as string) as day")
    assert frequency(texts, "day").first()[0] == want


def test_frequency_of_times(spark):
    # hours inside a day do not count; night gaps below 24 hours do not either
    hours = spark.range(100).selectExpr("timestamp'2024-01-01' + make_interval(0,0,0,0,id) as t")
    assert frequency(hours, "t").first()[0] is None
    two = spark.range(60).selectExpr(
        "timestamp'2024-01-01 06:00' + make_interval(0,0,0,id div 2 * 2,0,id % 2) as t")
    # gaps: one minute, then 47 h 59 min = 1 day
    assert frequency(two, "t").first()[0] == "D"
    days = panel(spark)
    assert frequency(days, "day").first()[0] == "D"


def test_frequency_needs_three_times(spark):
    def of(*times):
        df = spark.createDataFrame([(t,) for t in times], "t string")
        return frequency(df.selectExpr("cast(t as timestamp) as t"), "t").first()[0]

    assert of("2024-01-01", "2024-01-08", "2024-01-08") is None
    assert of("2024-01-01 00:00", "2024-01-08 05:00", "2024-01-08 06:00") == "W"
    assert of("2024-01-01 01:00", "2024-01-01 02:00", "2024-01-01 03:00") is None
