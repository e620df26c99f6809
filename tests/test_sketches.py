"""Merged sketches against the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import drift, profile, sketches

SCHEMA = "id long, part int, x double, few double, text string, flag boolean, none double"


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(6)
    rows = []
    for i in range(6000):
        rows.append((i, draw.randint(0, 3), draw.choice([None, float("nan")]) if draw.random() < 0.2 else draw.lognormvariate(0, 2),
                     float(draw.choice([1, 2, 2, 2, 3])), f"t{draw.randint(0, 70)}", draw.random() < 0.5, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def parts(df):
    return [df.where(F.col("part") == p) for p in range(4)]


def test_merged_reference(spark, table):
    columns = ["x", "few", "flag", "none"]
    merged = sketches.merge_sketches(*[sketches.column_sketches(p, columns) for p in parts(table)])
    found, exact = sketches.sketched_reference(merged), drift.fit_reference(table, columns)
    assert set(found.columns) == set(columns)
    assert found.edges["few"] == exact.edges["few"]
    assert all(abs(a - b) <= 2 * sketches.RANK_ERROR * 6000 for a, b in zip(found.counts["few"], exact.counts["few"]))
    assert found.edges["flag"] == exact.edges["flag"] and found.edges["none"] == []
    known = [r.x for r in table.where("x is not null and not isnan(x)").collect()]
    assert (found.edges["x"][0], found.edges["x"][-1]) == (min(known), max(known))
    for i, e in enumerate(found.edges["x"]):
        under, upto = sum(v < e for v in known) / len(known), sum(v <= e for v in known) / len(known)
        assert under - sketches.RANK_ERROR <= i / 10 <= upto + sketches.RANK_ERROR
    assert sum(found.counts["x"]) == len(known)
    assert all(abs(a - b) <= 2 * sketches.RANK_ERROR * len(known) + 1 for a, b in zip(found.counts["x"], exact.counts["x"]))
    moved = table.withColumn("x", F.col("x") * 5)
    a, b = ({r["column"]: r.score for r in drift.column_psi(f, moved).collect()} for f in (found, exact))
    assert a["x"] == pytest.approx(b["x"], rel=0.05) and a["few"] == pytest.approx(b["few"], abs=1e-3)


def test_merged_in_any_order(spark, table):
    made = [sketches.column_sketches(p, ["x"]) for p in parts(table)]
    step = sketches.merge_sketches(sketches.merge_sketches(*made[:2]), sketches.merge_sketches(*made[2:]))
    once = sketches.merge_sketches(*made[::-1])
    assert step.select("n", "low", "high").first() == once.select("n", "low", "high").first()
    empty = sketches.column_sketches(table.limit(0), ["x"])
    assert sketches.sketched_reference(sketches.merge_sketches(empty, empty)).edges == {"x": []}
    more = sketches.merge_sketches(empty, made[0])
    assert more.first().n == parts(table)[0].where("x is not null and not isnan(x)").count()


def test_merged_profile(spark, table):
    df = table.drop("part")
    halves = [df.where("id % 2 = 0"), df.where("id % 2 = 1")]
    state = sketches.merge_states(*[sketches.profile_state(h) for h in halves])
    found = {r["column"]: r for r in sketches.profile_of(state).collect()}
    for r in profile.profile_columns(df).collect():
        f = found[r["column"]]
        assert (f.position, f.dtype, f.n_rows, f.missing) == (r.position, r.dtype, r.n_rows, r.missing)
        assert abs(f.nunique - r.nunique) <= 4 * sketches.DISTINCT_ERROR * r.nunique
        assert (f.is_constant, f.is_high_cardinality, f.is_heavy_missing) == (
            r.is_constant, r.is_high_cardinality, r.is_heavy_missing)
    assert found["text"].nunique == 71 and found["none"].nunique == 0


def test_estimated_duplicates(spark, table):
    twice = table.unionByName(table.where("id < 3000"))
    r = sketches.duplicates_of(sketches.merge_states(*[sketches.profile_state(p) for p in parts(twice)])).first()
    assert r.n_rows == 9000 and abs(r.duplicate_rows - 3000) < 300 and r.warning.startswith("About ")
    none = sketches.duplicates_of(sketches.profile_state(table)).first()
    assert none.duplicate_rows < 200 and none.warning is None
    pairs = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert sketches.duplicates_of(sketches.profile_state(pairs)).first().duplicate_rows == 1
