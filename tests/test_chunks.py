"""Windows cut from chunks are the sliding windows, at a fraction of the memory."""

import pytest
from frames import PANEL_SCHEMA, ROLES, TICKS, panel_rows, ticks
from pyspark import StorageLevel
from pyspark.sql import functions as F

from shelfwise.operators.ordering import PANEL, Layout
from shelfwise.operators.windows import chunk_windows, series_chunks, sliding_windows


def same(a, b):
    columns = [F.col(c) for c in b.columns]
    assert a.columns == b.columns
    assert a.count() == b.count() and a.select(*columns).exceptAll(b).count() == 0


@pytest.mark.parametrize("rows", [1, 30, 1024])
@pytest.mark.parametrize("lookback, horizon", [(14, 7), (1, 1), (5, 9)])
def test_panel(spark, rows, lookback, horizon):
    df = spark.createDataFrame([r for r in panel_rows(days=60) if r[3] is not None], PANEL_SCHEMA)
    names = ["temp", "promo"]
    wanted = sliding_windows(df, ROLES, lookback, horizon, names, True, PANEL)
    chunks = series_chunks(df, ROLES, lookback, horizon, names, PANEL, rows)
    same(chunk_windows(chunks, ROLES, lookback, horizon, True, rows), wanted)


@pytest.mark.parametrize("layout", [Layout("series"), Layout("blocks", 50, 3600)])
def test_hot_series_with_ties(spark, layout):
    df = ticks(spark, 500)
    wanted = sliding_windows(df, TICKS, 14, 7, ["load"], False, layout)
    chunks = series_chunks(df, TICKS, 14, 7, ["load"], layout, 40)
    same(chunk_windows(chunks, TICKS, 14, 7, False, 40), wanted)
    assert chunks.agg(F.max(F.size("cells"))).first()[0] <= 40 + 14 + 6


def test_short_series_and_none(spark):
    df = spark.createDataFrame(panel_rows(days=21, shops=2), PANEL_SCHEMA).where("shop = 's0' or day < '2023-01-20'")
    found = chunk_windows(series_chunks(df, ROLES, features=["promo"], layout=PANEL), ROLES)
    assert [r["shop"] for r in found.collect()] == ["s0"]
    assert chunk_windows(series_chunks(df.limit(0), ROLES, features=["promo"], layout=PANEL), ROLES).count() == 0


def kept_bytes(spark, df):
    before = {i.id() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    df.persist(StorageLevel.MEMORY_ONLY).count()
    size = sum(i.memSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.id() not in before)
    df.unpersist(True)
    return size


def test_memory(spark):
    df = spark.createDataFrame(panel_rows(days=1500, shops=2), PANEL_SCHEMA).withColumn("a", F.rand(1)).withColumn("b", F.rand(2))
    names = ["promo", "a", "b"]
    whole = kept_bytes(spark, sliding_windows(df, ROLES, features=names, sequence=True, layout=PANEL))
    chunks = kept_bytes(spark, series_chunks(df, ROLES, features=names, layout=PANEL))
    assert 0 < 3 * chunks < whole  # compressed: overlapping windows repeat their numbers
    count = lambda df, c: df.select(F.sum(c)).first()[0]
    windows = sliding_windows(df, ROLES, features=names, sequence=True, layout=PANEL)
    numbers = F.size("past") + F.size("future") + F.size("tabular") + F.size(F.flatten("steps"))
    cells = series_chunks(df, ROLES, features=names, layout=PANEL)
    assert count(windows, numbers) > 15 * count(cells, F.size("cells") * (1 + len(names)))
