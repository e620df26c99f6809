"""Small panels for the tests."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

from shelfwise.operators.roles import Roles

ROLES = Roles("day", "sales", "shop", numeric=("temp",), categorical=("promo", "kind"))


def panel_rows(days: int = 90, shops: int = 3, seed: int = 1, gaps: bool = False):
    """(shop, day, sales, temp, promo, kind) in random order."""
    rng = random.Random(seed)
    rows = []
    for s in range(shops):
        for d in range(days):
            day = date(2023, 1, 2) + timedelta(days=d)
            sales = round(100 + 20 * s + 10 * math.sin(d / 7) + 5 * (d % 7) + rng.random(), 2)
            temp = None if gaps and rng.random() < 0.1 else round(rng.uniform(-5, 30), 1)
            rows.append((f"s{s}", day, sales, temp, rng.randint(0, 1), rng.choice(["a", "b", None])))
    rng.shuffle(rows)
    return rows


PANEL_SCHEMA = "shop string, day date, sales double, temp double, promo int, kind string"


def panel(spark, **kwargs):
    return spark.createDataFrame(panel_rows(**kwargs), PANEL_SCHEMA)


TICKS = Roles("at", "value", "sensor", numeric=("load",), tiebreak=("seq",))


def tick_rows(n: int = 900, seed: int = 2):
    """(sensor, at, seq, value, load): one sensor holds most rows, times repeat and jump."""
    rng = random.Random(seed)
    rows, now = [], datetime(2024, 1, 1)
    for i in range(n):
        sensor = "hot" if rng.random() < 0.7 else rng.choice(["b", "c", "d"])
        now += timedelta(seconds=rng.choice([0, 1, 5, 60, 4000, 90000]))
        rows.append((sensor, now, i, float(rng.randint(0, 500)), rng.random()))
    rng.shuffle(rows)
    return rows


TICK_SCHEMA = "sensor string, at timestamp_ntz, seq long, value double, load double"


def ticks(spark, n: int = 900):
    return spark.createDataFrame(tick_rows(n), TICK_SCHEMA)
