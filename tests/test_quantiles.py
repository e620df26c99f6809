"""Exact quantiles: radix selection against sorted values."""

import math
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfwise.operators.quantiles import exact_quantiles, order_keys, value_of, values_at_ranks

PROBS = [i / 10 for i in range(11)] + [0.333]


def by_sorting(values, p):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    at = p * (len(v) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] + (v[hi] - v[lo]) * (at - lo)


def columns(n=4000):
    rng = random.Random(5)
    return {
        "uniform": [rng.uniform(-1e6, 1e6) for _ in range(n)],
        "skewed": [math.exp(rng.gauss(0, 4)) for _ in range(n)],
        "one_hot_value": [7.0 if rng.random() < 0.6 else rng.random() * 10 for _ in range(n)],
        "few_values": [float(rng.choice([1, 2, 3])) for _ in range(n)],
        "constant": [5.0] * n,
        "gaps": [None if rng.random() < 0.3 else float("nan") if rng.random() < 0.1
                 else rng.gauss(0, 1) for _ in range(n)],
    }


@pytest.mark.parametrize("small_rows", [20, 300, 10_000])
def test_against_sorting(spark, small_rows):
    data = columns()
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(7)
    found = exact_quantiles(df, list(data), PROBS, small_rows)
    for c, values in data.items():
        assert found[c] == pytest.approx([by_sorting(values, p) for p in PROBS], rel=1e-12), c


@pytest.mark.parametrize("small_rows", [1, 100])
def test_integers_flags_and_empty(spark, small_rows):
    df = spark.range(101).selectExpr("id", "id % 2 = 0 as flag", "cast(null as double) as none")
    found = exact_quantiles(df, ["id", "flag", "none"], [0.0, 0.5, 1.0], small_rows)
    assert found == {"id": [0, 50, 100], "flag": [0, 1, 1], "none": [None] * 3}


def test_order_key_is_the_bits(spark):
    """Every exponent, powers of two and their neighbours, subnormals, zeros and infinities."""
    draw = random.Random(3)
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308,
              1.7976931348623157e308]
    for e in range(-1074, 1024):
        x = math.ldexp(1.0, e)
        values += [x, math.nextafter(x, 0), math.nextafter(x, math.inf), -x, x * draw.uniform(1, 2)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.col("x").alias("k"))
    both = order_keys(df, ["x", "k"]).select("k").collect()
    rows = [Row(x=v, k=r.k) for v, r in zip(values, both)]
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits) and value_of(r.k) == r.x
    by_key = [r.x for r in sorted(rows, key=lambda r: r.k)]
    assert by_key == sorted(by_key)


@pytest.mark.parametrize("digit_bits", [2, 13])
def test_every_rank_in_few_passes(spark, digit_bits):
    """Values far apart and values in one narrow range, with all ranks wanted."""
    draw = random.Random(8)
    data = {"wide": [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(60)],
            "narrow": [1.0 + i * 2**-50 for i in draw.sample(range(500), 60)]}
    df = spark.createDataFrame(list(zip(*data.values())), "wide double, narrow double").repartition(3)
    found = values_at_ranks(df, {c: range(60) for c in data}, {c: 60 for c in data}, digit_bits)
    for c, values in data.items():
        assert [found[c, r] for r in range(60)] == sorted(values)
