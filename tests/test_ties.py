"""Ties, missing values, gaps and unequal groups."""

import math
import random

import pytest

from sigspark.operators import coupling as cp, series as op, statistics as st


def pairs(spark, x, y):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(x, y))], "pair_id long, idx long, x double, y double")


def test_information_of_a_binary_series_with_itself_is_its_entropy(spark):
    x = [1.0 if i % 5 == 0 else 0.0 for i in range(100)]
    got = cp.mutual_information(cp.binned(pairs(spark, x, x), 4)).first().mi_nats
    assert got == pytest.approx(-(0.2 * math.log(0.2) + 0.8 * math.log(0.8)))


def test_missing_values_do_not_count(spark):
    x = [1.0, 2.0, None, 3.0] * 10
    y = [1.0, 2.0, 2.0, None] * 10
    assert cp.mutual_information(cp.binned(pairs(spark, x, y), 4)).first().mi_nats == pytest.approx(math.log(2))
    assert cp.binned(pairs(spark, [None] * 8, y[:8]), 4).filter("x IS NOT NULL").count() == 0


def test_transfer_entropy_of_a_delayed_copy(spark):
    rng = random.Random(2)
    x = [float(rng.random() < 0.4) for _ in range(2001)]
    y = [0.0, *x[:-1]]
    found = cp.transfer_entropy(pairs(spark, x, y), 8).first().te_bits
    assert found == pytest.approx(-(0.4 * math.log2(0.4) + 0.6 * math.log2(0.6)), abs=0.02)
    assert cp.transfer_entropy(pairs(spark, x, y), 8, source="y", target="x").first().te_bits < 0.01
    assert cp.transfer_entropy(pairs(spark, x, y), 8, history=3).first().te_bits == pytest.approx(found, abs=0.02)


def test_lagged_information_is_positive_where_the_second_comes_later(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(400)]
    y = [0.5, 0.5, *x[:-2]]
    rows = cp.lagged_mutual_information(pairs(spark, x, y), 4, 3).collect()
    assert max(rows, key=lambda r: r.mi_nats).lag == 2


def test_lags_do_not_depend_on_the_chunk(spark):
    rng = random.Random(4)
    series = {1: 23, 2: 1, 3: 8, 4: 4}
    rows = [(k, 3 * i, None if (k, i) == (1, 5) else rng.random(), rng.random()) for k, n in series.items() for i in range(n)]
    df = spark.createDataFrame(rows, "pair_id long, idx long, x double, y double")
    plain = [[r for r in rows if r[0] == k] for k in series]
    expected = sorted((r[0][0], lag, r[i][2] or -1.0, r[i - lag][3]) for r in plain for lag in range(-5, 6) for i in range(len(r)) if 0 <= i - lag < len(r))
    for chunk in (1, 4, 8, 100):
        assert sorted((r.pair_id, r.lag, r.x or -1.0, r.y) for r in cp._lagged(df, 5, ["pair_id"], chunk).collect()) == expected
    assert cp.lagged_correlation(df.limit(0), 3).count() == 0


def test_windows_with_missing_rows_are_left_out(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(12) if i != 5], "series_id long, idx long, x double")
    assert {r.w for r in op.exploded_windows(df, 4, 4).collect()} == {0, 2}
    assert {r.w for r in op.windowed(df, 4, 2, []).collect()} == {0, 3, 4}
    assert op.exploded_windows(df.filter("idx < 3"), 4, 4).count() == 0


def test_pooled_deviation_weighs_by_degrees_of_freedom(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 9.0]
    df = spark.createDataFrame([(1, "a", v) for v in a] + [(1, "b", v) for v in b], "k int, g string, value double")
    pooled = math.sqrt((5 * 3.5 + 1 * 24.5) / 6)
    assert st.effect_size(df, ["k"], "g", "a", "b").first().cohens_d == pytest.approx((5.5 - 3.5) / pooled)
