"""Kernels and statistics against closed forms and known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from sigspark.functions import special
from sigspark.operators import coupling as cp, features as ft, filters as fl, kernels as kn, models as md, neighbours as nn, series as op, statistics as stat, surrogates as su


def pairs(spark, x, y, pair=0):
    return spark.createDataFrame(pd.DataFrame({"pair_id": pair, "idx": range(len(x)), "x": np.asarray(x, float), "y": np.asarray(y, float)}))


def series(spark, x, key=0):
    return spark.createDataFrame(pd.DataFrame({"series_id": key, "idx": range(len(x)), "x": np.asarray(x, float)}))


def test_tail_probabilities():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.f_upper(3.0, 2, 12) == pytest.approx(0.08779150, abs=1e-6)
    assert special.chi2_upper(5.2, 2) == pytest.approx(math.exp(-2.6), abs=1e-12)
    assert special.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert special.signed_rank_two_sided(0, 5, 0, 0) == 0.0625
    assert [special.signed_rank_two_sided(w, 5, 0, 0) for w in (2, 6)] == [0.1875, 0.8125]
    assert special.signed_rank_two_sided(3, 0, 0, 0) != special.signed_rank_two_sided(3, 0, 0, 0)


@given(st.floats(0.01, 50), st.floats(1, 60))
@settings(max_examples=60, deadline=None)
def test_tails_fall_and_stay_in_range(t, df):
    assert 0 <= special.t_two_sided(t + 1, df) <= special.t_two_sided(t, df) <= 1
    assert special.f_upper(t * t, 1, df) == pytest.approx(special.t_two_sided(t, df), abs=1e-9)


def test_friedman_and_rayleigh(spark):
    rows = [(s, c, v) for s, vs in enumerate([(1.0, 2.0, 3.0), (1.0, 3.0, 2.0), (1.0, 2.0, 3.0), (2.0, 1.0, 3.0), (1.0, 2.0, 3.0)]) for c, v in enumerate(vs)]
    r = stat.friedman(spark.createDataFrame(rows, "subject int, condition int, value double"), "subject", "condition", 3).first()
    assert r.chi2 == pytest.approx(12 / (5 * 12) * (6**2 + 10**2 + 14**2) - 60) and r.p == pytest.approx(math.exp(-r.chi2 / 2))
    c = stat.circular(spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3)], "k int, a double"), ["k"], "a").first()
    assert c.mean_angle == pytest.approx(0.2) and c.resultant > 0.99


def test_lag_of_a_delayed_copy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    x = np.roll(y, 5)
    lags = cp.windowed_xcorr(pairs(spark, x, y), 100, 50, 10)
    assert {r.peak_lag for r in cp.peaks(lags, ["pair_id", "w"]).collect()} == {5}


def test_absolute_value_is_seen_by_information_only(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    p = pairs(spark, x, np.abs(x) + 0.05 * rng.normal(size=400))
    assert abs(cp.correlation(p).first().r) < 0.2
    assert cp.mutual_information(cp.binned(p, 4)).first().mi_nats > 0.4 and nn.mutual_information(x, np.abs(x))["mi_knn"] > 0.5
    assert nn.mutual_information(x, rng.normal(size=400))["mi_knn"] < 0.1


@pytest.mark.parametrize("name,y,expected", [
    ("copy", lambda a, b: a, (0, 1, 0, 0)), ("xor", lambda a, b: a ^ b, (0, 0, 0, 1)), ("redundant", None, (1, 0, 0, 0)),
])
def test_truth_tables(spark, name, y, expected):
    cases = [(a, b) for a in (0, 1) for b in (0, 1)] * 8 if y else [(0, 0), (1, 1)] * 8
    t = spark.createDataFrame([(0, a, b, y(a, b) if y else a) for a, b in cases], "pair_id int, x1 int, x2 int, y int")
    r = cp.pid(t).first()
    assert (r.redundancy, r.unique_x1, r.unique_x2, r.synergy) == pytest.approx(expected, abs=1e-9)


def test_direction_of_a_driven_system(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=400), np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.7 * x[i - 1] + 0.3 * rng.normal()
    p = pairs(spark, x, y)
    assert cp.transfer_entropy(p, 4).first().te_bits > 3 * cp.transfer_entropy(p, 4, source="y", target="x").first().te_bits
    assert nn.transfer_entropy(x, y)["te_knn"] > nn.transfer_entropy(y, x)["te_knn"] + 0.2


def test_detrended_cross_correlation(spark):
    rng = np.random.default_rng(4)
    shared = np.cumsum(rng.normal(size=256)) * 0.2
    p = pairs(spark, shared + rng.normal(size=256), shared + rng.normal(size=256))
    rho = {r.s: r.rho for r in ft.dcca(p, [4, 8, 16, 32, 64], ["pair_id"]).collect()}
    assert rho[64] > rho[4]
    assert all(r.rho == pytest.approx(1) for r in ft.dcca(pairs(spark, shared, shared), [4, 8, 16], ["pair_id"]).collect())


def test_scaling_of_noise_and_walk(spark):
    noise = np.random.default_rng(5).normal(size=1024)
    alpha = [ft.dfa(series(spark, x), [4, 8, 16, 32, 64, 128]).first().alpha for x in (noise, np.cumsum(noise))]
    assert 0.4 < alpha[0] < 0.65 and 1.3 < alpha[1] < 1.7
    assert ft.hurst(series(spark, noise), [16, 32, 64, 128]).first().hurst < ft.hurst(series(spark, np.cumsum(noise)), [16, 32, 64, 128]).first().hurst
    assert ft.higuchi(series(spark, noise)).first().fd > 1.8


def test_filters():
    t = np.arange(1024) / 256
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 60 * t)
    low = fl.zero_phase(x, 20.0, 256.0, "lowpass", 4)
    assert np.abs(low - np.sin(2 * np.pi * 5 * t))[100:-100].max() < 0.01
    assert np.abs(fl.zero_phase(x, (50.0, 70.0), 256.0, "bandpass", 4) - np.sin(2 * np.pi * 60 * t))[200:-200].max() < 0.05
    assert np.abs(np.abs(fl.analytic_signal(np.sin(2 * np.pi * 8 * np.arange(256) / 256))) - 1).max() < 1e-9
    assert np.abs(fl.polyphase(np.sin(2 * np.pi * 4 * t), 128, 256) - np.sin(2 * np.pi * 4 * np.arange(512) / 128))[50:-50].max() < 0.02
    with pytest.raises(ValueError):
        fl.butter_power(200.0, 256.0, "lowpass", 4, np.zeros(1))


def test_chunks_do_not_show(spark):
    x = np.random.default_rng(6).normal(size=4000)
    one, many = ({r.idx: r.x for r in fl.filtered(series(spark, x), 30.0, 256.0, "highpass", chunk=c).collect()} for c in (1 << 16, 512))
    assert len(one) == len(many) == 4000 and max(abs(one[i] - many[i]) for i in one) < 1e-3


def test_edge_series(spark):
    rows = [(0, i, None) for i in range(5)] + [(1, 0, 2.0)] + [(2, i, 1.0) for i in range(6)] + [(3, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])]
    df = spark.createDataFrame(rows, "series_id int, idx long, x double")
    filled = {(r.series_id, r.idx): r.x for r in op.filled(df).collect()}
    assert [filled[3, i] for i in range(5)] == [1, 1, 2, 3, 3] and filled[0, 0] is None and filled[1, 0] == 2
    assert {r.sampen for r in ft.sample_entropy(df).collect()} == {None}
    assert {r.fd for r in ft.katz(df).collect()} <= {None} and {r.alpha for r in ft.dfa(df, [4]).collect()} <= {None}
    assert op.windowed(df, 10, 5, []).count() == 0
    assert {r.scaled for r in op.max_abs_scaled(df.filter("series_id = 2")).collect()} == {None}
    assert op.filled(df.limit(0)).count() == 0


def test_entropies():
    assert kn.lempel_ziv(np.arange(64) % 2)["lzc"] < 0.5 < kn.lempel_ziv(np.random.default_rng(0).normal(size=64))["lzc"]


def test_phase_surrogates_keep_power():
    x = np.random.default_rng(7).normal(size=65)
    y = kn.phase_shuffled(x, kn.seeded("a", 1))
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y))) and not np.allclose(x, y)
    assert np.allclose(y, kn.phase_shuffled(x, kn.seeded("a", 1)))


def test_atoms_add_up(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=300), rng.normal(size=300)
    y[1:] += x[:-1]
    c = cp.gaussian_atoms_input(pairs(spark, x, y), 1)
    a = kn.phi_id(c, ["pair_id"]).first().asDict()
    v = c.first().asDict()
    m = np.array([[v["c_" + "".join(sorted(p + q))] for q in "abcd"] for p in "abcd"])
    whole = 0.5 * math.log(np.linalg.det(m[:2, :2]) * np.linalg.det(m[2:, 2:]) / np.linalg.det(m))
    assert sum(w for k, w in a.items() if k[0] in "rxys" and len(k) == 6) == pytest.approx(whole, abs=1e-9) == a["total"]
    assert a["transfer_x_to_y"] == pytest.approx(a["r_to_y"] + a["x_to_y"] + a["s_to_y"]) and a["transfer_x_to_y"] > a["transfer_y_to_x"] and a["synergy"] == a["s_to_s"]
    assert a["x_to_y"] > 0.1


def test_random_intercepts(spark):
    rng = np.random.default_rng(9)
    rows = [(0, s, float(c), float(2.0 * c + u + 0.1 * rng.normal())) for s, u in enumerate(rng.normal(0, 3, 30)) for c in (0, 1) for _ in range(4)]
    r = md.random_intercept(spark.createDataFrame(rows, "k int, subject int, c double, y double"), ["k"], "subject", "c", "y").first()
    assert r.coefficient == pytest.approx(2.0, abs=0.05) and r.method == "reml" and 3 < r.var_subject < 20 and r.var_residual == pytest.approx(0.01, abs=0.005)
    flat = [(0, s, 1.0, 1.0) for s in range(4)]
    assert md.random_intercept(spark.createDataFrame(flat, "k int, subject int, c double, y double"), ["k"], "subject", "c", "y").first().method == "none"


def test_gee_finds_the_sign(spark):
    rng = np.random.default_rng(10)
    rows = [(0, s, x, int(rng.uniform() < 1 / (1 + math.exp(-1.5 * x)))) for s in range(20) for x in rng.normal(size=15).tolist()]
    r = md.gee_logistic(spark.createDataFrame(rows, "k int, subject int, x double, label int"), ["k"], "subject", "x", "label").first()
    assert 1.0 < r.coefficient < 2.2 and r.p < 1e-6


def test_corrections(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,), (None,), (float("nan"),)], "p double")
    q = {r.p: (r.p_fdr, r.p_holm) for r in stat.holm(stat.bh_fdr(df)).collect() if r.p == r.p}
    assert q[0.005] == pytest.approx((0.02, 0.02)) and q[0.04] == pytest.approx((0.04, 0.06)) and q[None] == (None, None)


def test_cluster_test_finds_a_plateau(spark):
    rng = np.random.default_rng(11)
    rows = [(s, i, float(rng.normal() + (3 if 10 <= i < 20 else 0))) for s in range(12) for i in range(40)]
    found = su.cluster_test_paired(spark.createDataFrame(rows, "subject int, idx long, diff double"), 99, 2.2).orderBy("p", "first").first()
    assert found.p == 0.01 and found["first"] <= 10 and found["last"] >= 19


def test_windowed_apply(spark):
    df = series(spark, np.arange(20.0))
    out = op.windowed_apply(df, 8, 4, lambda f: pd.DataFrame({"series_id": [f.series_id.iloc[0]], "w": [f.w.iloc[0]], "top": [f.x.max()]}), "series_id long, w long, top double")
    assert sorted((r.w, r.top) for r in out.collect()) == [(0, 7.0), (1, 11.0), (2, 15.0), (3, 19.0)]
