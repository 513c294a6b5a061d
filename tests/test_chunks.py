"""Filters, rate changes and envelopes: the same result for any chunk size, and against sample-by-sample loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import cardiac as cd, filters as fl, spectral as sp


def series(spark, x, key=0):
    return spark.createDataFrame(pd.DataFrame({"series_id": key, "idx": range(len(x)), "x": np.asarray(x, float)}))


def values(df):
    return df.toPandas().sort_values("idx").x.to_numpy()


def loop(x, sections, state):
    out = np.array(x, float)
    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sections, state):
        for i, u in enumerate(out):
            y = b0 * u + s1
            s1, s2 = b1 * u - a1 * y + s2, b2 * u - a2 * y
            out[i] = y
    return out


CASES = [("lowpass", 20.0, 4), ("highpass", 5.0, 3), ("bandpass", (4.0, 12.0), 4), ("bandpass", (0.5, 40.0), 2), ("lowpass", 90.0, 5), ("highpass", 0.5, 2)]


@pytest.mark.parametrize("kind,cut,order", CASES)
def test_sections_have_the_butterworth_response(kind, cut, order):
    sections, fs = fl.butter_sections(cut, 256.0, kind, order), 256.0
    f = np.linspace(0.05, 127, 400)
    z = np.exp(-2j * np.pi * f[:, None] / fs * np.arange(3))
    h = np.prod((z @ sections[:, :3].T) / (z @ sections[:, 3:].T), axis=1)
    assert np.allclose(np.abs(h) ** 2, fl.butter_power(cut, fs, kind, order, f), atol=1e-8)
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in sections)


@pytest.mark.parametrize("kind,cut,order", CASES)
def test_the_cascade_equals_a_loop(kind, cut, order):
    sections = fl.butter_sections(cut, 256.0, kind, order)
    system = fl.Cascade(sections)
    x = np.random.default_rng(1).normal(size=333)
    assert np.allclose(system.run(x, np.zeros(len(system.b)))[0][:, 0], loop(x, sections, [(0, 0)] * len(sections)), atol=1e-9)
    steady = system.run(np.ones(200), system.steady)[0][:, 0]
    assert np.allclose(steady, steady[0], atol=1e-8)
    a, state = system.run(x[:100], np.zeros(len(system.b)))
    assert np.allclose(np.vstack([a, system.run(x[100:], state)[0]])[:, 0], system.run(x, np.zeros(len(system.b)))[0][:, 0], atol=1e-12)


@pytest.mark.parametrize("kind,cut,order", [CASES[0], CASES[2], CASES[5]])
def test_filters_do_not_depend_on_the_chunk(spark, kind, cut, order):
    x = np.cumsum(np.random.default_rng(2).normal(size=1500))
    sections = fl.butter_sections(cut, 256.0, kind, order)
    whole = fl.forward_backward(x, sections, fl.padding(sections))
    for chunk in (40, 1 << 14):
        assert np.abs(values(fl.filtered(series(spark, x), cut, 256.0, kind, order, chunk=chunk)) - whole).max() < 1e-9 * np.abs(x).max()


def test_filter_edges(spark):
    rows = [(0, i, None) for i in range(4)] + [(1, 0, 3.0)] + [(2, i, 5.0) for i in range(40)] + [(3, i, None if i in (0, 7, 39) else float(i)) for i in range(40)] + [(None, i, float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id int, idx long, x double")
    got = fl.filtered(df, 2.0, 20.0, "lowpass", chunk=16).toPandas()
    assert len(got) == len(rows) and got[got.series_id == 0].x.isna().all() and got[got.series_id == 1].x.tolist() == [3.0]
    assert np.allclose(got[got.series_id == 2].x, 5.0) and got[got.series_id == 3].x.notna().all() and got[got.series_id.isna()].x.notna().sum() == 30
    assert fl.filtered(df.limit(0), 2.0, 20.0, "lowpass").count() == 0
    for bad in (0.0, 10.0, 11.0, (3.0, 2.0)):
        with pytest.raises(ValueError):
            fl.filtered(df, bad, 20.0, "lowpass" if np.isscalar(bad) else "bandpass")


def test_bands_as_data(spark):
    x = np.random.default_rng(3).normal(size=300)
    bands = spark.createDataFrame([(0, 2.0, 5.0), (1, None, 3.0), (2, 4.0, None), (3, 6.0, 4.0), (4, None, None), (5, 1.0, 99.0)], "series_id int, low double, high double")
    df = series(spark, x).drop("series_id").crossJoin(bands)
    got = {k: g.sort_values("idx").x.to_numpy() for k, g in fl.filtered_by(df, 20.0, F.col("low"), F.col("high"), chunk=64).toPandas().groupby("series_id")}
    for k, (kind, cut) in enumerate((("bandpass", (2.0, 5.0)), ("lowpass", 3.0), ("highpass", 4.0))):
        assert np.allclose(got[k], values(fl.filtered(series(spark, x), cut, 20.0, kind)), atol=1e-10)
    assert all(np.isnan(got[k]).all() and len(got[k]) == 300 for k in (3, 4, 5))


@pytest.mark.parametrize("fs_from,fs_to", [(64, 48), (48, 64), (50, 200), (441, 200), (7, 7)])
def test_rate_changes_do_not_depend_on_the_chunk(spark, fs_from, fs_to):
    x = np.random.default_rng(4).normal(size=701)
    whole = fl.polyphase(x, fs_to, fs_from)
    for chunk in (60, 1 << 14):
        got = fl.resampled_poly(series(spark, x), fs_from, fs_to, chunk=chunk).toPandas().sort_values("idx")
        assert got.idx.tolist() == list(range(len(whole))) and np.abs(got.x.to_numpy() - whole).max() < 1e-9


def test_envelopes_do_not_depend_on_the_chunk(spark):
    t = np.arange(2000) / 200
    x = (1 + 0.5 * np.sin(2 * np.pi * 0.5 * t)) * np.sin(2 * np.pi * 30 * t)
    got = [values(fl.envelopes(series(spark, x), 20.0, 200.0, chunk=c)) for c in (1 << 14, 137)]
    assert np.abs(got[0] - got[1]).max() < 1e-9
    assert np.abs(got[0] - (1 + 0.5 * np.sin(2 * np.pi * 0.5 * t)))[60:-60].max() < 0.01


def test_twelve_bands(spark):
    t = np.arange(3 * 2205) / 2205
    x = (1 + 0.9 * np.sin(2 * np.pi * 10 * t)) * np.random.default_rng(5).normal(size=len(t))
    one, many = (fl.envelope_bands(series(spark, x), 2205, 1102, 256, chunk=c).toPandas().pivot(index="idx", columns="band", values="x") for c in (1 << 14, 500))
    assert sorted(one.columns) == sorted(b[0] for b in fl.ENVELOPE_BANDS) and abs(len(one) - 768) <= 2
    assert np.nanmax(np.abs(one.to_numpy() - many.to_numpy())) < 1e-6
    assert one.min().min() > -0.2 and one.max().max() < 1.2


def test_wide_tables(spark):
    rng = np.random.default_rng(6)
    wide = spark.createDataFrame(pd.DataFrame({"rec": 0, "n": range(200), "ch_a": rng.normal(size=200), "ch_b": rng.normal(size=200), "other": "o"}))
    got = fl.filtered_table(wide, "ch_", (1.0, 4.0), 20.0, ["rec"], "n").toPandas().sort_values("n")
    assert got.columns.tolist() == wide.columns and set(got.other) == {"o"}
    for c in ("ch_a", "ch_b"):
        assert np.allclose(got[c], values(fl.filtered(series(spark, wide.toPandas()[c]), (1.0, 4.0), 20.0)), atol=1e-9)


def test_beats_of_a_noisy_recording(spark):
    fs, rng = 200, np.random.default_rng(7)
    t = np.arange(30 * fs) / fs
    beats = np.arange(0.5, 29.5, 0.8)
    x = sum(np.exp(-((t - b) ** 2) / 0.0008) for b in beats) + 2 * np.sin(2 * np.pi * 0.05 * t) + 0.5 * np.sin(2 * np.pi * 50 * t) + 0.02 * rng.normal(size=len(t))
    found = sorted(r.idx / fs for r in fl.ecg_peaks(series(spark, x), fs, factor=2.5).collect())
    assert len(found) == len(beats) and np.abs(np.array(found) - beats).max() < 0.03


def test_phase_coupling_finds_the_frequency(spark):
    t = np.arange(4000) / 10
    rows = []
    for k, (f, lag) in enumerate(((0.2, 0.5), (0.35, -0.3))):
        y = np.sin(2 * np.pi * f * t) + 0.1 * np.random.default_rng(k).normal(size=len(t))
        rows.append(pd.DataFrame({"pair": k, "idx": range(len(t)), "x": np.sin(2 * np.pi * f * (t + lag)), "y": y}))
    p = spark.createDataFrame(pd.concat(rows))
    bands = sp.dominant_band(p, 1000, 10.0, ["pair"])
    got = {r.pair: r for r in sp.phase_sync(p, 10.0, ["pair"], bands).collect()}
    for k, (f, lag) in enumerate(((0.2, 0.5), (0.35, -0.3))):
        assert got[k].f0 == pytest.approx(f, abs=0.0101) and got[k].plv > 0.98 and got[k].preferred_lag_s == pytest.approx(lag, abs=0.1)
    flat = p.withColumn("x", F.lit(1.0)).withColumn("y", F.when(F.col("pair") == 0, F.col("y")))
    assert {r.pair: r.f0 for r in sp.dominant_band(flat.filter("pair = 0"), 1000, 10.0, ["pair"]).collect()}.keys() == {0}


def test_features_on_a_grid(spark):
    rows = [(0, i * 10.0, i * 10.0 + 20.0, v) for i, v in enumerate([1.0, None, 3.0, 4.0, float("nan"), 2.0])] + [(1, 0.0, 20.0, 1.0), (1, 10.0, 30.0, None), (1, 20.0, 40.0, None), (2, 0.0, 20.0, 1.0)]
    w = spark.createDataFrame(rows, "k int, time_start double, time_end double, v double")
    got = cd.gridded_feature(w, "v", 0.1, ["k"]).orderBy("k", "idx").collect()
    assert [(r.k, r.idx, r.t, r.x) for r in got] == [(0, 0, 10.0, 1.0), (0, 1, 20.0, 2.0), (0, 2, 30.0, 3.0), (0, 3, 40.0, 4.0), (0, 4, 50.0, 3.0)]


def test_spectra_keyed_by_w(spark):
    x = np.random.default_rng(8).normal(size=64)
    df = spark.createDataFrame(pd.DataFrame({"w": np.repeat([0, 1], 32), "idx": np.tile(np.arange(32), 2), "x": x, "y": x}))
    assert {(r.w, round(r.p, 9)) for r in sp.welch(df, 16, 8, 1.0, ["w"]).collect()} == {(int(k), round(r.p, 9)) for k in (0, 1) for r in sp.welch(df.filter(f"w = {k}").withColumn("k0", F.lit(k)), 16, 8, 1.0, ["k0"]).collect()}
    assert all(r.c == pytest.approx(1) for r in sp.coherence(df, 8, 4, 1.0, ["w"]).collect())
    assert math.isclose(sp.band_coherence(sp.coherence(df, 8, 4, 1.0, ["w"]), 0.1, 0.4, ["w"]).first()["mean"], 1.0)
