"""Components, modes and pixel indices of planted signals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import components as co, frames as fr


def table(spark, x, key=0):
    """x: instants by channels."""
    t, c = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"k": key, "idx": t.ravel(), "c": c.ravel(), "x": x.ravel()}))


@pytest.mark.parametrize("block", [2, 3, 256])
def test_product_sums_of_any_block_size(spark, block):
    x = np.random.default_rng(1).normal(size=(40, 7))
    df = table(spark, x).repartition(5).withColumn("x", F.when((F.col("idx") != 9) | (F.col("c") != 3), F.col("x")))  # an instant with a gap
    sums = co.product_sums(df, ["k"], "idx", "c", ahead=True, block=block).toPandas()
    kept = np.delete(x, 9, 0)
    assert np.allclose(co.assembled(sums, "now"), kept.T @ kept) and sums["n"][sums["what"] == "now"].unique().tolist() == [39]
    pairs = [t for t in range(39) if t != 9 and t + 1 != 9]
    assert np.allclose(co.assembled(sums, "before"), x[pairs].T @ x[pairs])
    assert np.allclose(co.assembled(sums, "next"), sum(np.outer(x[t + 1], x[t]) for t in pairs))


def test_removal_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(2)
    beat = np.sign(np.sin(np.arange(600) * 0.14))
    x = rng.normal(size=(600, 4)) @ rng.normal(size=(4, 4)) + beat[:, None] * [3.0, 2.0, -1.5, 0.2] + 10
    df, reference = table(spark, x), spark.createDataFrame(pd.DataFrame({"k": 0, "idx": range(600), "r": beat}))
    cleaned, components = co.removed(df, reference, ["k"], "c", threshold=0.3)
    got = cleaned.toPandas().pivot(index="idx", columns="c", values="x").to_numpy()
    s = (x - x.mean(0)) / x.std(0)
    v = np.linalg.eigh(s.T @ s)[1]
    r = np.array([np.corrcoef(s @ v[:, k], beat)[0, 1] for k in range(4)])
    bad = v[:, np.abs(r) > 0.3]
    assert 0 < bad.shape[1] < 4 and np.abs(got - ((s - s @ bad @ bad.T) * x.std(0) + x.mean(0))).max() < 1e-6
    rows = components.toPandas().sort_values("mode")
    assert np.allclose(np.abs(rows.correlation), np.abs(r[::-1]), atol=1e-6) and rows.energy.sum() == pytest.approx(1)


def test_an_orthogonal_artefact_drops_and_the_rest_stays(spark):
    t = np.arange(500)
    waves = np.linalg.qr(np.column_stack([np.ones(500), np.sin(t * 0.9), np.sin(t * 0.31), np.cos(t * 0.17)]))[0][:, 1:] * math.sqrt(500)
    patterns = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1]]) * np.array([[1.0], [0.7], [0.4]])
    x = waves @ patterns  # every channel has the same variance, so standardising keeps the patterns orthogonal
    reference = spark.createDataFrame(pd.DataFrame({"k": 0, "idx": t, "r": waves[:, 0]}))
    cleaned, components = co.removed(table(spark, x), reference, ["k"], "c")
    got = cleaned.toPandas().pivot(index="idx", columns="c", values="x").to_numpy()
    assert np.abs(got - waves[:, 1:] @ patterns[1:]).max() < 1e-6
    assert max(abs(np.corrcoef(got[:, k], waves[:, 0])[0, 1]) for k in range(4)) < 0.05
    assert components.filter("removed").count() == 1


def test_removal_edges(spark):
    x = np.column_stack([np.ones(20), np.arange(20.0), np.arange(20.0) % 3])  # one constant channel
    flat = spark.createDataFrame(pd.DataFrame({"k": 0, "idx": range(20), "r": 1.0}))
    cleaned, components = co.removed(table(spark, x), flat, ["k"], "c")
    assert np.allclose(cleaned.toPandas().pivot(index="idx", columns="c", values="x").to_numpy(), x) and components.filter("removed").count() == 0
    assert co.removed(table(spark, x).limit(0), flat, ["k"], "c")[0].count() == 0


def planted_clip(n=120, fs=25.0, growth=-0.4):
    rng = np.random.default_rng(3)
    t = np.arange(n) / fs
    shapes = np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    x = np.zeros((n, 64))
    for (f, g, a), s in zip(((2.0, 0.0, 3.0), (5.5, growth, 1.5)), (shapes[:2], shapes[2:])):
        x += a * np.exp(g * t)[:, None] * (np.cos(2 * np.pi * f * t)[:, None] * s[0] + np.sin(2 * np.pi * f * t)[:, None] * s[1])
    return x


def test_dynamic_modes_of_two_planted_waves(spark):
    x = planted_clip()
    df = table(spark, x)
    modes = co.dynamic_modes(df, ["k"], "idx", "c", 25.0, k=2)
    rows = {r["mode"]: r for r in modes.collect()}
    assert len(rows) == 2  # four eigenvalues, two pairs
    assert rows[1].frequency == pytest.approx(2.0, abs=1e-4) and rows[1].growth == pytest.approx(0, abs=1e-4) and rows[1].energy == pytest.approx(1)
    assert rows[2].frequency == pytest.approx(5.5, abs=1e-4) and rows[2].growth == pytest.approx(-0.4, abs=1e-4) and 0 < rows[2].energy < 1
    series = co.mode_series(modes, df, ["k"], "idx").toPandas().sort_values("idx")
    for m, (f, g) in {1: (2.0, 0.0), 2: (5.5, -0.4)}.items():
        s, t = series[series["mode"] == m].x.to_numpy(), np.arange(120) / 25
        design = np.exp(g * t)[:, None] * np.column_stack([np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)])
        assert np.abs(s - design @ np.linalg.lstsq(design, s, rcond=None)[0]).max() < 1e-3 * np.abs(s).max()
    top = co.strongest(modes, ["k"]).first()
    assert top.n_modes == 2 and top.top_frequency == rows[1].frequency and top.second_energy == rows[2].energy


def test_energies_of_planted_modes(spark):
    x = planted_clip(growth=0.0)
    x = x - x.mean(0)
    modes = co.loadings(table(spark, x), ["k"], "idx", "c", k=4)
    energy = {r["mode"]: r.energy for r in modes.groupBy("mode").agg(F.max("energy").alias("energy")).collect()}
    s = np.linalg.svd(x, compute_uv=False) ** 2
    assert [energy[m] for m in (1, 2, 3, 4)] == pytest.approx((s / s.sum())[:4].tolist(), abs=1e-9)
    scores = co.scores(table(spark, x), modes, ["k"], "idx", "c").toPandas().pivot(index="idx", columns="mode", values="score").to_numpy()
    assert np.allclose((scores**2).sum(0), s[:4])


def test_modes_of_constant_and_short_clips(spark):
    flat = np.zeros((10, 4))
    assert co.dynamic_modes(table(spark, flat), ["k"], "idx", "c", 25.0).count() == 0
    assert co.dynamic_modes(table(spark, np.ones((2, 4))), ["k"], "idx", "c", 25.0).count() == 0
    assert co.loadings(table(spark, flat), ["k"], "idx", "c", k=2).groupBy().agg(F.max("energy")).first()[0] == 0


def test_phase_coherence_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(16, 8, 8)) + np.sin(np.arange(16) * 1.2)[:, None, None]
    t, y, px = np.indices(x.shape)
    series = spark.createDataFrame(pd.DataFrame({"clip": 0, "y": y.ravel(), "px": px.ravel(), "idx": t.ravel(), "x": x.ravel()}))
    power = fr.pixel_power(series, 16, 25.0, fr.PIXEL)
    r = fr.spectral_indices(power, 16, 25.0, ["clip"], ["y", "px"]).first()
    flat = x.reshape(16, 64)
    i = np.arange(16)
    flat = flat - flat.mean(0) - (i - i.mean())[:, None] * ((i - i.mean()) @ (flat - flat.mean(0)) / ((i - i.mean()) ** 2).sum())
    f = np.fft.rfft(flat * np.hanning(16)[:, None], axis=0)[1:]
    u = f / np.abs(f)
    weight = (np.abs(f) ** 2).mean(1)
    pairs = [np.mean([(u[k, a] * u[k, b].conj()).real for a in range(64) for b in range(64) if a != b]) for k in range(8)]
    assert r.phase_coherence == pytest.approx(weight @ np.array(pairs) / weight.sum(), abs=1e-9)
    assert r.sync == pytest.approx(1 + (weight / weight.sum() * np.log2(weight / weight.sum())).sum() / 3, abs=1e-9)
    peaks = (np.abs(f) ** 2).argmax(0) + 1
    assert r.coherence == pytest.approx(1 - (peaks * 25 / 16).std() / (25 / 16 * 7), abs=1e-9)


def test_equal_pixels_are_coherent(spark):
    x = np.repeat(np.sin(np.arange(32) * 0.7)[:, None], 4, 1)
    t, c = np.indices(x.shape)
    s = spark.createDataFrame(pd.DataFrame({"clip": 0, "y": 0, "px": c.ravel(), "idx": t.ravel(), "x": x.ravel()}))
    r = fr.spectral_indices(fr.pixel_power(s, 32, 25.0, fr.PIXEL), 32, 25.0, ["clip"], ["y", "px"]).first()
    assert r.phase_coherence == pytest.approx(1) and r.coherence == pytest.approx(1)
    one = fr.spectral_indices(fr.pixel_power(s.filter("px = 0"), 32, 25.0, fr.PIXEL), 32, 25.0, ["clip"], ["y", "px"]).first()
    assert one.phase_coherence is None and one.coherence is None
