"""Granger from lagged products, information by neighbours, phrases, and what the kernels do with gaps."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.functions import special
from sigspark.operators import coupling as cp, features as ft, filters as fl, granger as gr, kernels as kn, neighbours as nn, surrogates as su


def pairs(spark, x, y, key=0):
    return spark.createDataFrame(pd.DataFrame({"pair_id": key, "idx": range(len(x)), "x": np.asarray(x, float), "y": np.asarray(y, float)}))


def refitted(x, y, top, criterion):
    """Every order fitted on the raw arrays by least squares."""
    i = np.arange(len(x))
    x, y = (v - np.polyval(np.polyfit(i, v, 1), i) for v in (x, y))

    def design(p, first):
        return np.column_stack([np.ones(len(x) - first)] + [v[first - k : len(x) - k] for v in (x, y) for k in range(1, p + 1)])

    def rest(d, t):
        return t - d @ np.linalg.lstsq(d, t, rcond=None)[0]

    n, scores = len(x) - top, {}
    for p in range(top + 1):
        u = np.column_stack([rest(design(p, top), v[top:]) for v in (x, y)])
        each, both = 2 * p + 1, 2 * (2 * p + 1)
        log_det = math.log(np.linalg.det(u.T @ u / n))
        scores[p] = {"aic": log_det + 2 * both / n, "bic": log_det + math.log(n) * both / n, "hqic": log_det + 2 * math.log(math.log(n)) * both / n, "fpe": log_det + 2 * math.log((n + each) / (n - each))}[criterion]
    p = max(1, min(scores, key=scores.get))
    free, out = len(x) - p - 2 * p - 1, [p]
    for target, own in ((y, slice(p + 1, None)), (x, slice(1, p + 1))):
        d = design(p, p)
        full, alone = (float((rest(a, target[p:]) ** 2).sum()) for a in (d, np.column_stack([d[:, :1], d[:, own]])))
        out.append((alone - full) / p / (full / free))
    return [*out, *(special.f_upper(f, p, 2 * free) for f in out[1:])]


def driven(n, seed, lag=2):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=n), np.zeros(n)
    for i in range(lag, n):
        x[i] += 0.5 * x[i - 1]
        y[i] = 0.6 * x[i - lag] + 0.3 * y[i - 1] + 0.5 * rng.normal()
    return x + 0.01 * np.arange(n), y


@pytest.mark.parametrize("criterion", gr.CRITERIA)
@pytest.mark.parametrize("n,top", [(200, 10), (60, 4), (45, 7)])
def test_products_give_what_refitting_gives(spark, criterion, n, top):
    x, y = driven(n, n)
    r = gr.granger(pairs(spark, x, y), ["pair_id"], top, criterion).first()
    assert (r.order, r.f_xy, r.f_yx, r.p_xy, r.p_yx) == pytest.approx(refitted(x, y, top, criterion), rel=1e-7, abs=1e-12)


def test_granger_direction_and_edges(spark):
    x, y = driven(300, 1)
    r = gr.granger(pairs(spark, x, y), ["pair_id"]).first()
    assert r.p_xy < 1e-6 < r.p_yx and r.direction > 0 and r.order >= 2
    rows = [(0, i, float(i % 3), None if i == 5 else float(i % 4)) for i in range(60)] + [(1, i, 1.0, float(i % 5)) for i in range(60)] + [(2, i, float(i % 3), float(i % 7)) for i in range(9)] + [(3, i, None, None) for i in range(60)] + [(4, i, float(i % 2), float(i % 2)) for i in range(60)]
    got = {r.pair_id: r for r in gr.granger(spark.createDataFrame(rows, "pair_id int, idx long, x double, y double"), ["pair_id"], 4).collect()}
    assert len(got) == 5 and all(got[k].order is None and got[k].f_xy is None for k in (0, 1, 2, 3))  # one null, constant, short, all null
    assert got[4].order is not None  # two equal series: no job stops
    assert gr.granger(pairs(spark, x, y).limit(0), ["pair_id"]).count() == 0
    with pytest.raises(ValueError):
        gr.granger(pairs(spark, x, y), ["pair_id"], criterion="none")


def all_distances(*columns):
    d = np.max([np.abs(c[:, None] - c[None, :]) for c in columns], axis=0)
    np.fill_diagonal(d, np.inf)
    return d


def whole_mi(x, y, k):
    x, y = kn.scaled(x), kn.scaled(y)
    radius = np.partition(all_distances(x, y), k - 1, axis=1)[:, k - 1 : k]
    nx, ny = ((all_distances(v) < radius).sum(1) for v in (x, y))
    return max(0.0, float(kn.digamma(np.array([k]))[0] + kn.digamma(np.array([len(x)]))[0] - (kn.digamma(nx + 1) + kn.digamma(ny + 1)).mean()))


def whole_te(x, y, lag=1, k=3):
    r = [np.argsort(np.argsort(v, kind="stable"), kind="stable") / len(v) for v in (x, y)]
    future, past, source = r[1][lag:], r[1][:-lag], r[0][:-lag]
    radius = np.partition(all_distances(future, past, source), k - 1, axis=1)[:, k - 1 : k]
    n_z, n_fz, n_sz = ((all_distances(*c) < radius).sum(1) for c in ((past,), (future, past), (source, past)))
    return float(kn.digamma(np.array([k]))[0] + (kn.digamma(n_z + 1) - kn.digamma(n_fz + 1) - kn.digamma(n_sz + 1)).mean())


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("k", [1, 3, 5])
def test_neighbours_equal_the_whole_matrix(seed, k, monkeypatch):
    monkeypatch.setattr(nn, "CELLS", 3000)
    rng = np.random.default_rng(seed)
    n = [7, 40, 150, 300, 300, 500][seed]
    x, y = rng.normal(size=n), rng.normal(size=n)
    if seed in (3, 5):
        x, y = np.round(x * 2), np.round(y * 3)  # ties everywhere
    if seed == 4:
        x = np.where(rng.uniform(size=n) < 0.7, 0.0, x)
    assert np.array_equal(nn.kth_distance((x, y), k), np.partition(all_distances(x, y), k - 1, axis=1)[:, k - 1])
    radius = nn.kth_distance((x, y), k)
    assert np.array_equal(nn.count_nearer((x,), radius), (all_distances(x) < radius[:, None]).sum(1))
    assert np.array_equal(nn.count_nearer((x, y), radius * 1.5), (all_distances(x, y) < 1.5 * radius[:, None]).sum(1))
    assert nn.mutual_information(x, y, k)["mi_knn"] == pytest.approx(whole_mi(x, y, k), abs=1e-12)
    if n > k + 2:
        assert nn.transfer_entropy(x, y, 1, k)["te_knn"] == pytest.approx(whole_te(x, y, 1, k), abs=1e-12)


def test_many_samples_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(9)
    x = rng.normal(size=100_000)
    y = 0.6 * x + 0.8 * rng.normal(size=100_000)
    tracemalloc.start()
    mi = nn.mutual_information(x, y)["mi_knn"]
    assert tracemalloc.get_traced_memory()[1] < 200e6 and mi == pytest.approx(-0.5 * math.log(1 - 0.36), abs=0.02)
    tracemalloc.stop()


def test_gaps_do_not_change_the_measure(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=80), rng.normal(size=80)
    holes = x.copy()
    holes[[3, 40]] = np.nan
    keep = np.isfinite(holes)
    assert nn.mutual_information(holes, y)["mi_knn"] == pytest.approx(whole_mi(x[keep], y[keep], 3))
    assert np.isfinite(nn.transfer_entropy(holes, y)["te_knn"])
    nothing = np.full(10, np.nan)
    assert nn.mutual_information(nothing, y[:10]) == {"mi_knn": None} and nn.transfer_entropy(nothing, y[:10]) == {"te_knn": None}
    assert kn.lempel_ziv(holes)["lzc"] == kn.lempel_ziv(x[keep])["lzc"] and kn.lempel_ziv(nothing) == {"lzc": None} == kn.lempel_ziv(x[:1])
    assert np.isfinite(kn.phase_shuffled(holes, kn.seeded("a"))).all() and np.isnan(kn.phase_shuffled(nothing, kn.seeded("a"))).all()
    rows = [(0, i, None if i in (0, 5) else float(v)) for i, v in enumerate(x)] + [(1, i, None) for i in range(9)] + [(2, i, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "series_id int, idx long, x double")
    svd = {r.series_id: r.entropy for r in kn.svd_entropy(ft.svd_gram(df), ["series_id"]).collect()}
    assert 0 < svd[0] <= 1 and svd.get(1) is None and svd[2] == pytest.approx(0, abs=1e-6)
    env = fl.enveloped(df).toPandas()
    assert env[env.series_id == 0].envelope.notna().all() and env[env.series_id == 1].envelope.isna().all()


def quadratic(bits):
    s, n, phrases, at = "".join(map(str, bits)), len(bits), 0, 0
    while at < n:
        size = 1
        while at + size <= n and s[at : at + size] in s[: at + size - 1]:
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases


def test_phrases_by_automaton_equal_the_search():
    rng = np.random.default_rng(11)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 90, 200]:
        for p in (0.5, 0.1, 0.9, 0.0):
            for _ in range(12):
                bits = (rng.uniform(size=n) < p).astype(int)
                assert kn.phrases(bits) == quadratic(bits.tolist()), bits
    word = np.tile([0, 1, 1, 0, 1], 60)
    assert kn.phrases(word) == quadratic(word.tolist())


def test_windowed_and_effective_information(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=240)
    y = np.where(np.arange(240) < 120, x, rng.normal(size=240)) + 0.1 * rng.normal(size=240)
    y[7] = np.nan
    w = {r.w: r for r in nn.windowed_information(pairs(spark, x, y), 120, 120, 10.0, ["pair_id"]).collect()}
    assert w[0].mi_knn > 1 > 0.3 > w[1].mi_knn and [w[k].time_centre for k in (0, 1)] == [6.0, 18.0]
    e = nn.effective_information(pairs(spark, x[:120], y[:120]), 19, ["pair_id"]).first()
    assert e.effective == pytest.approx(e.observed - e.null_mean) and e.effective > 0.8 and e.p == 0.05


def test_metrics_as_plans(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=200)
    p = pairs(spark, x, x + rng.normal(size=200))
    for metric in (lambda rows, by: rows.groupBy(*by).agg(F.corr("x", "y").alias("value")), lambda rows, by: cp.mutual_information(cp.binned(rows, 3, by), by).withColumnRenamed("mi_nats", "value")):
        for method in ("shift", "phase"):
            assert su.tested_metric(p, metric, 19, ["pair_id"], method).first().p == 0.05
    with pytest.raises(ValueError):
        su.tested_metric(p, metric, 19, ["pair_id"], "other")


def test_exponents_by_name_or_function(spark):
    rng = np.random.default_rng(14)
    noise = rng.normal(size=256)
    p = pairs(spark, noise, np.cumsum(rng.normal(size=256)))
    for name in cp.EXPONENTS:
        assert cp.matched_exponents(p, name, [8, 16, 32]).first().match < 0.9
    assert cp.matched_exponents(p, lambda df, s, k: df.groupBy(*k).agg(F.lit(0.5).alias("exponent")), []).first().match == 1
    with pytest.raises(KeyError):
        cp.matched_exponents(p, "none", [8])


def whole_apen(x, m=2, r=0.2):
    def phi(size):
        t = np.array([x[k : len(x) - size + 1 + k] for k in range(size)])
        near = (np.abs(t[:, :, None] - t[:, None, :]).max(0) <= r * x.std()).sum(1)
        return np.log(near / t.shape[1]).mean()

    return phi(m) - phi(m + 1)


def test_approximate_entropy(spark):
    rng = np.random.default_rng(15)
    noise, ties = rng.normal(size=60), np.round(rng.normal(size=60))
    rows = [(0, i, float(v)) for i, v in enumerate(noise)] + [(1, i, float(v)) for i, v in enumerate(ties)] + [(2, i, 1.0) for i in range(20)] + [(3, i, None) for i in range(20)] + [(4, 0, 1.0)]
    got = {r.series_id: r.apen for r in ft.approximate_entropy(spark.createDataFrame(rows, "series_id int, idx long, x double")).collect()}
    assert got[0] == pytest.approx(whole_apen(noise), abs=1e-9) and got[1] == pytest.approx(whole_apen(ties), abs=1e-9)
    assert (got[2], got[3], got[4]) == (None, None, None)
