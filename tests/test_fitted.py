"""Crossed models, clustered regression and ranks of whole tables against dense solutions and plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import crossed as cr, models as md, statistics as stat


def crossed_table(n, seed, balanced=False):
    rng = np.random.default_rng(seed)
    s, c, m = (np.repeat(np.arange(10), 15), np.tile(np.repeat(np.arange(5), 3), 10), np.tile(np.arange(3), 50)) if balanced else (rng.integers(0, 14, n), rng.integers(0, 6, n), rng.integers(0, 3, n))
    y = 1.0 + 0.8 * (m == 1) - 0.3 * (m == 2) + rng.normal(0, 1.5, 20)[s] + rng.normal(0, 0.7, 8)[c] + rng.normal(0, 0.5, len(s))
    return pd.DataFrame({"k": "m", "s": s, "c": c, "cond": np.array(["a", "b", "c"])[m], "y": y})


def dense(t, ratios, reml, columns=(0, 1, 2)):
    """Log-likelihood, coefficients and covariance with the whole covariance matrix of the observations."""
    x = np.column_stack([np.ones(len(t)), t.cond == "b", t.cond == "c"]).astype(float)[:, list(columns)]
    zs, zc = (pd.get_dummies(t[v]).to_numpy(float) for v in ("s", "c"))
    v = np.eye(len(t)) + ratios[0] * zs @ zs.T + ratios[1] * zc @ zc.T
    inverse = np.linalg.inv(v)
    xx = x.T @ inverse @ x
    beta = np.linalg.solve(xx, x.T @ inverse @ t.y)
    r = t.y - x @ beta
    free = len(t) - (x.shape[1] if reml else 0)
    variance = r @ inverse @ r / free
    like = -0.5 * (free * (math.log(2 * math.pi * variance) + 1) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(xx)[1] if reml else 0))
    return like, beta, variance * np.linalg.inv(xx), variance


def fitted(spark, t, **more):
    return {(r.term, r.kind): r for r in cr.crossed_model(spark.createDataFrame(t), ["k"], "s", "c", "cond", ["a", "b", "c"], "y", **more).collect()}


def test_unbalanced_crossed_model_equals_a_dense_solution(spark):
    t = crossed_table(200, 1)
    found = fitted(spark, t)
    r = found["b", "fixed"]
    ratios = r.var_subject / r.var_residual, r.var_channel / r.var_residual
    like, beta, cov, variance = dense(t, ratios, True)
    assert r.loglik == pytest.approx(like, abs=1e-7) and r.var_residual == pytest.approx(variance, rel=1e-8)
    for k, name in enumerate(("intercept", "b", "c")):
        assert found[name, "fixed"].coefficient == pytest.approx(beta[k], abs=1e-8) and found[name, "fixed"].se == pytest.approx(math.sqrt(cov[k, k]), abs=1e-8)
    contrast = np.array([0, -1.0, 1.0])
    assert found["c - b", "contrast"].coefficient == pytest.approx(contrast @ beta, abs=1e-8) and found["c - b", "contrast"].se == pytest.approx(math.sqrt(contrast @ cov @ contrast), abs=1e-8)
    assert r.omnibus_chi2 == pytest.approx(beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:]), rel=1e-7)
    for side in (0, 1):  # no neighbouring ratio is better
        for f in (0.99, 1.01):
            other = [v * f if k == side else v for k, v in enumerate(ratios)]
            assert dense(t, other, True)[0] <= like + 1e-9
    assert (r.n_obs, r.n_subjects, r.n_channels) == (200, t.s.nunique(), t.c.nunique())


def test_likelihood_ratio_of_a_grid_search(spark):
    t = crossed_table(150, 2)
    grid = [(a, b) for a in np.geomspace(0.2, 60, 26) for b in np.geomspace(0.05, 20, 26)]
    top = [max(dense(t, g, False, c)[0] for g in grid) for c in ((0, 1, 2), (0,))]
    assert fitted(spark, t)["b", "fixed"].lrt_chi2 == pytest.approx(2 * (top[0] - top[1]), abs=0.1)


def test_balanced_crossed_model_equals_the_sums_of_squares(spark):
    t = crossed_table(0, 3, balanced=True)
    r = fitted(spark, t)["b", "fixed"]
    means = t.groupby("cond").y.mean()
    assert r.coefficient == pytest.approx(means["b"] - means["a"], abs=1e-9)
    x = t.y - t.groupby("cond").y.transform("mean")
    s, c = x.groupby(t.s).transform("mean"), x.groupby(t.c).transform("mean")
    error = ((x - s - c) ** 2).sum() / (150 - 10 - 5 + 1 - 2)
    between = [(15 * (x.groupby(t.s).mean() ** 2).sum() / 9 - error) / 15, (30 * (x.groupby(t.c).mean() ** 2).sum() / 4 - error) / 30]
    assert (r.var_residual, r.var_subject, r.var_channel) == pytest.approx((error, *between), rel=1e-4)


def test_crossed_edges(spark):
    t = crossed_table(80, 4)
    gaps = t.assign(y=t.y.where(t.index % 7 != 0))
    with_null = spark.createDataFrame(gaps.astype(object).where(gaps.notna(), None), "k string, s long, c long, cond string, y double")
    rows = cr.crossed_model(with_null, ["k"], "s", "c", "cond", ["a", "b", "c"], "y").collect()
    assert {r.n_obs for r in rows} == {gaps.y.notna().sum()}
    flat = [r.var_subject for r in cr.crossed_model(spark.createDataFrame(t.assign(y=1.0)), ["k"], "s", "c", "cond", ["a", "b", "c"], "y").collect()]
    assert flat == pytest.approx([0] * 4, abs=1e-9)
    assert fitted(spark, t[t.s == t.s.iloc[0]]) == {} and fitted(spark, t[t.cond == "a"]) == {}
    assert cr.crossed_model(spark.createDataFrame(t).limit(0), ["k"], "s", "c", "cond", ["a", "b"], "y").count() == 0


def test_block_model(spark):
    rng = np.random.default_rng(5)
    rows = [(0, s, b, float(2 * (b == "N") + u + 0.3 * rng.normal())) for s, u in enumerate(rng.normal(0, 2, 8)) for b in "RN" for _ in range(6)]
    df = spark.createDataFrame([*rows, (0, 1, "X", 9.0), (0, 1, "R", None)], "k int, s int, b string, value double")
    r = cr.block_model(df, ["k"], "s", "b", "R", "N").first()
    assert r.coefficient == pytest.approx(2, abs=0.3) and (r.n_windows, r.n_subjects) == (96, 8) and r.p < 1e-9
    assert cr.block_model(df.filter("s < 2"), ["k"], "s", "b", "R", "N").first().coefficient is None


def whole_gee(v, y, g, rounds=200):
    """The same estimating equations on raw arrays, with every subject's whole matrix."""
    d = np.column_stack([np.ones(len(v)), (v - v.mean()) / v.std()])
    parts, beta, alpha = [np.flatnonzero(g == k) for k in np.unique(g)], np.zeros(2), 0.0
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-d @ beta))
        sd = np.sqrt(mu * (1 - mu))
        r = (y - mu) / sd
        bread, meat, score = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros(2)
        for p in parts:
            inverse = np.linalg.inv((1 - alpha) * np.eye(len(p)) + alpha)
            w = d[p] * sd[p, None]
            u = w.T @ inverse @ r[p]
            bread, meat, score = bread + w.T @ inverse @ w, meat + np.outer(u, u), score + u
        beta = beta + np.linalg.solve(bread, score)
        pairs = sum(len(p) * (len(p) - 1) for p in parts)
        alpha = sum(r[p].sum() ** 2 - (r[p] ** 2).sum() for p in parts) / pairs
    mu = 1 / (1 + np.exp(-d @ beta))
    se = np.sqrt((np.linalg.inv(bread) @ meat @ np.linalg.inv(bread))[1, 1])
    wins = (mu[y == 1][:, None] > mu[y == 0]).mean() + 0.5 * (mu[y == 1][:, None] == mu[y == 0]).mean()
    return beta[1], se, alpha, ((mu > 0.5) == (y == 1)).mean(), wins


def test_distributed_gee_equals_whole_matrices(spark):
    rng = np.random.default_rng(10)
    rows = [(k, s, x, int(rng.uniform() < 1 / (1 + math.exp(-(1.2 - k) * x - u)))) for k in (0, 1) for s, u in enumerate(rng.normal(0, 0.8, 20)) for x in np.round(rng.normal(size=4 + s % 9), 1).tolist()]
    df = spark.createDataFrame([*rows, (0, 3, None, 1), (0, None, 1.0, 1), (2, 0, 1.0, 1), (2, 1, 1.0, 0), (None, 0, 1.0, 1)], "k int, subject int, x double, label int")
    found = {r.k: r for r in md.gee_logistic(df, ["k"], "subject", "x", "label").collect()}
    for k in (0, 1):
        v, y, g = (np.array([r[i] for r in rows if r[0] == k]) for i in (2, 3, 1))
        r = found[k]
        assert (r.coefficient, r.robust_se, r.correlation, r.accuracy, r.auc) == pytest.approx(whole_gee(v, y, g), abs=1e-8)
        assert r.converged and r.structure == "exchangeable" and r.n == len(v)
    assert found[2].coefficient is None and found[None].coefficient is None
    two = md.gee(df.withColumn("z", F.col("x") * F.col("x")), ["k"], "subject", ["x", "z"], "label").filter("k = 0").collect()
    assert {r.term for r in two} == {"x", "z"} and len({r.auc for r in two}) == 1


def test_no_group_of_the_scoring_holds_rows(spark):
    df = spark.createDataFrame([(0, s, float(i), i % 2) for s in range(4) for i in range(50)], "k int, subject int, x double, label int")
    rows = md._standardised(df, ["k"], "subject", ["x"], "label")
    state = spark.createDataFrame([(0, [0.0, 0.0], 0.0)], "k int, _beta array<double>, _alpha double")
    plan = md._scoring_sums(rows, state, ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan


def loops(p):
    known = sorted((v, i) for i, v in enumerate(p) if v is not None and v == v)
    m, bh, holm = len(known), {}, {}
    low = 1.0
    for k in range(m, 0, -1):
        low = min(low, known[k - 1][0] * m / k)
        bh[known[k - 1][1]] = low
    high = 0.0
    for k in range(1, m + 1):
        high = max(high, known[k - 1][0] * (m - k + 1))
        holm[known[k - 1][1]] = min(1.0, high)
    # equal p share what the last (first) of them gets
    return [(bh.get(i), holm.get(i)) for i in range(len(p))]


def test_ranks_of_a_whole_table(spark):
    rng = np.random.default_rng(12)
    p = [*np.round(rng.uniform(0, 1, 300), 2).tolist(), *rng.uniform(0, 1e-6, 50).tolist(), 0.0, 1.0, 1.0, None, float("nan"), 5e-324]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double").repartition(5)
    for spread in (True, False):
        got = {r.i: (r.p_fdr, r.p_holm) for r in stat.holm(stat.bh_fdr(df, spread=spread), spread=spread).collect()}
        want = loops(p)
        for i, (bh, holm) in enumerate(want):
            assert (got[i][0] is None) == (bh is None)
            if bh is not None:
                assert got[i][0] == pytest.approx(bh, abs=1e-12) and got[i][1] == pytest.approx(holm, abs=1e-12)
    keyed = df.withColumn("g", F.col("i") % 3)
    for f, out in ((stat.bh_fdr, "p_fdr"), (stat.holm, "p_holm")):
        a, b = ({r.i: r[out] for r in f(keyed, keys=["g"], spread=s).collect()} for s in (True, False))
        assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-12) if b[i] is not None else a[i] is None for i in b)
    assert stat.bh_fdr(df.limit(0)).count() == 0


def test_whole_tables_have_no_single_partition_window(spark):
    df = spark.range(100).withColumn("p", F.rand(1))
    plan = stat._family(df, "p", [])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window " in x]
    assert windows and all("_c#" in x.split("], [", 1)[1] for x in windows)


def test_running_in_both_directions(spark):
    rng = np.random.default_rng(13)
    v = np.unique(np.concatenate([rng.normal(0, 100, 200), [0.0, -1e-9, 1e9, 2.0, 4.0]])).tolist()
    df = spark.createDataFrame([(a, float(i % 7)) for i, a in enumerate(v)], "v double, x double").repartition(3)
    x = np.arange(len(v)) % 7.0
    for kind, f in (("sum", np.cumsum), ("min", np.minimum.accumulate), ("max", np.maximum.accumulate)):
        up = {r.v: r.o for r in stat.running(df, [], "v", F.col("x"), kind, "o").collect()}
        down = {r.v: r.o for r in stat.running(df, [], "v", F.col("x"), kind, "o", descending=True).collect()}
        assert [up[a] for a in v] == f(x).tolist() and [down[a] for a in v] == f(x[::-1])[::-1].tolist()


def test_area_under_the_curve(spark):
    rows = [(0, y, s) for y, s in zip([1, 0, 1, 0, 1, 0], [0.9, 0.9, 0.2, -0.3, 0.5, 0.5])] + [(1, 1, 0.5), (0, None, 1.0), (0, 1, None)]
    got = {r.k: r.auc for r in stat.auc(spark.createDataFrame(rows, "k int, y int, s double"), ["k"], "y", "s").collect()}
    assert got[0] == pytest.approx((0.5 + 1 + 1 + 0 + 1 + 0 + 0 + 1 + 0.5) / 9) and got[1] is None
