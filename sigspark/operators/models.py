"""Regression models of repeated measures. Spark sums; a kernel solves the few equations of one model."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import special
from ..functions.shared import cut_lineage


def subject_sums(df: DataFrame, keys: list[str], subject: str, x: str, y: str) -> DataFrame:
    """Per model and subject: all that a random-intercept model of y on x needs."""
    v = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, subject, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return v.groupBy(*keys, subject).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))


def _fit(n, sx, sy, sxx, sxy, syy, ratio: float):
    """Restricted likelihood, coefficients and their covariance at one ratio of variances, from subject sums."""
    shrink = ratio / (1 + n * ratio)
    a = np.array([[(n - shrink * n * n).sum(), (sx - shrink * n * sx).sum()], [0.0, (sxx - shrink * sx * sx).sum()]])
    a[1, 0] = a[0, 1]
    b = np.array([(sy - shrink * n * sy).sum(), (sxy - shrink * sx * sy).sum()])
    beta = np.linalg.solve(a, b)
    rss = (syy - shrink * sy * sy).sum() - beta @ b
    free = n.sum() - 2
    variance = max(rss / free, 1e-300)
    like = -0.5 * (free * math.log(variance) + np.log1p(n * ratio).sum() + np.linalg.slogdet(a)[1])
    return like, beta, variance * np.linalg.inv(a), variance


def random_intercept(df: DataFrame, keys: list[str], subject: str, x: str, y: str) -> DataFrame:
    """keys, n, coefficient, se, z, p, var_subject, var_residual, method: y on x with an intercept per subject.

    The ratio of variances is found on a profile of the restricted likelihood; a ratio of 0 is ordinary least squares.
    Models with fewer than two subjects, or x constant, give nulls.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        s = [frame[c].to_numpy(float) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")]
        row = {k: frame[k].iloc[0] for k in keys} | {"n": int(s[0].sum()), "coefficient": None, "se": None, "z": None, "p": None, "var_subject": None, "var_residual": None, "method": "none"}
        total = s[0].sum()
        if len(frame) > 1 and total > 3 and s[3].sum() - s[1].sum() ** 2 / total > 1e-12:
            grid = np.concatenate([[0.0], np.geomspace(1e-6, 1e6, 121)])
            likes = [_fit(*s, r)[0] for r in grid]
            k = int(np.argmax(likes))
            low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
            for _ in range(80):  # golden section inside the best grid step
                a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
                low, high = (low, b) if _fit(*s, a)[0] >= _fit(*s, b)[0] else (a, high)
            ratio = (low + high) / 2 if k else 0.0
            _, beta, cov, variance = _fit(*s, ratio)
            z = beta[1] / math.sqrt(max(cov[1, 1], 1e-300))
            row |= {"coefficient": beta[1], "se": math.sqrt(max(cov[1, 1], 0)), "z": z, "p": special.normal_two_sided(z), "var_subject": ratio * variance, "var_residual": variance, "method": "reml" if ratio > 0 else "ols"}
        return pd.DataFrame([row])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, coefficient double, se double, z double, p double, var_subject double, var_residual double, method string"])
    return subject_sums(df, keys, subject, x, y).groupBy(*keys).applyInPandas(run, schema)


def _standardised(df: DataFrame, keys: list[str], subject: str, features: list[str], label: str) -> DataFrame:
    """keys, _subject, _y, _x (an array: 1 and the standardised features) of complete rows; a feature without variance is 0."""
    complete = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (subject, label, *features)))
    x = [F.col(c).cast("double") for c in features]
    complete = complete.filter(reduce(lambda a, b: a & b, [~F.isnan(c) for c in x], F.lit(True)))
    moments = complete.groupBy(*keys).agg(F.array(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")) for c in x]).alias("_m"))
    both = on_keys(complete, moments, keys)
    scaled = [F.coalesce((c - F.col("_m")[i]["m"]) / F.nullif(F.col("_m")[i]["s"], F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(x)]
    return both.select(*keys, F.col(subject).alias("_subject"), F.col(label).cast("double").alias("_y"), F.array(F.lit(1.0), *scaled).alias("_x"))


def on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join in which null keys meet; without keys, every row meets the one row of ``right``."""
    if not keys:
        return left.crossJoin(right)  # one row
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, met).drop(*[f"_k{i}" for i in range(len(keys))])


def _scoring_sums(rows: DataFrame, state: DataFrame, keys: list[str], p: int) -> DataFrame:
    """One round: per model the score, bread and meat at its coefficients and correlation, and what the next correlation
    needs. A row per model and subject is the only thing that is grouped; it holds sums, never observations."""
    at = on_keys(rows, state, keys)
    eta = reduce(lambda a, b: a + b, [F.col("_x")[j] * F.col("_beta")[j] for j in range(p)])
    mu = F.least(F.greatest(1 / (1 + F.exp(-eta)), F.lit(1e-9)), F.lit(1 - 1e-9))
    at = at.withColumn("_mu", mu).withColumn("_sd", F.sqrt(F.col("_mu") * (1 - F.col("_mu")))).withColumn("_r", (F.col("_y") - F.col("_mu")) / F.col("_sd"))
    w = [F.col("_x")[j] * F.col("_sd") for j in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.count("*").alias("_n"), F.sum("_r").alias("_sr"), F.sum(F.col("_r") * F.col("_r")).alias("_rr"), F.first("_alpha").alias("_alpha")]
    sums += [F.sum(c).alias(f"_w{j}") for j, c in enumerate(w)] + [F.sum(c * F.col("_r")).alias(f"_wr{j}") for j, c in enumerate(w)] + [F.sum(w[i] * w[j]).alias(f"_ww{i}_{j}") for i, j in pairs]
    each = at.groupBy(*keys, "_subject").agg(*sums)
    a, n = F.col("_alpha"), F.col("_n")
    shrink = a / (1 + (n - 1) * a)  # the inverse of an exchangeable matrix is known in closed form
    u = [(F.col(f"_wr{j}") - shrink * F.col(f"_w{j}") * F.col("_sr")) / (1 - a) for j in range(p)]
    bread = [(F.col(f"_ww{i}_{j}") - shrink * F.col(f"_w{i}") * F.col(f"_w{j}")) / (1 - a) for i, j in pairs]
    out = [F.sum("_n").alias("n"), F.max("_n").alias("largest"), F.count("*").alias("subjects"), F.sum(F.col("_sr") * F.col("_sr") - F.col("_rr")).alias("shared"), F.sum(n * (n - 1)).alias("pairs")]
    out += [F.array(*[F.sum(c) for c in u]).alias("score"), F.array(*[F.sum(c) for c in bread]).alias("bread"), F.array(*[F.sum(u[i] * u[j]) for i, j in pairs]).alias("meat")]
    return each.groupBy(*keys).agg(*out)


def _square(values: list[float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = values
    return m + np.triu(m, 1).T


def gee(df: DataFrame, keys: list[str], subject: str, features: list[str], label: str, rounds: int = 60) -> DataFrame:
    """A row per model and feature: keys, term, coefficient, robust_se, z, p, and of the model n, intercept, correlation,
    structure, converged, accuracy, auc. Logistic, on standardised features, clustered by subject, exchangeable correlation.

    Every round of scoring is one aggregation per model and subject; the driver gets a model's coefficients, correlation and
    sandwich sums, never rows. Where the exchangeable fit does not converge, independence is fitted. Rows with a null or NaN
    are left out. Models with one label, fewer than two subjects or a feature without variance give nulls.
    """
    from .statistics import accuracy, auc

    p = len(features) + 1
    spark, kinds = df.sparkSession, dict(df.dtypes)
    rows = cut_lineage(_standardised(df, keys, subject, features, label))  # read once per round
    kept = rows.groupBy(*keys).agg(F.count_distinct("_y").alias("labels"), F.count("*").alias("n"), F.count_distinct("_subject").alias("subjects"), *[F.max(F.abs(F.col("_x")[j])).alias(f"v{j}") for j in range(1, p)]).collect()
    models: dict[tuple, dict] = {}
    for r in kept:
        ok = r.labels == 2 and r.subjects > 1 and all(r[f"v{j}"] > 0 for j in range(1, p))
        models[tuple(r[k] for k in keys)] = {"n": r.n, "ok": ok, "beta": [0.0] * p, "alpha": 0.0, "structure": "exchangeable", "done": not ok, "round": 0}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_beta array<double>, _alpha double"])
    while open_ := {k: m for k, m in models.items() if not m["done"]}:
        state = spark.createDataFrame([(*k, m["beta"], m["alpha"]) for k, m in open_.items()], schema)
        for r in _scoring_sums(rows, state, keys, p).collect():
            m = open_[tuple(r[k] for k in keys)]
            bread, meat = _square(r.bread, p), _square(r.meat, p)
            inverse = np.linalg.inv(bread + 1e-10 * np.eye(p))
            move = inverse @ np.array(r.score)
            alpha = float(np.clip(r.shared / r.pairs, -0.9 / r.largest, 0.95)) if r.pairs and m["structure"] == "exchangeable" else 0.0
            m["round"] += 1
            settled = np.abs(move).max() < 1e-9 and abs(alpha - m["alpha"]) < 1e-10
            bad = not np.isfinite(move).all()
            if settled:
                m |= {"done": True, "cov": inverse @ meat @ inverse, "converged": True}
            elif bad or m["round"] >= rounds:
                if m["structure"] == "exchangeable":
                    m |= {"structure": "independence", "beta": [0.0] * p, "alpha": 0.0, "round": 0}
                else:
                    m |= {"done": True, "ok": m["ok"] and not bad, "cov": inverse @ meat @ inverse, "converged": False}
            else:
                m |= {"beta": (np.array(m["beta"]) + move).tolist(), "alpha": alpha}
    found, coefficients = [], []
    for key, m in models.items():
        if m["ok"]:
            coefficients.append((*key, m["beta"], 0.0))
        for j, name in enumerate(features, 1):
            row = [None] * 4
            if m["ok"]:
                se = math.sqrt(max(m["cov"][j, j], 1e-300))
                row = [float(m["beta"][j]), se, float(m["beta"][j]) / se, special.normal_two_sided(float(m["beta"][j]) / se)]
            found.append((*key, name, *row, int(m["n"]), *((float(m["beta"][0]), float(m["alpha"]), m["structure"], m["converged"]) if m["ok"] else (None, None, None, None))))
    key_schema = [f"`{k}` {kinds[k]}" for k in keys]
    table = spark.createDataFrame(found, ", ".join([*key_schema, "term string, coefficient double, robust_se double, z double, p double, n long, intercept double, correlation double, structure string, converged boolean"]))
    scored = on_keys(rows, spark.createDataFrame(coefficients, schema), keys)
    eta = reduce(lambda a, b: a + b, [F.col("_x")[j] * F.col("_beta")[j] for j in range(p)])
    scored = scored.select(*keys, F.col("_y").alias("label"), eta.alias("score"))
    quality = on_keys(accuracy(scored, keys, "label", F.col("score") > 0), auc(scored, keys, "label", "score"), keys)
    if not keys:
        return table.crossJoin(quality)  # one row
    renamed = quality.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "accuracy", "auc")
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return table.join(renamed, met, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def gee_logistic(df: DataFrame, keys: list[str], subject: str, x: str, label: str, rounds: int = 60) -> DataFrame:
    """``gee`` with one feature: keys, n, coefficient, robust_se, z, p, correlation, structure, converged, accuracy, auc."""
    return gee(df, keys, subject, [x], label, rounds).select(*keys, "n", "coefficient", "robust_se", "z", "p", "correlation", "structure", "converged", "accuracy", "auc")
