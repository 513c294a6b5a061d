"""Models with two crossed random effects (subject and channel) on tables of any balance.

Spark adds up one row per model, subject and channel; whatever the number of observations, a model's kernel sees those
sums only. It eliminates the subjects, whose block is diagonal, and solves what is left for the channels, at every pair of
variance ratios that the profile of the likelihood asks for.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import special

_TABLE = "term string, kind string, coefficient double, se double, z double, p double"
_MODEL = "n_obs long, n_subjects long, n_channels long, var_subject double, var_channel double, var_residual double, loglik double, omnibus_chi2 double, omnibus_p double, lrt_chi2 double, lrt_p double"


def crossed_sums(df: DataFrame, keys: list[str], subject: str, channel: str, design: list[str], value: str) -> DataFrame:
    """keys, subject, channel, n, sy, yy and, for design columns i <= j, s_i, y_i and x_i_j: sums over complete rows."""
    v = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (subject, channel, value, *design)))
    y, x = F.col(value).cast("double"), [F.col(c).cast("double") for c in design]
    sums = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy")]
    sums += [F.sum(c).alias(f"s_{i}") for i, c in enumerate(x)] + [F.sum(c * y).alias(f"y_{i}") for i, c in enumerate(x)]
    sums += [F.sum(x[i] * x[j]).alias(f"x_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return v.groupBy(*keys, F.col(subject).alias("subject"), F.col(channel).alias("channel")).agg(*sums)


class CrossedModel:
    """y on an intercept and ``p - 1`` columns, an intercept per subject and per channel, from the sums of ``crossed_sums``."""

    def __init__(self, cells: pd.DataFrame, p: int):
        s, self.subjects = pd.factorize(cells["subject"])
        c, self.channels = pd.factorize(cells["channel"])
        if len(self.channels) > len(self.subjects):  # the larger side is eliminated
            s, c, self.swapped = c, s, True
        else:
            self.swapped = False
        n = cells["n"].to_numpy(float)
        rows = np.column_stack([n, *(cells[f"s_{i}"].to_numpy(float) for i in range(p - 1)), cells["sy"].to_numpy(float)])
        size = (s.max(initial=-1) + 1, c.max(initial=-1) + 1)
        self.cells = np.zeros(size)
        np.add.at(self.cells, (s, c), n)
        self.zs, self.zc = np.zeros((size[0], p + 1)), np.zeros((size[1], p + 1))
        np.add.at(self.zs, s, rows)
        np.add.at(self.zc, c, rows)
        self.n, self.p = n.sum(), p
        g = np.zeros((p + 1, p + 1))
        g[0, 0], g[0, p], g[p, p] = self.n, cells["sy"].sum(), cells["yy"].sum()
        for i in range(p - 1):
            g[0, i + 1], g[i + 1, p] = cells[f"s_{i}"].sum(), cells[f"y_{i}"].sum()
            for j in range(i, p - 1):
                g[i + 1, j + 1] = cells[f"x_{i}_{j}"].sum()
        self.gram = np.triu(g) + np.triu(g, 1).T

    def whitened(self, subject: float, channel: float) -> tuple[np.ndarray, float]:
        """[X y]' V^-1 [X y] and log det V, for V = I + subject Zs Zs' + channel Zc Zc'."""
        a, off = 1 + subject * self.cells.sum(1), math.sqrt(subject * channel) * self.cells
        left = np.diag(1 + channel * self.cells.sum(0)) - off.T @ (off / a[:, None])
        us, uc = math.sqrt(subject) * self.zs, math.sqrt(channel) * self.zc
        rest = uc - off.T @ (us / a[:, None])
        taken = us.T @ (us / a[:, None]) + rest.T @ np.linalg.solve(left, rest)
        return self.gram - taken, np.log(a).sum() + np.linalg.slogdet(left)[1]

    def fit(self, ratios: tuple[float, float], reml: bool, columns: list[int]):
        """Log-likelihood, coefficients, covariance, residual variance."""
        g, log_det = self.whitened(*ratios)
        xx, xy, yy = g[np.ix_(columns, columns)], g[columns, -1], g[-1, -1]
        beta = np.linalg.solve(xx, xy)
        free = self.n - (len(columns) if reml else 0)
        variance = max((yy - xy @ beta) / free, 1e-300)
        like = -0.5 * (free * (math.log(2 * math.pi * variance) + 1) + log_det + (np.linalg.slogdet(xx)[1] if reml else 0.0))
        return like, beta, variance * np.linalg.inv(xx), variance

    def best(self, reml: bool, columns: list[int]) -> tuple[float, float]:
        """The two ratios of the largest likelihood: a grid, then a compass search on logarithms; a side may be 0."""
        def like(r):
            return self.fit(r, reml, columns)[0]

        sides = [[0.0, *np.geomspace(1e-4, 1e4, 9)] if n > 1 else [0.0] for n in self.cells.shape]
        at = max(product(*sides), key=like)
        top, step = like(at), 1.0
        while step > 1e-9:
            moves = [tuple(v * math.exp(d * step) if k == side else v for k, v in enumerate(at)) for side in (0, 1) if at[side] > 0 for d in (-1, 1)]
            found = max(moves, key=like, default=at)
            if moves and like(found) > top:
                at, top = found, like(found)
            else:
                step /= 2
        for side in (0, 1):  # a ratio on its way to 0
            zero = tuple(0.0 if k == side else v for k, v in enumerate(at))
            if at[side] < 1e-4 and like(zero) >= top - 1e-9:
                at, top = zero, like(zero)
        return at


def _wald(beta: np.ndarray, cov: np.ndarray, contrast: np.ndarray) -> dict:
    value, se = float(contrast @ beta), math.sqrt(max(float(contrast @ cov @ contrast), 1e-300))
    return {"coefficient": value, "se": se, "z": value / se, "p": special.normal_two_sided(value / se)}


def solved(cells: pd.DataFrame, names: list[str], levels: int) -> tuple[list[dict], dict]:
    """Rows of terms and contrasts, and the numbers of the whole model. The first ``levels`` columns after the intercept are
    the levels of one factor against its first: they are tested jointly, and against each other."""
    p = len(names) + 1
    columns = list(range(p))
    model = CrossedModel(cells, p)
    sizes = {"n_obs": int(model.n), "n_subjects": len(model.subjects), "n_channels": len(model.channels)}
    if min(len(model.subjects), len(model.channels)) < 1 or len(model.subjects) < 2 or model.n <= p + 1 or np.linalg.matrix_rank(model.gram[:p, :p], tol=1e-9 * max(model.n, 1)) < p:
        return [], sizes
    ratios = model.best(True, columns)
    like, beta, cov, variance = model.fit(ratios, True, columns)
    unit = np.eye(p)
    rows = [{"term": name, "kind": "fixed"} | _wald(beta, cov, unit[k]) for k, name in enumerate(["intercept", *names])]
    rows += [{"term": f"{names[i]} - {names[j]}", "kind": "contrast"} | _wald(beta, cov, unit[i + 1] - unit[j + 1]) for i in range(levels) for j in range(i)]
    subject, channel = ratios[::-1] if model.swapped else ratios
    whole = sizes | {"var_subject": subject * variance, "var_channel": channel * variance, "var_residual": variance, "loglik": like}
    if levels:
        some = slice(1, levels + 1)
        chi2 = float(beta[some] @ np.linalg.solve(cov[some, some], beta[some]))
        less = [0, *range(levels + 1, p)]
        ml = [model.fit(model.best(False, c), False, c)[0] for c in (columns, less)]
        ratio = max(0.0, 2 * (ml[0] - ml[1]))
        whole |= {"omnibus_chi2": chi2, "omnibus_p": special.chi2_upper(chi2, levels), "lrt_chi2": ratio, "lrt_p": special.chi2_upper(ratio, levels)}
    return rows, whole


def crossed_model(df: DataFrame, keys: list[str], subject: str, channel: str, condition: str, levels: list[str], value: str = "value", covariates: list[str] | None = None) -> DataFrame:
    """A row per term and contrast of value ~ condition + covariates + (1 | subject) + (1 | channel), one model per ``keys``.

    Columns: keys, term, kind (fixed, contrast), coefficient, se, z, p (Wald), and of the whole model n_obs, n_subjects,
    n_channels, the three variances and the restricted log-likelihood, omnibus_chi2 and omnibus_p (all levels jointly),
    lrt_chi2 and lrt_p (maximum likelihood with and without the levels). ``levels`` are the condition's values, the first
    being the reference; other values and rows with a null are left out. Models with fewer than two subjects, or whose
    columns depend on each other, give no rows. Ties and constant values are no special case: a constant value has variances 0.
    """
    dummies = [(F.col(condition) == level).cast("int") for level in levels[1:]]
    rows = df.filter(F.col(condition).isin(levels)).withColumns({f"_l{i}": d for i, d in enumerate(dummies)})
    names = [f"{level}" for level in levels[1:]] + list(covariates or [])
    design = [f"_l{i}" for i in range(len(dummies))] + list(covariates or [])
    kinds, n_levels = dict(df.dtypes), len(dummies)

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        found, whole = solved(cells, names, n_levels)
        return pd.DataFrame([{k: cells[k].iloc[0] for k in keys} | row | whole for row in found], columns=columns)

    sums = crossed_sums(rows, keys, subject, channel, design, value)
    columns = [*keys, *(part.split()[0] for part in f"{_TABLE}, {_MODEL}".split(", "))]
    return sums.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _TABLE, _MODEL]))


def block_model(df: DataFrame, keys: list[str], subject: str, block: str, first: str, second: str, value: str = "value") -> DataFrame:
    """keys, n_windows, n_subjects, coefficient, se, z, p, method of value ~ block + (1 | subject), ``second`` against
    ``first``, on rows such as windows. Null values and other blocks are left out; fewer than three subjects, or one block
    only, give nulls."""
    from .models import random_intercept

    rows = df.filter(F.col(block).isin(first, second) & F.col(value).isNotNull()).withColumn("_block", (F.col(block) == second).cast("int"))
    fit = random_intercept(rows, keys, subject, "_block", value)
    size = rows.groupBy(*keys).agg(F.count_distinct(subject).alias("n_subjects"))
    both = fit.join(size, keys) if keys else fit.crossJoin(size)  # one row each
    enough = F.col("n_subjects") >= 3
    return both.select(*keys, F.col("n").alias("n_windows"), "n_subjects", *[F.when(enough, F.col(c)).alias(c) for c in ("coefficient", "se", "z", "p")], "method")
