"""Granger causality from lagged products: one aggregation per window, from which every order and every model is solved.

The sum of products of two series over any range of samples, at any pair of lags, is a lagged product over the whole window
less what its first and last samples add. So a window's products at lags 0 to P, its sums and its P samples at either end
are all that the orders 1 to P need, each over its own samples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import special
from .series import detrended, ordered

CRITERIA = ("aic", "bic", "hqic", "fpe")
_KINDS = (("x", "x"), ("x", "y"), ("y", "x"), ("y", "y"))
FOUND = "order long, f_xy double, f_yx double, p_xy double, p_yx double, direction double"


def lag_products(pairs: DataFrame, max_lag: int, keys: list[str], pos: str = "idx") -> DataFrame:
    """keys, n, sx, sy, head, tail, and xx, xy, yx, yy: arrays over lag 0 to ``max_lag`` of the sum of a[t] * b[t - lag].
    head and tail hold the first and last ``max_lag`` samples. A missing value makes every sum null."""
    w = ordered(keys, pos)
    rows = pairs.select(*keys, pos, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.withColumn("_bad", F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y"))
    late = {f"_{v}{d}": F.lag(v, d).over(w) for d in range(1, max_lag + 1) for v in "xy"}
    rows = rows.withColumns(late | {"_i": F.row_number().over(w) - 1, "_j": F.row_number().over(ordered(keys, pos).orderBy(F.col(pos).desc())) - 1})

    def total(a: str, b: str, d: int):
        return F.coalesce(F.sum(F.col(a) * (F.col(f"_{b}{d}") if d else F.col(b))), F.lit(0.0))

    ends = F.struct(F.col("_i").alias("i"), F.col("x").alias("x"), F.col("y").alias("y"))
    good = F.count_if("_bad") == 0
    sums = {f"{a}{b}": F.when(good, F.array(*[total(a, b, d) for d in range(max_lag + 1)])) for a, b in _KINDS}
    sums |= {"sx": F.when(good, F.sum("x")), "sy": F.when(good, F.sum("y"))}
    sums |= {"head": F.array_sort(F.collect_list(F.when(F.col("_i") < max_lag, ends))), "tail": F.array_sort(F.collect_list(F.when(F.col("_j") < max_lag, ends)))}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])


class Products:
    """One window's products; ``gram(p, first)`` is what a regression on lags up to ``p`` over samples ``first`` to n - 1 needs."""

    def __init__(self, row):
        self.n = int(row.n)
        self.at = {a + b: np.asarray(getattr(row, a + b), float) for a, b in _KINDS}
        self.sum = {"x": row.sx, "y": row.sy}
        self.head = {v: np.array([e[v] for e in row.head]) for v in "xy"}
        self.tail = {v: np.array([e[v] for e in row.tail]) for v in "xy"}

    def product(self, a: str, i: int, b: str, j: int, first: int) -> float:
        """Sum over t from ``first`` of a[t - i] * b[t - j]."""
        if j < i:
            a, i, b, j = b, j, a, i
        d, total = j - i, self.at[a + b][j - i]
        total -= self.head[a][d : first - i] @ self.head[b][: max(0, first - i - d)]
        if i:
            last = len(self.tail[a])
            total -= self.tail[a][last - i :] @ self.tail[b][last - i - d : last - d]
        return float(total)

    def total(self, a: str, i: int, first: int) -> float:
        last = len(self.tail[a])
        return float(self.sum[a] - self.head[a][: first - i].sum() - (self.tail[a][last - i :].sum() if i else 0.0))

    def gram(self, p: int, first: int) -> np.ndarray:
        """Products of 1, x and y at lags 1 to p, and x and y themselves: in this order."""
        names = [*[("x", k) for k in range(1, p + 1)], *[("y", k) for k in range(1, p + 1)], ("x", 0), ("y", 0)]
        out = np.empty((len(names) + 1, len(names) + 1))
        out[0, 0] = self.n - first
        for r, (a, i) in enumerate(names, 1):
            out[0, r] = out[r, 0] = self.total(a, i, first)
            for c, (b, j) in enumerate(names[:r], 1):
                out[r, c] = out[c, r] = self.product(a, i, b, j, first)
        return out


def _left(gram: np.ndarray, on: list[int], of: list[int]) -> np.ndarray:
    """What a regression of the columns ``of`` on the columns ``on`` leaves over."""
    return gram[np.ix_(of, of)] - gram[np.ix_(of, on)] @ np.linalg.lstsq(gram[np.ix_(on, on)], gram[np.ix_(on, of)], rcond=1e-13)[0]


def _score(criterion: str, log_det: float, n: int, p: int) -> float:
    """Of a model of two series with ``p`` lags and a constant over ``n`` samples."""
    each, both = 2 * p + 1, 2 * (2 * p + 1)
    if criterion == "aic":
        return log_det + 2 * both / n
    if criterion == "bic":
        return log_det + math.log(n) * both / n
    if criterion == "hqic":
        return log_det + 2 * math.log(math.log(n)) * both / n
    return 2 * math.log((n + each) / (n - each)) + log_det


def solved(row, max_lag: int, criterion: str) -> dict:
    """Order, F and p both ways and the direction of one window's products; nulls where it is too short, constant or incomplete."""
    nothing = {"order": None, "f_xy": None, "f_yx": None, "p_xy": None, "p_yx": None, "direction": None}
    if row.xx is None or row.n - max_lag <= 2 * max_lag + 2:
        return nothing
    products = Products(row)
    n = products.n - max_lag
    whole = products.gram(max_lag, max_lag)
    spread = [whole[k, k] - whole[0, k] ** 2 / n for k in (-2, -1)]
    if min(spread) <= 1e-12 * max(1.0, max(abs(whole[-2, -2]), abs(whole[-1, -1]))):
        return nothing
    now, scores = [len(whole) - 2, len(whole) - 1], {}
    for p in range(0, max_lag + 1):
        on = [0, *range(1, p + 1), *range(max_lag + 1, max_lag + p + 1)]
        det = np.linalg.det(_left(whole, on, now) / n)
        scores[p] = _score(criterion, math.log(max(det, 1e-300)), n, p)
    p = max(1, min(scores, key=scores.get))
    g, rows = products.gram(p, p), products.n - p
    free = rows - 2 * p - 1
    lags = {"x": list(range(1, p + 1)), "y": list(range(p + 1, 2 * p + 1))}
    out = {"order": p}
    for name, own, target in (("xy", "y", 2 * p + 2), ("yx", "x", 2 * p + 1)):
        full = max(float(_left(g, [0, *lags["x"], *lags["y"]], [target])[0, 0]), 1e-300)
        alone = float(_left(g, [0, *lags[own]], [target])[0, 0])
        f = max(0.0, (alone - full) / p) / (full / free)
        out |= {f"f_{name}": f, f"p_{name}": special.f_upper(f, p, 2 * free)}  # two equations, so twice the degrees
    low = 1e-300
    out["direction"] = math.log10(max(out["p_yx"], low)) - math.log10(max(out["p_xy"], low))
    return out


def granger(pairs: DataFrame, keys: list[str], max_lag: int = 10, criterion: str = "aic", detrend: bool = True, pos: str = "idx") -> DataFrame:
    """keys, order, f_xy, f_yx, p_xy, p_yx, direction: does x's past help to foretell y (xy), and the other way round?

    The order is that of the least criterion (aic, bic, hqic or fpe) over the samples that the longest has, at least 1; F is
    taken over the samples that the chosen order has, against twice its free degrees. direction is positive where x drives y.
    A window that is short, constant or has a missing value gets nulls.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    rows = pairs.select(*keys, pos, "x", "y")
    for v in ("x", "y") if detrend else ():
        rows = detrended(rows, keys, v, pos, v)
    products = lag_products(rows, max_lag, keys, pos)

    @F.pandas_udf(FOUND)
    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        found = [solved(r, max_lag, criterion) for r in frame.itertuples(index=False)]
        return pd.DataFrame(found, columns=[p.split()[0] for p in FOUND.split(", ")]).astype({"order": "Int64"})

    inputs = F.struct("n", "sx", "sy", "xx", "xy", "yx", "yy", "head", "tail")
    return products.select(*keys, fitted(inputs).alias("_f")).select(*keys, "_f.*")
