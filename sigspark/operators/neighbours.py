"""Information by nearest neighbours, without the matrix of all distances.

Points are put in order of one coordinate; a point's neighbours are looked for in a growing stretch of that order, until the
k-th best distance is no larger than the gap to what lies outside. Counts of points nearer than a radius look at the stretch
that the first coordinate allows, and in one dimension at two places of the sorted values. Memory is a slice of points
times their stretch, whatever the number of samples; equal values are counted as by the full matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import ratio
from . import kernels as kn
from .series import exploded_windows, filled

#: Distances that one step holds.
CELLS = 1 << 21
#: Samples up to which all distances of a window are found at once.
SHORT = 128


def kth_distance(columns: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The Chebyshev distance of every point to its k-th nearest other point."""
    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    points = [c[order] for c in columns]
    first = points[0]
    out = np.full(n, np.inf)
    left, half = np.arange(n), max(4 * k, int(np.sqrt(n * k)) // 2)
    while len(left):
        half = min(half, n)
        offsets = np.arange(-half, half + 1)
        open_ = []
        for a in range(0, len(left), max(1, CELLS // len(offsets))):
            i = left[a : a + max(1, CELLS // len(offsets))]
            j = i[:, None] + offsets
            outside = (j < 0) | (j >= n) | (offsets == 0)
            j = np.clip(j, 0, n - 1)
            d = np.abs(first[i][:, None] - first[j])
            for p in points[1:]:
                np.maximum(d, np.abs(p[i][:, None] - p[j]), out=d)
            d[outside] = np.inf
            best = np.partition(d, k - 1, axis=1)[:, k - 1]
            before, after = i - half - 1, i + half + 1
            gap = np.minimum(np.where(before >= 0, first[i] - first[np.maximum(before, 0)], np.inf), np.where(after < n, first[np.minimum(after, n - 1)] - first[i], np.inf))
            out[i] = best
            open_.append(i[best > gap])
        left = np.concatenate(open_)
        half *= 2
    back = np.empty(n)
    back[order] = out
    return back


def _stretch(values: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places, in order of ``values`` (sorted), of those whose difference is below each one's radius: by the
    difference itself, so that rounding decides as it does between two points."""
    kinds, first = np.unique(values, return_index=True)
    bounds = np.append(first, len(values))
    own = np.searchsorted(kinds, values)
    low = np.clip(np.searchsorted(kinds, values - radius), 0, own)
    high = np.clip(np.searchsorted(kinds, values + radius, "right") - 1, own, len(kinds) - 1)
    inside = lambda at: np.abs(kinds[at] - values) < radius
    while (move := (low > 0) & inside(np.maximum(low - 1, 0))).any():
        low[move] -= 1
    while (move := (low < own) & ~inside(low)).any():
        low[move] += 1
    while (move := (high < len(kinds) - 1) & inside(np.minimum(high + 1, len(kinds) - 1))).any():
        high[move] += 1
    while (move := (high > own) & ~inside(high)).any():
        high[move] -= 1
    none = ~inside(own)  # a radius of 0
    return np.where(none, 0, bounds[low]), np.where(none, 0, bounds[high + 1])


def count_nearer(columns: tuple[np.ndarray, ...], radius: np.ndarray) -> np.ndarray:
    """How many other points lie nearer than each point's radius."""
    order = np.argsort(columns[0], kind="stable")
    points, r = [c[order] for c in columns], radius[order]
    begin, end = _stretch(points[0], r)
    found = np.maximum(end - begin - 1, 0)
    if len(points) > 1:
        found, at = np.zeros(len(r), np.int64), 0
        wide = np.maximum(end - begin, 1)
        while at < len(r):
            to = at + max(1, int(np.searchsorted(np.cumsum(wide[at:]), CELLS)))
            size = (end - begin)[at:to]
            i = np.repeat(np.arange(at, min(to, len(r))), size)
            j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[at:to], size)
            near = i != j
            for p in points[1:]:
                near &= np.abs(p[i] - p[j]) < r[i]
            found[at:to] = np.bincount(i[near] - at, minlength=len(size))
            at = to
    back = np.empty(len(r), np.int64)
    back[order] = found
    return back


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> dict:
    """Kraskov's first estimator, nats, not below 0; null with too few points."""
    x, y = kn.complete(x, y)
    if len(x) <= k + 1:
        return {"mi_knn": None}
    x, y = kn.scaled(x), kn.scaled(y)
    radius = kth_distance((x, y), k)
    nx, ny = count_nearer((x,), radius), count_nearer((y,), radius)
    value = kn.digamma(np.array([k]))[0] + kn.digamma(np.array([len(x)]))[0] - (kn.digamma(nx + 1) + kn.digamma(ny + 1)).mean()
    return {"mi_knn": max(0.0, float(value))}


def transfer_entropy(x: np.ndarray, y: np.ndarray, lag: int = 1, k: int = 3) -> dict:
    """x to y on ranks: what x's past adds about y's next value given y's past, nats. Steps with a missing value are left out."""
    r = [np.full(len(v), np.nan) for v in (x, y)]
    for rank, v in zip(r, (x, y)):
        some = np.flatnonzero(np.isfinite(v))
        rank[some] = np.argsort(np.argsort(v[some], kind="stable"), kind="stable") / max(1, len(some))
    future, past, source = kn.complete(r[1][lag:], r[1][:-lag], r[0][:-lag])
    if len(future) <= k + 1:
        return {"te_knn": None}
    radius = kth_distance((future, past, source), k)
    n_z, n_fz, n_sz = (count_nearer(c, radius) for c in ((past,), (past, future), (past, source)))
    value = kn.digamma(np.array([k]))[0] + (kn.digamma(n_z + 1) - kn.digamma(n_fz + 1) - kn.digamma(n_sz + 1)).mean()
    return {"te_knn": float(value)}


def windowed_information(pairs: DataFrame, width: int, step: int, fs: float, keys: list[str], k: int = 3) -> DataFrame:
    """keys, w, time_centre, mi_knn of every complete window; missing samples are filled first."""
    whole = filled(filled(pairs.select(*keys, "idx", "x", "y"), keys, "x", out="x"), keys, "y", out="y")
    w = exploded_windows(whole, width, step, keys)
    found = kn.per_group(w, [*keys, "w"], ["x", "y"], lambda x, y: mutual_information(x, y, k), "mi_knn double", "pos")
    return found.withColumn("time_centre", (F.col("w") * step + width / 2) / fs)


def _many(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """``mutual_information`` of every row of two matrices of finite values: short rows, so all distances of a slice of rows at once."""
    rows, n = x.shape
    out, of = np.empty(rows), np.r_[np.nan, kn.digamma(np.arange(1, n + 1))]
    own = np.arange(n)
    for first in range(0, rows, max(1, CELLS // (4 * n * n))):
        part = slice(first, first + max(1, CELLS // (4 * n * n)))
        u, v = (np.stack([kn.scaled(r) for r in m[part]]) for m in (x, y))
        du, dv = (np.abs(m[:, :, None] - m[:, None, :]) for m in (u, v))
        du[:, own, own] = dv[:, own, own] = np.inf
        radius = np.partition(np.maximum(du, dv), k - 1, axis=2)[:, :, k - 1 : k]
        nx, ny = (du < radius).sum(2), (dv < radius).sum(2)
        out[part] = np.maximum(0.0, of[k] + of[n] - (of[nx + 1] + of[ny + 1]).mean(1))
    return out


def _tested_rows(surrogates: int, keys: list[str], k: int):
    """For every gathered window the information of its pair and of each surrogate (null with too few points), in one list."""
    n = surrogates + 1

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ys: pd.Series, names: pd.Series) -> pd.Series:
        found = np.full((len(xs), n), np.nan)
        whole: dict[int, tuple[list, list, list]] = {}
        for r, (x, y, name) in enumerate(zip(xs, ys, names)):
            x, y = np.array(x, float), np.array(y, float)
            moved = [y, *(kn.phase_shuffled(y, kn.seeded(*name, s)) for s in range(1, n))]
            if k + 1 < len(x) <= SHORT and np.isfinite(x).all() and np.isfinite(y).all():
                at, left, right = whole.setdefault(len(x), ([], [], []))
                at.append(r), left.append(x), right.append(moved)
            else:
                found[r] = [np.nan if (v := mutual_information(x, m, k)["mi_knn"]) is None else v for m in moved]
        for at, left, right in whole.values():
            right = np.array(right)
            found[at] = _many(np.repeat(np.array(left), n, axis=0), right.reshape(-1, right.shape[2]), k).reshape(-1, n)
        return pd.Series([[None if v != v else float(v) for v in row] for row in found])

    return run


def effective_information(pairs: DataFrame, surrogates: int, keys: list[str], k: int = 3) -> DataFrame:
    """keys, observed, null_mean, null_std, effective (observed less the mean of phase-shuffled surrogates), p, z. With a
    window among the keys this is the windowed form. A pair is gathered once; its surrogates are drawn and tested where it stands,
    and are never rows."""
    values = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", *values))).alias("_v"))
    names = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    found = rows.select(*keys, _tested_rows(surrogates, keys, k)(F.col("_v.x"), F.col("_v.y"), names).alias("_f"))
    found = found.select(*keys, F.transform("_f", lambda v: F.round(v, 9)).alias("_f")).select(*keys, F.col("_f")[0].alias("observed"), F.filter(F.slice("_f", 2, max(surrogates, 1)), lambda v: v.isNotNull()).alias("_null"))
    size = F.size("_null").cast("double")
    mean = ratio(F.aggregate("_null", F.lit(0.0), lambda a, v: a + v), size)
    found = found.withColumn("null_mean", mean)
    spread = F.sqrt(ratio(F.aggregate("_null", F.lit(0.0), lambda a, v: a + (v - F.col("null_mean")) * (v - F.col("null_mean"))), size))
    beyond = F.size(F.filter("_null", lambda v: v >= F.col("observed")))
    tested = found.withColumns({"null_std": spread, "p": (beyond + 1) / (F.size("_null") + 1)})
    gap = F.col("observed") - F.col("null_mean")
    return tested.select(*keys, "observed", "null_mean", "null_std", gap.alias("effective"), "p", ratio(gap, "null_std").alias("z"))
