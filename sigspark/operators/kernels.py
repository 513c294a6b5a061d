"""Measures that are true recursions or nearest-neighbour searches: numpy kernels, one bounded window per group."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import special


def per_group(df: DataFrame, keys: list[str], columns: list[str], kernel, schema: str, by: str = "idx") -> DataFrame:
    """Applies ``kernel(*arrays) -> dict or None`` to each group's columns in order of ``by``; None gives no row. A null is a
    NaN in the arrays: every kernel says what it does with one. Groups travel as rows of arrays, many to an Arrow batch."""
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(f"{schema}, _row boolean")
    def run(*series: pd.Series) -> pd.DataFrame:
        found = [kernel(*(np.array(v, float) for v in arrays)) for arrays in zip(*series)]
        return pd.DataFrame([{**(f or {}), "_row": f is not None} for f in found], columns=[*names, "_row"])

    values = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("_at"), *values))).alias("_v"))
    found = rows.select(*keys, run(*[F.col(f"_v._{i}") for i in range(len(columns))]).alias("_f"))
    return found.filter("_f._row").select(*keys, *[F.col(f"_f.{n}").alias(n) for n in names])


def phrases(bits: np.ndarray) -> int:
    """Lempel and Ziv's count of phrases (1976): each the shortest string that does not begin earlier, overlaps allowed.

    A suffix automaton of what stands before the phrase's last sign is walked along with it, so the time is linear.
    """
    follow, link, length = [[-1, -1]], [-1], [0]
    last = 0

    def extend(c: int) -> None:
        nonlocal last
        now = len(length)
        follow.append([-1, -1])
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and follow[p][c] < 0:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(length)
                follow.append(follow[q][:])
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p][c] == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now

    count, state, size = 0, 0, 0
    for c in bits.tolist():
        state, size = follow[state][c], size + 1  # does the phrase so far, with this sign, begin earlier?
        extend(c)
        if state < 0:
            count, state, size = count + 1, 0, 0
        while length[link[state]] >= size > 0:  # its shorter strings have a state of their own now
            state = link[state]
    return count + (size > 0)


def lempel_ziv(x: np.ndarray) -> dict:
    """Number of phrases of the median-split series, times log2 n / n. Missing values are left out."""
    (x,) = complete(x)
    n = len(x)
    return {"lzc": phrases((x > np.median(x)).astype(int)) * math.log2(n) / n if n > 1 else None}


def svd_entropy(gram: DataFrame, keys: list[str]) -> DataFrame:
    """From the six sums of a delay embedding's Gram matrix: entropy of its singular values, 0 to 1; null where one is missing."""

    @F.pandas_udf("double")
    def entropy(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        m = np.array([[a, b, c], [b, d, e], [c, e, f]], float).transpose(2, 0, 1)
        some = np.isfinite(m).all((1, 2))
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(np.where(some[:, None, None], m, 0.0)), 0))
        q = s / np.maximum(s.sum(1, keepdims=True), 1e-300)
        return pd.Series(-(q * np.log2(np.maximum(q, 1e-300))).sum(1) / math.log2(3)).where(some, None)

    return gram.select(*keys, entropy("g00", "g01", "g02", "g11", "g12", "g22").alias("entropy"))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def complete(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places at which every column has a finite value."""
    some = np.logical_and.reduce([np.isfinite(c) for c in columns])
    return tuple(c[some] for c in columns)


def gaps_filled(x: np.ndarray) -> np.ndarray:
    """Linear over inner gaps, the nearest value at the edges; nothing where no value is finite."""
    some = np.isfinite(x)
    if some.all():
        return x
    return np.interp(np.arange(len(x)), np.flatnonzero(some), x[some]) if some.any() else x[:0]


def scaled(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / (x.std() + 1e-12)


def phi_id(covariances: DataFrame, keys: list[str]) -> DataFrame:
    """Sixteen atoms of integrated information decomposition of a Gaussian pair, by least mutual information, and their sums:
    transfer (what lands on one side from all that holds the other), storage (what stays what it is), synergy and the total.

    Input: covariances of a, b (now) and c, d (later). Names: what the past holds, ``_to_``, what the future holds; r
    redundant, x and y unique, s synergistic.
    """
    names = [f"{p}_to_{q}" for p in "rxys" for q in "rxys"]
    step = np.array([[1, 0, 0, 0], [-1, 1, 0, 0], [-1, 0, 1, 0], [1, -1, -1, 1]], float)  # inverse of r <= x, y <= s

    sums = {f"transfer_{p}_to_{q}": [f"{v}_to_{q}" for v in ("r", p, "s")] for p, q in ("xy", "yx")}
    sums |= {"storage": [f"{v}_to_{v}" for v in "rxys"], "synergy": ["s_to_s"], "total": names}

    @F.pandas_udf(", ".join(f"{n} double" for n in [*names, *sums]))
    def atoms(frame: pd.DataFrame) -> pd.DataFrame:
        c = np.empty((len(frame), 4, 4))
        for (i, p), (j, q) in ((a, b) for a in enumerate("abcd") for b in enumerate("abcd") if b[0] >= a[0]):
            c[:, i, j] = c[:, j, i] = frame[f"c_{p}{q}"]

        def mi(past: list[int], future: list[int]) -> np.ndarray:
            det = [np.maximum(np.linalg.det(c[np.ix_(range(len(c)), s, s)]), 1e-300) for s in (past, future, past + future)]
            return 0.5 * np.log(det[0] * det[1] / det[2])

        own = {(i, j): mi(p, q) for i, p in enumerate(([0], [1], [0, 1])) for j, q in enumerate(([2], [3], [2, 3]))}
        table = np.empty((len(c), 4, 4))
        for i, past in enumerate(((0, 1), (0,), (1,), (2,))):
            for j, future in enumerate(((0, 1), (0,), (1,), (2,))):
                table[:, i, j] = np.min([own[p, q] for p in past for q in future], axis=0)
        out = pd.DataFrame((step @ table @ step.T).reshape(len(c), 16), columns=names)
        return out.assign(**{name: out[parts].sum(axis=1) for name, parts in sums.items()})

    inputs = F.struct(*[f"c_{p}{q}" for i, p in enumerate("abcd") for q in "abcd"[i:]])
    return covariances.select(*keys, atoms(inputs).alias("_a")).select(*keys, "_a.*")


def seeded(*parts) -> np.random.Generator:
    """A generator from a hash of its keys: the same on every executor and run."""
    return np.random.default_rng(int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:16], 16))


def phase_shuffled(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random phases at every frequency but zero and Nyquist; the power spectrum stays. Gaps are filled first; a series without
    a value stays as it is."""
    if not len(filled := gaps_filled(x)):
        return x
    s = np.fft.rfft(filled)
    inner = slice(1, -1 if len(x) % 2 == 0 else None)
    s[inner] = np.abs(s[inner]) * np.exp(1j * rng.uniform(0, 2 * math.pi, len(s[inner])))
    return np.fft.irfft(s, len(x))


def phase_surrogates(pairs: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """keys, surrogate, idx, x, y with y phase-shuffled; surrogate 0 is the original. A pair is gathered once."""

    @F.pandas_udf("array<double>")
    def shuffled(values: pd.Series, names: pd.Series, surrogate: pd.Series) -> pd.Series:
        return pd.Series([phase_shuffled(np.array(v, float), seeded(*k, s)) if s else np.array(v, float) for v, k, s in zip(values, names, surrogate)])

    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_v"))
    each = rows.select(*keys, "_v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("surrogate"))
    moved = each.select(*keys, "surrogate", "_v", shuffled(F.col("_v.y"), F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), "surrogate").alias("_y"))
    back = moved.select(*keys, "surrogate", F.explode(F.arrays_zip("_v", "_y")).alias("_r"))
    return back.select(*keys, "surrogate", F.col("_r._v.idx").alias("idx"), F.col("_r._v.x").alias("x"), F.when(~F.isnan("_r._y"), F.col("_r._y")).alias("y"))


def modes(gram: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """keys, mode, energy (share), from products of centred frames (i <= j): the small eigenproblem of one window."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        size = int(frame["j"].max()) + 1
        g = np.zeros((size, size))
        g[frame["i"], frame["j"]] = g[frame["j"], frame["i"]] = frame["g"]
        e = np.maximum(np.linalg.eigvalsh(g)[::-1], 0)
        k = min(n, size)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * k for c in keys}, "mode": np.arange(1, k + 1), "energy": e[:k] / max(e.sum(), 1e-300)})

    return gram.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {dict(gram.dtypes)[k]}" for k in keys), "mode long, energy double"]))
