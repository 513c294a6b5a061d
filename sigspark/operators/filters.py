"""Filters, rate conversion and envelopes: small numpy kernels over bounded chunks of a series.

Chunks carry a halo of neighbouring samples, so a long series is filtered in parallel and only its real ends are padded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shared import cut_lineage
from .kernels import gaps_filled
from .models import on_keys
from .series import KEYS, filled, max_abs_scaled, ordered, unpivot_prefix, whole, zscore


def butter_power(cut: float | tuple[float, float], fs: float, kind: str, order: int, f: np.ndarray) -> np.ndarray:
    """|H|^2 of a digital Butterworth filter (bilinear transform) at frequencies f; forwards and backwards that is the gain."""
    edges = (cut,) if np.isscalar(cut) else tuple(cut)
    if not all(0 < c < fs / 2 for c in edges) or list(edges) != sorted(set(edges)) or len(edges) != (2 if kind == "bandpass" else 1):
        raise ValueError(f"cutoff {cut} does not fit kind {kind} and rate {fs}")
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        w, c = np.tan(math.pi * np.minimum(f, fs / 2 * (1 - 1e-12)) / fs), [math.tan(math.pi * e / fs) for e in edges]
        if kind == "lowpass":
            x = w / c[0]
        elif kind == "highpass":
            x = c[0] / w
        else:
            x = (w * w - c[0] * c[1]) / (w * (c[1] - c[0]))
        gain = 1 / (1 + x ** (2 * order))
    return np.nan_to_num(gain)


def zero_phase(x: np.ndarray, cut, fs: float, kind: str, order: int) -> np.ndarray:
    """Forward-backward Butterworth of a whole array, with odd extension at both ends."""
    pad = min(len(x) - 1, int(3 * order * fs / min(np.atleast_1d(cut))))
    if pad > 0:
        x_long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    else:
        x_long = x
    f = np.fft.rfftfreq(len(x_long), 1 / fs)
    return np.fft.irfft(np.fft.rfft(x_long) * butter_power(cut, fs, kind, order, f), len(x_long))[pad : pad + len(x)]


def butter_sections(cut: float | tuple[float, float], fs: float, kind: str, order: int) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a digital Butterworth filter, by the bilinear transform. A cutoff
    outside 0 to fs / 2, or of the wrong number for the kind, is an error."""
    edges = (cut,) if np.isscalar(cut) else tuple(cut)
    if kind not in ("lowpass", "highpass", "bandpass") or not all(0 < c < fs / 2 for c in edges) or list(edges) != sorted(set(edges)) or len(edges) != (2 if kind == "bandpass" else 1):
        raise ValueError(f"cutoff {cut} does not fit kind {kind} and rate {fs}")
    warped = [2 * fs * math.tan(math.pi * c / fs) for c in edges]
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros = poles * warped[0], []
    elif kind == "highpass":
        poles, zeros = warped[0] / poles, [1.0] * order
    else:
        width, centre = warped[1] - warped[0], warped[0] * warped[1]
        half = poles * width / 2
        root = np.sqrt(half * half - centre)
        poles, zeros = np.concatenate([half + root, half - root]), [1.0] * order
    digital = (2 * fs + poles) / (2 * fs - poles)
    zeros = np.array([*zeros, *[-1.0] * (len(digital) - len(zeros))])
    upper = digital[digital.imag > 1e-12]
    pairs = [(p, p.conj()) for p in upper[np.argsort(np.abs(upper))]]
    alone = np.sort(digital[np.abs(digital.imag) <= 1e-12].real)
    pairs += [tuple(alone[k : k + 2]) for k in range(0, len(alone), 2)]
    plus, minus = int((zeros > 0).sum()), int((zeros < 0).sum())
    sections = []
    for pair in pairs:
        own = []
        for _ in pair:  # bands get one zero of each kind in every section
            take_plus = plus > 0 and (plus >= minus if not own else own[0] < 0 or minus == 0)
            own.append(1.0 if take_plus else -1.0)
            plus, minus = plus - take_plus, minus - (not take_plus)
        top, bottom = np.poly(own), np.real(np.poly(pair))
        sections.append([*np.pad(top, (0, 3 - len(top))), *np.pad(bottom, (0, 3 - len(bottom)))])
    sections = np.array(sections)
    # Gain 1 where the filter passes: at 0, at half the rate, or at the warped centre of the band.
    w = {"lowpass": 0.0, "highpass": math.pi, "bandpass": 2 * math.atan(math.sqrt(np.prod(warped)) / (2 * fs))}[kind]
    z = np.exp(-1j * w * np.arange(3))
    gain = np.abs(np.prod((sections[:, :3] @ z) / (sections[:, 3:] @ z)))
    sections[0, :3] /= gain
    return sections


class Cascade:
    """Sections as one linear system s' = A s + b u, y = c s + d u, applied block by block: a block is one product with the
    impulse response, and only states pass from block to block."""

    SIZE = 64

    def __init__(self, sections: np.ndarray):
        self.sections, n = sections, 2 * len(sections)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):  # direct form II, transposed; its input is what came before
            at = slice(2 * k, 2 * k + 2)
            into = np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[at, : 2 * k] = np.outer(into, c[: 2 * k])
            a[at, at] = [[-a1, 1.0], [-a2, 0.0]]
            b[at] = into * d
            c, d = b0 * c, b0 * d
            c[2 * k] = 1.0
        self.a, self.b, self.c, self.d = a, b, c, d
        self.steady = np.linalg.solve(np.eye(n) - a, b)  # the state under a constant 1
        size = self.SIZE
        powers = [np.eye(n)]
        for _ in range(size):
            powers.append(a @ powers[-1])
        response = np.array([d, *(c @ p @ b for p in powers[: size - 1])])
        self.inside = np.array([[response[i - j] if i >= j else 0.0 for j in range(size)] for i in range(size)])
        self.seen = np.array([c @ p for p in powers[:size]])
        self.into = np.array([powers[size - 1 - j] @ b for j in range(size)])
        self.over = powers[size]
        self.made: dict[int, tuple] = {}

    def maps(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``size`` samples make of the state before them: the state after, the last output, and the state of a backward pass
        over the output."""
        if size not in self.made:
            n = len(self.b)
            y, state = self.run(np.zeros((size, n)), np.eye(n))
            self.made[size] = state, y[-1], self.run(y[::-1], np.zeros((n, n)))[1]
        return self.made[size]

    def run(self, u: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state; ``u`` may have several columns, with a state each."""
        u = u.reshape(len(u), -1)
        state, out = np.array(state, float).reshape(len(self.b), -1), np.empty(u.shape)
        whole = len(u) // self.SIZE * self.SIZE
        for k in range(0, whole, self.SIZE):
            part = u[k : k + self.SIZE]
            out[k : k + self.SIZE] = self.inside @ part + self.seen @ state
            state = self.over @ state + self.into.T @ part
        rest = u[whole:]
        if m := len(rest):
            out[whole:] = self.inside[:m, :m] @ rest + self.seen[:m] @ state
            state = np.linalg.matrix_power(self.a, m) @ state + self.into[self.SIZE - m :].T @ rest
        return out, state


def forward_backward(x: np.ndarray, sections: np.ndarray, pad: int) -> np.ndarray:
    """A whole array forwards and backwards, with ``pad`` samples of odd extension at either end."""
    system, pad = Cascade(sections), min(pad, len(x) - 1)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    y = system.run(long, system.steady * long[0])[0]
    return system.run(y[::-1], system.steady * y[-1, 0])[0][::-1, 0][pad : pad + len(x)]


def padding(sections: np.ndarray) -> int:
    """Samples of extension that a filter of these sections asks for."""
    return 3 * (2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum()))


def chunked(df: DataFrame, size: int, halo: int, keys: list[str]) -> DataFrame:
    """Every sample in its chunk, and in each neighbouring chunk whose halo it lies in."""
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - halo) / size)).cast("long")
    last = F.floor((F.col("idx") + halo) / size).cast("long")
    end = F.floor(F.max("idx").over(whole(keys)) / size).cast("long")
    return df.withColumn("_last", F.least(last, end)).withColumn("chunk", F.explode(F.sequence(first, "_last"))).drop("_last")


@lru_cache(maxsize=512)
def _system(low: float | None, high: float | None, fs: float, order: int) -> Cascade:
    """The filter that passes what lies between the two: without a lower edge a low-pass, without an upper one a high-pass."""
    cut = (low, high) if low is not None and high is not None else high if low is None else low
    return Cascade(butter_sections(cut, fs, "bandpass" if low is not None and high is not None else "lowpass" if low is None else "highpass", order))


def _edge(v) -> float | None:
    return None if v is None or v != v else float(v)


def _extended(df: DataFrame, pad: Column, keys: list[str]) -> DataFrame:
    """keys, idx, x, own: every series with its odd extension as rows before its first and after its last sample. A sample near
    an end gives its mirror image along with itself."""
    ends = df.groupBy(*keys).agg(F.min("idx").alias("_i"), F.max("idx").alias("_j"), F.min_by("x", "idx").alias("_a"), F.max_by("x", "idx").alias("_b"))
    near = on_keys(df, ends, keys).withColumn("_pad", F.least(pad, F.col("_j") - F.col("_i")))

    def image(end: str, value: str) -> Column:
        return F.struct((2 * F.col(end) - F.col("idx")).alias("idx"), (2 * F.col(value) - F.col("x")).alias("x"), F.lit(False).alias("own"))

    before = F.when((F.col("idx") > F.col("_i")) & (F.col("idx") <= F.col("_i") + F.col("_pad")), image("_i", "_a"))
    after = F.when((F.col("idx") < F.col("_j")) & (F.col("idx") >= F.col("_j") - F.col("_pad")), image("_j", "_b"))
    itself = F.struct("idx", "x", F.lit(True).alias("own"))
    return near.select(*keys, F.explode(F.array_compact(F.array(itself, before, after))).alias("_r")).select(*keys, "_r.*")


def _summaries(fs: float, order: int):
    """Of each chunk what a scan needs: its length, its last forward state from 0, its first sample, its last forward output
    from 0, and its backward state from 0 over that output."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for v, low, high in zip(frame["_v"], frame["_low"], frame["_high"]):
                system, x = _system(_edge(low), _edge(high), fs, order), np.asarray(v, float)
                zero = np.zeros(len(system.b))
                y, state = system.run(x, zero)
                back = system.run(y[::-1], zero)[1]
                rows.append((len(x), x[0], state[:, 0], y[-1, 0], back[:, 0]))
            out = frame.drop(columns="_v")
            for k, name in enumerate(("size", "first", "forward", "last", "backward")):
                out[name] = [r[k] for r in rows]
            yield out

    return run


def _scan(fs: float, order: int):
    """The states with which every chunk of a series begins, forwards and backwards: affine maps of its summaries, composed in
    order. A row is a series, an entry of its list a chunk."""

    def states(chunks: list, low, high) -> list[dict]:
        system = _system(_edge(low), _edge(high), fs, order)
        state, forward, lasts, backs = system.steady * chunks[0]["first"], [], [], []
        for c in chunks:
            over, seen, behind = system.maps(int(c["size"]))
            forward.append(state)
            lasts.append(c["last"] + seen @ state)
            backs.append(np.asarray(c["backward"]) + behind @ state)
            state = over @ state + np.asarray(c["forward"])
        state, backward = system.steady * lasts[-1], []
        for c, back in zip(chunks[::-1], backs[::-1]):
            backward.append(state)
            state = system.maps(int(c["size"]))[0] @ state + back
        n = int(sum(c["size"] for c in chunks))
        return [{"chunk": c["chunk"], "f": f, "b": b, "n": n} for c, f, b in zip(chunks, forward, backward[::-1])]

    @F.pandas_udf("array<struct<chunk:long,f:array<double>,b:array<double>,n:long>>")
    def run(chunks: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([states(list(c), a, b) for c, a, b in zip(chunks, low, high)])

    return run


def filtered_by(df: DataFrame, fs: float, low: Column, high: Column, order: int = 4, keys: list[str] = KEYS, chunk: int = 1 << 14, x: str = "x") -> DataFrame:
    """keys, idx, x: as ``filtered``, but the band of a series is data: ``low`` and ``high`` are columns, the same in all rows of
    a series, and one plan filters every series with its own band. A null low is a low-pass, a null high a high-pass; series
    whose edges are not inside 0 to fs / 2 in that order, or both null, become null."""
    own = [*keys, "_low", "_high"]
    rows = df.select(*keys, "idx", F.col(x).cast("double").alias("x"), low.cast("double").alias("_low"), high.cast("double").alias("_high"))
    fits = (F.coalesce(F.col("_low"), F.lit(fs / 4)) > 0) & (F.coalesce(F.col("_high"), F.lit(fs / 4)) < fs / 2) & (F.coalesce(F.col("_low"), F.lit(0.0)) < F.coalesce(F.col("_high"), F.lit(fs / 2))) & (F.col("_low").isNotNull() | F.col("_high").isNotNull())
    rows = filled(rows.withColumn("x", F.when(fits, F.col("x"))), own)
    pads = [padding(_system(a, b, 4.0, order).sections) for a, b in ((0.5, 1.0), (None, 1.0))]
    pad = F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), pads[0]).otherwise(pads[1])
    known = _extended(rows.filter("x IS NOT NULL"), pad, own)
    chunks = known.groupBy(*own, F.floor(F.col("idx") / chunk).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("idx", "x", "own"))).alias("_s"))
    own_schema = [*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), "_low double, _high double"]
    summary = ", ".join([*own_schema, "chunk long, size long, first double, forward array<double>, last double, backward array<double>"])
    states = chunks.select(*own, "chunk", F.col("_s.x").alias("_v")).mapInPandas(_summaries(fs, order), summary)
    states = states.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("chunk", "size", "first", "forward", "last", "backward"))).alias("_c"))
    states = states.select(*own, F.explode(_scan(fs, order)("_c", "_low", "_high")).alias("_s")).select(*own, F.col("_s.chunk").alias("chunk"), F.col("_s.f").alias("_f"), F.col("_s.b").alias("_b"), F.col("_s.n").alias("_n"))

    @F.pandas_udf("array<double>")
    def both_ways(values: pd.Series, lows: pd.Series, highs: pd.Series, forward: pd.Series, backward: pd.Series) -> pd.Series:
        out = []
        for v, a, b, f, g in zip(values, lows, highs, forward, backward):
            system = _system(_edge(a), _edge(b), fs, order)
            y = system.run(np.asarray(v, float), np.asarray(f))[0]
            out.append(system.run(y[::-1], np.asarray(g))[0][::-1, 0])
        return pd.Series(out)

    done = on_keys(chunks, states, [*own, "chunk"]).select(*keys, "_n", "_s", both_ways(F.col("_s.x"), "_low", "_high", "_f", "_b").alias("_y"))
    done = done.select(*keys, "_n", F.explode(F.arrays_zip("_s", "_y")).alias("_r")).filter("_r._s.own")
    value = F.when(F.col("_n") > 1, F.col("_r._y")).otherwise(F.col("_r._s.x"))
    return done.select(*keys, F.col("_r._s.idx").alias("idx"), value.alias("x")).unionByName(rows.filter("x IS NULL").select(*keys, "idx", "x"))


def filtered(df: DataFrame, cut, fs: float, kind: str = "bandpass", order: int = 4, keys: list[str] = KEYS, chunk: int = 1 << 14, x: str = "x") -> DataFrame:
    """keys, idx, x: zero-phase Butterworth, second-order sections forwards and backwards over an odd extension of each end.

    Chunks of ``chunk`` samples are filtered in parallel and exactly: a first pass takes from each what its end state depends
    on, a scan over those rows gives every chunk the states it begins with, and a second pass filters. The result does not
    depend on the chunk size. Missing values are filled first; an all-null series stays null, one sample stays as it is.
    """
    butter_sections(cut, fs, kind, order)  # raises if they do not fit
    low, high = cut if kind == "bandpass" else (None, cut) if kind == "lowpass" else (cut, None)
    return filtered_by(df, fs, F.lit(low), F.lit(high), order, keys, chunk, x)


def _taps(up: int, down: int) -> np.ndarray:
    half = 10 * max(up, down)
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / max(up, down)) / max(up, down) * np.kaiser(2 * half + 1, 5.0)
    return taps * (up / taps.sum())


def polyphase(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """A whole array at rate times up / down: zeros between samples, a Kaiser-windowed low-pass, every down-th sample."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.copy()
    taps = _taps(up, down)
    half = len(taps) // 2
    long = np.zeros(len(x) * up)
    long[::up] = x
    return np.convolve(long, taps)[half : half + len(long)][::down][: -(-len(x) * up // down)]


def resampled_poly(df: DataFrame, fs_from: int, fs_to: int, keys: list[str] = KEYS, chunk: int = 1 << 14) -> DataFrame:
    """keys, idx, x at the new rate: as many samples as begin inside the series. Zeros stand beyond its ends and for missing
    values.

    Chunks are whole numbers of the rates' common period, so the first output of each has a whole index; a chunk carries as
    many neighbouring samples as the filter reaches. The result does not depend on the chunk size.
    """
    g = math.gcd(fs_from, fs_to)
    up, down = fs_to // g, fs_from // g
    size = max(1, chunk // down) * down
    taps = _taps(up, down)
    half = len(taps) // 2
    halo = -(-half // up) + 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["chunk"].iloc[0]
        at, x = frame["idx"].to_numpy(np.int64), np.nan_to_num(frame["x"].to_numpy(float))
        begin, mine = own * size - halo, at[at // size == own]
        stuffed = np.zeros((size + 2 * halo) * up)
        stuffed[(at - begin) * up] = x
        first, end = own * size * up // down, -(-(int(mine.max()) + 1) * up // down)  # outputs before the chunk's last sample ends
        m = np.arange(first, end)
        places = m * down - begin * up
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(stuffed, half), len(taps))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(m) for k in keys}, "idx": m, "x": windows[places] @ taps[::-1]})

    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), "idx long, x double"])
    rows = df.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"))
    if up == down:
        return rows
    first, last = F.greatest(F.lit(0), F.floor((F.col("idx") - halo) / size)).cast("long"), F.floor((F.col("idx") + halo) / size).cast("long")
    placed = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    # A chunk of halo rows only lies beyond the end and has nothing to give.
    kept = placed.withColumn("_any", F.max((F.floor(F.col("idx") / size) == F.col("chunk")).cast("int")).over(whole([*keys, "chunk"]))).filter("_any = 1").drop("_any")
    return kept.groupBy(*keys, "chunk").applyInPandas(run, schema)


def analytic_signal(x: np.ndarray) -> np.ndarray:
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


def enveloped(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds envelope and phase of the analytic signal of every series, transformed as a whole. Gaps are filled first; an all-null
    series has none. For long recordings see ``envelopes``."""

    @F.pandas_udf("array<struct<envelope:double,phase:double>>")
    def transformed(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            x = gaps_filled(np.array(v, float))
            z = analytic_signal(x) if len(x) else np.full(len(v), np.nan)
            out.append([{"envelope": e, "phase": p} if e == e else None for e, p in zip(np.abs(z).tolist(), np.angle(z).tolist())])
        return pd.Series(out)

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x")))).alias("_s"))
    each = rows.select(*keys, F.explode(F.arrays_zip("_s", transformed(F.col("_s.x")).alias("_z"))).alias("_r"))
    return each.select(*keys, F.col("_r._s.idx").alias("idx"), F.col("_r._s.x").alias("x"), F.col("_r._z.envelope").alias("envelope"), F.col("_r._z.phase").alias("phase"))


def envelopes(df: DataFrame, lowest: float, fs: float, keys: list[str] = KEYS, chunk: int = 1 << 14) -> DataFrame:
    """keys, idx, x: the envelope of a signal without anything below ``lowest`` Hz. The quadrature is a Kaiser-windowed filter of
    four periods of that frequency to either side, so chunks need no more than these neighbours, and the result does not depend
    on the chunk size. Missing values count as zero, and so does what lies beyond the ends."""
    half = math.ceil(4 * fs / lowest)
    n = np.arange(-half, half + 1)
    taps = np.where(n % 2 == 1, 2 / (math.pi * np.where(n == 0, 1, n)), 0.0) * np.kaiser(2 * half + 1, 6.0)
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["chunk"].iloc[0]
        at, values = frame["idx"].to_numpy(np.int64) - (own * chunk - half), np.nan_to_num(frame["x"].to_numpy(float))
        x = np.zeros(chunk + 2 * half)
        x[at] = values
        size = 1 << (len(x) + len(taps) - 1).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[half : half + len(x)]
        mine = frame["idx"].to_numpy(np.int64) // chunk == own
        return frame.loc[mine, [*keys, "idx"]].assign(x=np.hypot(x, y)[at[mine]])

    rows = df.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("idx") - half) / chunk)).cast("long"), F.floor((F.col("idx") + half) / chunk).cast("long")
    placed = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    return placed.groupBy(*keys, "chunk").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "idx long, x double"]))


#: The twelve bands of an envelope (name, lower and upper edge in Hz or None, rate at which it is filtered).
ENVELOPE_BANDS = [
    ("env_broad", None, 60.0, 200), ("env_swell_0p2", None, 0.2, 50), ("env_swell_0p1", None, 0.1, 50), ("env_hrv_lf", 0.04, 0.15, 50), ("env_hrv_hf", 0.15, 0.4, 50), ("env_splash_1_5", 1.0, 5.0, 50),
    ("env_delta", 0.5, 4.0, 50), ("env_theta", 4.0, 8.0, 50), ("env_alpha", 8.0, 13.0, 50), ("env_beta_low", 13.0, 20.0, 200), ("env_beta_high", 20.0, 30.0, 200), ("env_gamma1", 30.0, 50.0, 200),
]


def envelope_bands(df: DataFrame, fs: int, sound_fs: int = 22050, out_fs: int = 256, high_pass: float = 20.0, broad: float = 60.0, bands: list[tuple[str, float | None, float | None, int]] = ENVELOPE_BANDS, keys: list[str] = KEYS, chunk: int = 1 << 14) -> DataFrame:
    """keys, band, idx, x: a sound's envelope in many bands, on one rate, log and min-max scaled.

    High-pass, rate change, envelope, low-pass; then at each band's own rate the band filter (all bands of a rate in one plan),
    absolute value, scale, and the common rate. Every step works on chunks of ``chunk`` samples, none on a whole recording, and
    the bands of one recording differ at most by a sample in length. What both rates start from is written once.
    """
    from .series import log_minmax

    sound = resampled_poly(filtered(df, high_pass, fs, "highpass", 2, keys, chunk), fs, sound_fs, keys, chunk)
    broadband = cut_lineage(filtered(envelopes(sound, high_pass, sound_fs, keys, chunk), broad, sound_fs, "lowpass", 4, keys, chunk))
    parts = []
    for rate in sorted({b[3] for b in bands}):
        mine = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")) for name, low, high, r in bands if r == rate])
        each = resampled_poly(broadband, sound_fs, rate, keys, chunk).withColumn("_s", F.explode(mine)).select(*keys, "idx", "x", "_s.*")
        banded = filtered_by(each, rate, F.col("low"), F.col("high"), 4, [*keys, "band"], chunk)
        scaled = log_minmax(banded.withColumn("x", F.abs("x")), [*keys, "band"], out="y").select(*keys, "band", "idx", F.col("y").alias("x"))
        parts.append(resampled_poly(scaled, rate, out_fs, [*keys, "band"], chunk))
    return reduce(DataFrame.unionByName, parts)


def filtered_table(wide: DataFrame, prefix: str, cut, fs: float, ids: list[str], idx: str, order: int = 4, kind: str = "bandpass") -> DataFrame:
    """A wide table of channels with every column of this prefix filtered; ``ids`` name a recording, ``idx`` the sample. Other
    columns stay as they are."""
    names = [c for c in wide.columns if c.startswith(prefix) and c not in ids and c != idx]
    long = unpivot_prefix(wide, [*ids, idx], prefix).withColumnRenamed(idx, "idx")
    done = filtered(long, cut, fs, kind, order, [*ids, "channel"]).groupBy(*ids, "idx").pivot("channel", names).agg(F.first("x"))
    rest = wide.select(*[c for c in wide.columns if c not in names])
    return on_keys(rest, done.withColumnRenamed("idx", idx), [*ids, idx]).select(*wide.columns)


def band_envelopes(df: DataFrame, bands: list[tuple[str, float, float]], fs: float, smooth: float, keys: list[str] = KEYS) -> DataFrame:
    """keys, band, idx, x: for every band, band-pass, envelope, low-pass at ``smooth``, log and min-max scale. One plan for all."""
    from .series import log_minmax

    edges = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for name, low, high in bands])
    by = [*keys, "band"]
    each = df.select(*keys, "idx", "x", F.explode(edges).alias("_e")).select(*keys, "idx", "x", "_e.*")
    e = enveloped(filtered_by(each, fs, F.col("low"), F.col("high"), keys=by), by)
    s = filtered(e.select(*by, "idx", F.col("envelope").alias("x")), smooth, fs, "lowpass", keys=by)
    return log_minmax(s, by, out="y").select(*by, "idx", F.col("y").alias("x"))


def clean_respiration(df: DataFrame, fs: float, keys: list[str] = KEYS) -> DataFrame:
    """Filled, centred and scaled, 0.05 to 1 Hz, standardised."""
    scaled = max_abs_scaled(filled(df, keys), keys, out="x")
    return zscore(filtered(scaled, (0.05, 1.0), fs, order=2, keys=keys), keys, out="x")


def find_peaks(df: DataFrame, half: int, factor: float, refractory: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, idx of local maxima above ``factor`` deviations over the mean of the samples around, none within ``refractory``
    samples of the one kept before it."""
    from .align import merged_triggers

    w = ordered(keys)
    around = w.rowsBetween(-half, half)
    top = (F.col("x") > F.lag("x").over(w)) & (F.col("x") >= F.lead("x").over(w)) & (F.col("x") > F.avg("x").over(around) + factor * F.stddev_pop("x").over(around))
    return merged_triggers(df.withColumn("_top", top).filter("_top").select(*keys, "idx"), refractory, keys)


def clean_ecg(df: DataFrame, fs: float, keys: list[str] = KEYS, mains: float = 50.0) -> DataFrame:
    """keys, idx, x: without what is slower than 0.5 Hz, then the mean over one period of the mains, which removes it."""
    high = filtered(df, 0.5, fs, "highpass", 5, keys)
    width = max(1, round(fs / mains))
    around = ordered(keys).rowsBetween(-((width - 1) // 2), width // 2)
    return high.select(*keys, "idx", F.avg("x").over(around).alias("x"))


def ecg_peaks(df: DataFrame, fs: float, keys: list[str] = KEYS, factor: float = 1.5, refractory_s: float = 0.3, around_s: float = 0.75) -> DataFrame:
    """keys, idx of the heart beats of a raw recording: cleaned, then peaks as ``find_peaks`` finds them."""
    return find_peaks(clean_ecg(df, fs, keys), max(1, round(around_s * fs)), factor, max(1, round(refractory_s * fs)), keys)
