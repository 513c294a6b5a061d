"""Spectra: samples of a bounded window are gathered once and transformed in Arrow batches; the rest is aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import ratio
from .series import KEYS, exploded_windows, ordered, whole

#: Numbers in one transform step.
_STEP = 1 << 18


def _gathered(df: DataFrame, keys: list[str], pos: str, values: tuple[str, ...]) -> DataFrame:
    """A row per group (a bounded window of samples): its places and values as one array."""
    columns = [F.col(pos).cast("long").alias("_p"), *[F.col(v).cast("double").alias(f"_{i}") for i, v in enumerate(values)]]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_v"))


def _matrices(batch: pa.RecordBatch, n: int, values: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Row number and place of every sample; per value a matrix of rows by places modulo n, and which rows have a value."""
    lists = batch.column("_v")
    flat = lists.flatten()
    rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    place = flat.field(0).to_numpy(zero_copy_only=False)
    matrices, filled = [], []
    for i in range(values):
        x = flat.field(i + 1).to_numpy(zero_copy_only=False)
        some = ~np.isnan(x)
        at = rows[some] * n + place[some] % n
        matrices.append(np.bincount(at, x[some], batch.num_rows * n).reshape(batch.num_rows, n))
        filled.append(np.bincount(rows[some], minlength=batch.num_rows) > 0)
    return rows, place, matrices, filled


def _by_group(df: DataFrame, n: int, keys: list[str], pos: str, values: tuple[str, ...], new: list[str], of: Callable) -> DataFrame:
    """Runs ``of`` over Arrow batches of gathered groups: it gives, for a batch, row numbers and the columns ``new``. What is
    shuffled are the samples, whatever the number of bins."""
    wanted = [f"`{k}` {dict(df.dtypes)[k]}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, max(1, _STEP // n)):
                part = batch.slice(first, max(1, _STEP // n))
                rows, columns = of(part, *_matrices(part, n, len(values)))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in keys), *columns], [*keys, *(c.split()[0].strip("`") for c in new)])

    return _gathered(df, keys, pos, values).mapInArrow(run, ", ".join([*wanted, *new]))


def dft(df: DataFrame, n: int, bins: range, keys: list[str], pos: str = "idx", values: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys, k and re_<v>, im_<v> for each value column, by a fast transform per group. Null samples count as zero; a group
    without any value has null sums."""

    def transformed(part: pa.RecordBatch, rows: np.ndarray, place: np.ndarray, matrices: list[np.ndarray], filled: list[np.ndarray]):
        k = np.array(bins)
        out = [pa.array(np.tile(k, part.num_rows))]
        for m, some in zip(matrices, filled):
            f = np.fft.fft(m, axis=1)[:, k % n]
            missing = np.repeat(~some, len(k))
            out += [pa.array(np.ascontiguousarray(x).ravel(), mask=missing) for x in (f.real, f.imag)]
        return np.repeat(np.arange(part.num_rows), len(k)), out

    return _by_group(df, n, keys, pos, values, ["k long", *[f"`{c}_{v}` double" for v in values for c in ("re", "im")]], transformed)


def tapered(df: DataFrame, n: int, step: int, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    """Overlapping segments without their mean, times a periodic Hann window. A segment's number is ``_segment``: ``keys``
    may hold windows of the caller's own."""
    w = exploded_windows(df, n, step, keys, name="_segment")
    hann = 0.5 - 0.5 * F.cos(F.col("pos") * (2 * math.pi / n))
    return w.withColumns({v: (F.col(v) - F.avg(v).over(whole([*keys, "_segment"]))) * hann for v in values})


def welch(df: DataFrame, n: int, step: int, fs: float, keys: list[str] = KEYS) -> DataFrame:
    """keys, k, f, p: the one-sided power density."""
    bins = dft(tapered(df, n, step, keys, ("x",)), n, range(0, n // 2 + 1), [*keys, "_segment"], "pos")
    twice = F.when((F.col("k") == 0) | (F.col("k") * 2 == n), 1.0).otherwise(2.0)
    p = twice * (F.col("re_x") * F.col("re_x") + F.col("im_x") * F.col("im_x")) / (fs * n * 3 / 8)
    return bins.withColumn("p", p).groupBy(*keys, "k").agg(F.avg("p").alias("p")).withColumn("f", F.col("k") * (fs / n))


def band_powers(spectrum: DataFrame, bands: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, band, power, relative: trapezoids inside [low, high]. ``bands``: band, low, high, a small dimension table."""
    w = ordered(keys, "k")
    area = (F.lead("f").over(w) - F.col("f")) * (F.lead("p").over(w) + F.col("p")) / 2
    steps = spectrum.withColumns({"_area": area, "_next": F.lead("f").over(w)})
    totals = steps.withColumn("_total", F.sum("_area").over(whole(keys)))
    inside = totals.join(bands, (F.col("f") >= F.col("low")) & (F.col("_next") <= F.col("high")))
    return inside.groupBy(*keys, "band").agg(F.sum("_area").alias("power"), F.max("_total").alias("_t")).withColumn("relative", ratio("power", "_t")).drop("_t")


def peak_frequency(spectrum: DataFrame, low: float, high: float, keys: list[str] = KEYS) -> DataFrame:
    best = spectrum.filter(F.col("f").between(low, high)).groupBy(*keys).agg(F.max_by(F.struct("f", "p"), F.struct(F.round("p", 12), -F.col("k"))).alias("_b"))
    return best.select(*keys, F.col("_b.f").alias("peak_f"), F.col("_b.p").alias("peak_p"))


def spectral_entropy(spectrum: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Entropy of the power distribution over frequencies, over its largest possible value."""
    share = spectrum.withColumn("_q", ratio("p", F.sum("p").over(whole(keys))))
    return share.groupBy(*keys).agg((-F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.log2("_q")).otherwise(0.0)) / F.log2(F.count("*").cast("double"))).alias("entropy"))


def group_spectrum(spectrum: DataFrame, group: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Area-normalised spectra per group: mean, standard error, median and quartiles at each frequency."""
    area = spectrum.withColumn("_q", ratio("p", F.sum("p").over(whole(keys))))
    quarters = F.percentile("_q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = area.groupBy(*group, "k").agg(F.avg("_q").alias("mean"), (F.stddev_samp("_q") / F.sqrt(F.count("_q"))).alias("sem"), quarters.alias("_r"))
    return g.select(*group, "k", "mean", "sem", F.col("_r")[0].alias("q25"), F.col("_r")[1].alias("median"), F.col("_r")[2].alias("q75"))


def aperiodic(spectrum: DataFrame, low: float, high: float, keys: list[str] = KEYS) -> DataFrame:
    """offset, exponent, r2, error, n_peaks: a line through log p over log f, refitted on the lower residuals, then peaks
    as local maxima of what stands more than two errors above the line."""
    w = whole(keys)
    logs = spectrum.filter(F.col("f").between(low, high) & (F.col("p") > 0)).withColumns({"lf": F.log10("f"), "lp": F.log10("p")})
    first = logs.withColumn("_r", F.col("lp") - (F.regr_slope("lp", "lf").over(w) * F.col("lf") + F.regr_intercept("lp", "lf").over(w)))
    cut = first.groupBy(*keys).agg(F.percentile("_r", 0.75).alias("_cut"))
    kept = first.join(cut, keys).withColumn("_use", F.col("_r") <= F.col("_cut") + 1e-9)
    y, x = F.when(F.col("_use"), F.col("lp")), F.when(F.col("_use"), F.col("lf"))
    fit = kept.withColumns({"_s": F.regr_slope(y, x).over(w), "_b": F.regr_intercept(y, x).over(w), "_r2": F.regr_r2(y, x).over(w)})
    rest = fit.withColumn("_e", F.col("lp") - (F.col("_s") * F.col("lf") + F.col("_b"))).withColumn("_sd", F.sqrt(F.avg(F.col("_e") * F.col("_e")).over(w)))
    line = ordered(keys, "k")
    e = F.round("_e", 9)
    top = (e > F.coalesce(F.lag(e).over(line), e - 1)) & (e > F.coalesce(F.lead(e).over(line), e - 1)) & (F.col("_e") > 2 * F.col("_sd"))
    return rest.withColumn("_top", top).groupBy(*keys).agg(F.max("_b").alias("offset"), (-F.max("_s")).alias("exponent"), F.max("_r2").alias("r2"), F.max("_sd").alias("error"), F.count_if("_top").alias("n_peaks"))


def top_frequencies(spectrum: DataFrame, n: int, group: list[str]) -> DataFrame:
    """The n strongest frequencies of each group's mean spectrum."""
    mean = spectrum.groupBy(*group, "k", "f").agg(F.avg("p").alias("p"))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.round("p", 12)), "k"))
    return mean.withColumn("place", place.cast("long")).filter(F.col("place") <= n)


def coherence(pairs: DataFrame, n: int, step: int, fs: float, keys: list[str]) -> DataFrame:
    """keys, k, f, c: magnitude-squared coherence of x and y over the segments."""
    b = dft(tapered(pairs, n, step, keys, ("x", "y")), n, range(0, n // 2 + 1), [*keys, "_segment"], "pos", ("x", "y"))
    re = F.col("re_x") * F.col("re_y") + F.col("im_x") * F.col("im_y")
    im = F.col("im_x") * F.col("re_y") - F.col("re_x") * F.col("im_y")
    s = b.groupBy(*keys, "k").agg(F.avg(re).alias("_re"), F.avg(im).alias("_im"), F.avg(F.col("re_x") ** 2 + F.col("im_x") ** 2).alias("_xx"), F.avg(F.col("re_y") ** 2 + F.col("im_y") ** 2).alias("_yy"))
    return s.select(*keys, "k", (F.col("k") * (fs / n)).alias("f"), ratio(F.col("_re") ** 2 + F.col("_im") ** 2, F.col("_xx") * F.col("_yy")).alias("c"))


def band_coherence(spectrum: DataFrame, low: float, high: float, keys: list[str]) -> DataFrame:
    """Mean and peak coherence in a band."""
    inside = spectrum.filter(F.col("f").between(low, high)).groupBy(*keys).agg(F.avg("c").alias("mean"), F.max_by(F.struct("f", "c"), F.struct(F.round("c", 9), -F.col("k"))).alias("_b"))
    return inside.select(*keys, "mean", F.col("_b.c").alias("peak"), F.col("_b.f").alias("peak_f"))


def coherence_table(spectrum: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, mean, peak, peak_f: coherence of every key in every band. ``bands``: band, low, high, a small dimension table."""
    inside = spectrum.join(bands, F.col("f").between(F.col("low"), F.col("high")))
    g = inside.groupBy(*keys, "band").agg(F.avg("c").alias("mean"), F.max_by(F.struct("f", "c"), F.struct(F.round("c", 9), -F.col("k"))).alias("_b"))
    return g.select(*keys, "band", "mean", F.col("_b.c").alias("peak"), F.col("_b.f").alias("peak_f"))


def segment_length(samples: int, fs: float, low: float, high: float, least_bins: int = 4) -> int | None:
    """The shortest power of two, at most half the samples, that puts ``least_bins`` frequencies in the band."""
    n = 8
    while n <= samples // 2:
        if math.floor(high * n / fs) - math.ceil(low * n / fs) + 1 >= least_bins:
            return n
        n *= 2
    return None


def analytic(df: DataFrame, n: int, bins: range, keys: list[str], values: tuple[str, ...] = ("x",), pos: str = "idx") -> DataFrame:
    """keys, pos and a_<v>, b_<v>: the analytic signal of the band, by inverse transform of its positive bins alone."""

    def inverted(part: pa.RecordBatch, rows: np.ndarray, place: np.ndarray, matrices: list[np.ndarray], filled: list[np.ndarray]):
        out = [pa.array(place)]
        k = np.array(bins) % n
        for m, some in zip(matrices, filled):
            band = np.zeros(m.shape, complex)
            band[:, k] = np.fft.fft(m, axis=1)[:, k]
            z = 2 * np.fft.ifft(band, axis=1)[rows, place % n]
            out += [pa.array(np.ascontiguousarray(x), mask=~some[rows]) for x in (z.real, z.imag)]
        return rows, out

    return _by_group(df, n, keys, pos, values, [f"`{pos}` long", *[f"`{c}_{v}` double" for v in values for c in ("a", "b")]], inverted)


def phase_coupling(signal: DataFrame, keys: list[str]) -> DataFrame:
    """plv, mean_phase, pli_sin (the sine ratio), wpli (by cross-spectrum) of analytic x and y. Phase is x's minus y's."""
    re = F.col("a_x") * F.col("a_y") + F.col("b_x") * F.col("b_y")
    im = F.col("b_x") * F.col("a_y") - F.col("a_x") * F.col("b_y")
    s = signal.withColumns({"_im": im, "_d": F.atan2(im, re)}).withColumns({"_c": F.cos("_d"), "_s": F.sin("_d")})
    g = s.groupBy(*keys).agg(F.avg("_c").alias("_c"), F.avg("_s").alias("_s"), F.avg(F.abs("_s")).alias("_as"), F.avg("_im").alias("_im"), F.avg(F.abs("_im")).alias("_ai"))
    return g.select(*keys, F.hypot("_c", "_s").alias("plv"), F.atan2("_s", "_c").alias("mean_phase"), (F.abs("_s") / (F.col("_as") + 1e-12)).alias("pli_sin"), (F.abs("_im") / (F.col("_ai") + 1e-12)).alias("wpli"))


def phase_amplitude(phases: DataFrame, keys: list[str], bins: int = 18) -> DataFrame:
    """mi (entropy of amplitude over phase bins, 0 to 1), mvl, mvl_norm, preferred_phase of columns phase and amp."""
    p = phases.withColumn("_bin", F.least(F.floor((F.col("phase") + math.pi) / (2 * math.pi / bins)), F.lit(bins - 1)).cast("long"))
    means = p.groupBy(*keys, "_bin").agg(F.avg("amp").alias("_m"))
    share = means.withColumn("_q", ratio("_m", F.sum("_m").over(whole(keys))))
    tort = share.groupBy(*keys).agg((1.0 + F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.ln("_q")).otherwise(0.0)) / math.log(bins)).alias("mi"))
    c = p.groupBy(*keys).agg(F.avg(F.col("amp") * F.cos("phase")).alias("_c"), F.avg(F.col("amp") * F.sin("phase")).alias("_s"), F.avg("amp").alias("_a"))
    return tort.join(c, keys).select(*keys, "mi", F.hypot("_c", "_s").alias("mvl"), ratio(F.hypot("_c", "_s"), "_a").alias("mvl_norm"), F.atan2("_s", "_c").alias("preferred_phase"))


def dominant_band(pairs: DataFrame, n: int, fs: float, keys: list[str], width: float = 0.12, search: tuple[float, float] = (0.05, 0.5), pos: str = "idx") -> DataFrame:
    """keys, f0, low, high: the strongest frequency of y between the two of ``search``, and a band of ``width`` around it. The
    spectrum has segments of ``n`` samples; where no frequency of them lies in the range f0 is its middle."""
    rows = pairs.select(*keys, F.col(pos).alias("idx"), F.col("y").alias("x"))
    top = peak_frequency(welch(rows, n, max(1, n // 2), fs, keys), *search, keys)
    f0 = F.coalesce("peak_f", F.lit(sum(search) / 2))
    return rows.select(*keys).distinct().join(top, keys, "left").select(*keys, f0.alias("f0"), F.greatest(F.lit(1e-3), f0 - width / 2).alias("low"), F.greatest(f0 + width / 2, f0 + 1e-3).alias("high"))


def phase_sync(pairs: DataFrame, fs: float, keys: list[str], bands: DataFrame, order: int = 4, pos: str = "idx") -> DataFrame:
    """keys, f0, plv, mean_phase, preferred_lag_s, pli_sin, wpli of x and y, each pair in its own band: ``bands`` has keys, f0,
    low, high (``dominant_band``, or any table). One plan filters all pairs, whatever their bands. Gaps are filled first; a pair
    without a band, or with a constant side, gives nulls."""
    from .filters import enveloped, filtered_by
    from .models import on_keys

    own = [f"_key{i}" for i in range(len(keys))]  # keys may be named like a column of a step
    named = bands.select(*[F.col(k).alias(n) for k, n in zip(keys, own)], "f0", "low", "high")
    samples = pairs.select(*[F.col(k).alias(n) for k, n in zip(keys, own)], F.col(pos).alias("idx"), "x", "y")
    both = [samples.select(*own, "idx", F.lit(v).alias("side"), F.col(v).cast("double").alias("x")) for v in ("x", "y")]
    rows = on_keys(both[0].unionByName(both[1]), named, own)
    by = [*own, "side"]
    signal = enveloped(filtered_by(rows, fs, F.col("low"), F.col("high"), order, by), by)

    def of(side: str, part) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("envelope") * part("phase")))

    z = signal.groupBy(*own, "idx").agg(*[of(v, part).alias(f"{name}_{v}") for v in ("x", "y") for name, part in (("a", F.cos), ("b", F.sin))])
    out = on_keys(phase_coupling(z, own), named.select(*own, "f0"), own)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, own)], "f0", "plv", "mean_phase", (F.col("mean_phase") / (2 * math.pi * F.col("f0"))).alias("preferred_lag_s"), "pli_sin", "wpli")
