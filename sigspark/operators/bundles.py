"""What users run: several measures of one set of pairs or frames as sibling plans, joined or stacked on the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.shared import cut_lineage
from . import coupling as cp, features as ft, frames as fr, kernels as kn, series as op, spectral as sp


def bundle(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables with one row per key side by side; a measure that a key lacks is null."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), parts)


def complete_bundle(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The same, but only keys that every table has, with no measure missing or NaN."""
    both = reduce(lambda a, b: a.join(b, keys), parts)
    kinds = dict(both.dtypes)
    for c in both.columns:
        if c not in keys:
            both = both.filter(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)))
    return both


def fingerprint(pairs: DataFrame, n: int, fs: float, band: tuple[float, float], width: int, step: int, max_lag: int, keys: list[str]) -> DataFrame:
    """Five measures per pair: mean absolute peak of windowed cross-correlation, band coherence, PLV, sine-ratio PLI, binned mutual information."""
    top = cp.peaks(cp.windowed_xcorr(pairs, width, step, max_lag, keys), [*keys, "w"], by_size=True)
    xcorr = top.groupBy(*keys).agg(F.avg(F.abs("peak_r")).alias("xcorr_peak"))
    segment = sp.segment_length(n, fs, *band) or max(8, n // 2)
    coherence = sp.band_coherence(sp.coherence(pairs, segment, segment // 2, fs, keys), *band, keys).select(*keys, F.col("mean").alias("coherence"))
    bins = range(max(1, round(band[0] * n / fs)), round(band[1] * n / fs) + 1)
    phase = sp.phase_coupling(sp.analytic(pairs, n, bins, keys, ("x", "y")), keys).select(*keys, "plv", "pli_sin")
    mi = cp.mutual_information(cp.binned(pairs, 4, keys), keys)
    return bundle([xcorr, coherence, phase, mi], keys)


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """metric, value rows of a wide table of measures."""
    names = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "metric", "value")


def with_envelopes(signal: DataFrame, envelopes: DataFrame, keys: list[str]) -> DataFrame:
    """One signal against every envelope: an equi-join on the sample, fanned out by the envelopes' channel."""
    return signal.select(*keys, "idx", "x").join(envelopes.select(*keys, "idx", "channel", F.col("x").alias("y")), [*keys, "idx"])


def band_matched(signals: DataFrame, envelopes: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Each channel with the envelope that its band names. ``bands``: band, envelope, a dimension of a few rows."""
    s = signals.join(bands, "band")
    e = envelopes.select(*keys, "idx", F.col("channel").alias("envelope"), F.col("x").alias("y"))
    return s.join(e, [*keys, "idx", "envelope"])


def band_phase_table(pairs: DataFrame, n: int, bands: list[tuple[str, int, int]], keys: list[str]) -> DataFrame:
    """Phase coupling in several bands of Fourier bins: keys, band, plv, mean_phase, pli_sin, wpli."""
    parts = [sp.phase_coupling(sp.analytic(pairs, n, range(low, high), keys, ("x", "y")), keys).withColumn("band", F.lit(name)) for name, low, high in bands]
    return reduce(DataFrame.unionByName, parts)


def comodulogram(pairs: DataFrame, n: int, phase_bands: list[tuple[int, int]], amplitude_bands: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """keys, phase_low, amp_low, mi, mvl: phase of x against amplitude of y over a grid of bands. Each band is transformed once."""
    slow = reduce(DataFrame.unionByName, [sp.analytic(pairs, n, range(*b), keys, ("x",)).select(*keys, "idx", F.lit(b[0]).cast("long").alias("phase_low"), F.atan2("b_x", "a_x").alias("phase")) for b in phase_bands])
    fast = reduce(DataFrame.unionByName, [sp.analytic(pairs, n, range(*b), keys, ("y",)).select(*keys, "idx", F.lit(b[0]).cast("long").alias("amp_low"), F.hypot("a_y", "b_y").alias("amp")) for b in amplitude_bands])
    return sp.phase_amplitude(slow.join(fast, [*keys, "idx"]), [*keys, "phase_low", "amp_low"])


def all_entropies(df: DataFrame, n: int, step: int, fs: float, keys: list[str]) -> DataFrame:
    parts = [
        ft.permutation_entropy(df, keys=keys).withColumnRenamed("entropy", "perm_entropy"), sp.spectral_entropy(sp.welch(df, n, step, fs, keys), keys).withColumnRenamed("entropy", "spectral_entropy"),
        ft.sample_entropy(df, keys=keys).select(*keys, F.col("sampen").alias("sample_entropy")), kn.svd_entropy(ft.svd_gram(df, keys), keys).withColumnRenamed("entropy", "svd_entropy"),
        kn.per_group(df, keys, ["x"], kn.lempel_ziv, "lzc double"),
    ]
    return bundle(parts, keys)


def all_fractals(df: DataFrame, scales: list[int], keys: list[str]) -> DataFrame:
    parts = [ft.higuchi(df, keys=keys).withColumnRenamed("fd", "higuchi"), ft.katz(df, keys).withColumnRenamed("fd", "katz"), ft.petrosian(df, keys).withColumnRenamed("fd", "petrosian"), ft.dfa(df, scales, keys).withColumnRenamed("alpha", "dfa"), ft.hurst(df, scales, keys)]
    return bundle(parts, keys)


def complexity_summary(df: DataFrame, n: int, step: int, fs: float, scales: list[int], keys: list[str], bands: list[tuple[str, float, float]] = ()) -> DataFrame:
    """Entropies, fractals, Hjorth numbers, spectral centroid and bandwidth, spectral slope, the area under the multiscale entropy,
    and of every band (name, low, high) the power as <name>_abs and its share as <name>_rel."""
    psd = sp.welch(df, n, step, fs, keys)
    total, centre = F.sum("p"), F.sum(F.col("f") * F.col("p")) / F.sum("p")
    shape = psd.groupBy(*keys).agg(total.alias("power"), centre.alias("centroid"), F.sqrt(F.sum(F.col("f") * F.col("f") * F.col("p")) / total - centre * centre).alias("bandwidth"), F.regr_slope(F.when(F.col("k") > 0, F.ln("p")), F.when(F.col("k") > 0, F.ln("f"))).alias("psd_slope"))
    area = ft.multiscale_entropy(df, [1, 2, 3], keys=keys).groupBy(*keys).agg(F.sum("sampen").alias("mse_area"))
    parts = [all_entropies(df, n, step, fs, keys), all_fractals(df, scales, keys), ft.hjorth(df, keys), shape, area]
    if bands:
        table = df.sparkSession.createDataFrame([(b, float(low), float(high)) for b, low, high in bands], "band string, low double, high double")
        powers = sp.band_powers(psd, table, keys)
        parts.append(powers.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{e}") for b, _, _ in bands for c, e in (("power", "abs"), ("relative", "rel"))]))
    return bundle(parts, keys)


def windowed_complexity(df: DataFrame, width: int, step: int, fs: float, scales: list[int], keys: list[str]) -> DataFrame:
    w = op.exploded_windows(df, width, step, keys).select(*keys, "w", F.col("pos").alias("idx"), "x")
    return complexity_summary(w, width // 2, width // 4, fs, scales, [*keys, "w"])


def spatial_complexity(frames: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """Gradient, spectrum, box-counting, lacunarity, patch-entropy and co-occurrence numbers of every frame."""
    spectrum = fr.spectrum_2d(frames, size)
    field = fr.field_summary(fr.patch_entropy(frames, max(2, size // 2), 8, low, high), "entropy").toDF(*fr.FRAME, "patch_mean", "patch_sd", "patch_p95", "patch_spread")
    parts = [fr.edge_density(frames), fr.radial_slope(spectrum), fr.spectral_shape(spectrum), fr.box_counting(frames, [1, 2, 4], F.col("v") > (low + high) / 2), fr.lacunarity(frames.withColumn("v", F.col("v") - low), [2, 4]), field, fr.glcm(frames, 8, low, high).toDF(*fr.FRAME, "glcm_contrast", "glcm_homogeneity")]
    return bundle(parts, fr.FRAME)


def quantified_clip(frames: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """One wide row of signals per frame: global numbers and spatial complexity. The frame table is scanned by sibling plans."""
    return bundle([fr.global_signals(frames, 16, low, high), spatial_complexity(frames, size, low, high)], fr.FRAME)


def clip_complexity(signals: DataFrame, n: int, step: int, fs: float, scales: list[int]) -> DataFrame:
    """clip, metric and the complexity summary of every signal of a clip (the columns of ``quantified_clip`` over its frames). The
    signals are written to the shared folder once, as every measure reads them."""
    long = long_form(signals, fr.FRAME).filter("value IS NOT NULL AND NOT isnan(value)")
    place = F.dense_rank().over(W.partitionBy("clip", "metric").orderBy("frame")) - 1
    series = long.select("clip", "metric", place.cast("long").alias("idx"), F.col("value").alias("x"))
    keys = ["clip", "metric"]
    return complexity_summary(cut_lineage(op.passes_quality(series, keys, n)), n, step, fs, scales, keys)


def common_grid_mean(curves: DataFrame, group: list[str], subject: str, step: float, t: str = "t", x: str = "x") -> DataFrame:
    """Curves of several subjects on one grid up to the shortest span: mean, standard error and count where two or more are."""
    keys = [*group, subject]
    ends = curves.groupBy(*keys).agg(F.max(t).alias("_e")).groupBy(*group).agg(F.min("_e").alias("_e"))
    grid = curves.select(*keys).distinct().join(ends, group).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_e") / step).cast("long"))).alias("_k")).select(*keys, (F.col("_k") * step).alias(t))
    on = op.interpolated(curves.select(*keys, t, x), grid, keys, t, x, hold=False)
    return on.groupBy(*group, t).agg(F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"), F.count(x).alias("n")).filter("n >= 2")


def _grid_knots(peaks: DataFrame, fs: float, keys: list[str], t: str) -> DataFrame:
    """keys, t, x, n: of the instantaneous rate the values that are next to a place of the grid; the ``n`` of a series add up to
    the number of all its values. Peaks are ordered between two places of the grid only; a series is a row per such stretch."""
    at = F.ceil(F.col(t) * fs).cast("long")
    exact = F.when((at - 1) / fs >= F.col(t), at - 1).when(at / fs < F.col(t), at + 1).otherwise(at)  # above the place before, not above its own
    rows = peaks.filter(F.col(t).isNotNull() & ~F.isnan(t)).select(*keys, F.col(t).cast("double").alias("_t"), exact.alias("_c"))

    def knot(a: Column, b: Column) -> Column:
        return F.when(b > a, F.struct((a + (b - a) / 2).alias("t"), (F.lit(60.0) / (b - a)).alias("x")))

    inside = rows.withColumn("_k", knot(F.col("_t"), F.lead("_t").over(op.ordered([*keys, "_c"], "_t"))))
    cells = inside.groupBy(*keys, "_c").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.min("_k").alias("_low"), F.max("_k").alias("_high"), F.count("_k").alias("_n"))
    across = knot(F.col("_last"), F.lead("_first").over(op.ordered(keys, "_c")))
    ends = F.array(F.struct(F.col("_low").alias("k"), F.least(F.col("_n"), F.lit(1)).alias("n")), F.struct(F.when(F.col("_n") > 1, F.col("_high")).alias("k"), (F.col("_n") - 1).alias("n")), F.struct(F.col("_across").alias("k"), F.lit(1).cast("long").alias("n")))
    return cells.withColumn("_across", across).select(*keys, F.explode(ends).alias("_e")).filter("_e.k IS NOT NULL").select(*keys, "_e.k.t", "_e.k.x", "_e.n")


def rate_on_grid(peaks: DataFrame, fs: float, keys: list[str], t: str = "t_s") -> DataFrame:
    """Instantaneous rate at a regular rate, ends held; series with fewer than four peaks are left out. What is ordered over a
    whole series are a few values per place of the grid, whatever the number of peaks."""
    knots = _grid_knots(peaks, fs, keys, t)
    spans = knots.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.sum("n").alias("_n")).filter("_n >= 3")
    grid = spans.select(*keys, F.explode(F.sequence(F.ceil(F.col("_a") * fs).cast("long"), F.greatest(F.ceil(F.col("_a") * fs), F.floor(F.col("_b") * fs)).cast("long"))).alias("idx"))
    on = op.interpolated(knots, grid.select(*keys, (F.col("idx") / fs).alias("t")), keys)
    return on.select(*keys, F.round(F.col("t") * fs).cast("long").alias("idx"), "t", "x")


def sensitivity_matrix(measures: DataFrame, case: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """case x method, every method's column divided by its largest absolute value."""
    wide = measures.groupBy(case).pivot(method, methods).agg(F.avg(value))
    tops = wide.agg(*[F.max(F.abs(F.col(f"`{m}`"))).alias(f"_{i}") for i, m in enumerate(methods)])
    return wide.crossJoin(F.broadcast(tops)).select(case, *[(F.col(f"`{m}`") / F.nullif(F.col(f"_{i}"), F.lit(0.0))).alias(m) for i, m in enumerate(methods)])  # one row on the right
