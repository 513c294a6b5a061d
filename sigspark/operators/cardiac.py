"""Heart rate as a series: its spectrum in windows, and its coupling with an envelope on two paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import ratio
from ..functions.shared import cut_lineage
from . import bundles as bd, coupling as cp, series as op, spectral as sp


def rate_spectrum(peaks: DataFrame, fs: float, n: int, step: int, bands: list[tuple[str, float, float]], keys: list[str], t: str = "t_s") -> DataFrame:
    """keys, w, the power of each band (low <= f < high) of the gridded rate in windows of ``n`` samples, and the ratio of
    the first two bands. Only complete windows count."""
    w = op.exploded_windows(bd.rate_on_grid(peaks, fs, keys, t).select(*keys, "idx", "x"), n, step, keys)
    psd = sp.welch(w.select(*keys, "w", F.col("pos").alias("idx"), "x"), n, n, fs, [*keys, "w"])
    sums = [F.sum(F.when((F.round(F.col("f") / fs * n) * (fs / n) >= low) & (F.col("f") < high), F.col("p"))) * (fs / n) for _, low, high in bands]
    out = psd.groupBy(*keys, "w").agg(*[s.alias(name) for s, (name, _, _) in zip(sums, bands)])
    first, second = bands[0][0], bands[1][0]
    return out.withColumn(f"{first}_{second}", ratio(first, second))


def matched_to_rate(peaks: DataFrame, envelope: DataFrame, fs: float, keys: list[str], t: str = "t_s", least: int = 60, eps: float = 1e-9) -> DataFrame:
    """keys, idx, x (gridded rate), y (envelope at the same places). Series with fewer than ``least`` common samples, or
    without variance on either side, are left out."""
    rate = bd.rate_on_grid(peaks, fs, keys, t).select(*keys, "idx", "x")
    both = cut_lineage(rate.join(envelope.select(*keys, "idx", F.col("x").alias("y")).filter("y IS NOT NULL"), [*keys, "idx"]))  # the guard, and every path, read it
    good = both.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy")).filter((F.col("_n") >= least) & (F.col("_sx") > eps) & (F.col("_sy") > eps))
    return both.join(good.select(*keys), keys, "left_semi")


def two_path_coupling(peaks: DataFrame, envelope: DataFrame, fs: float, width: int, step: int, band: tuple[int, int, float, float], keys: list[str], least: int = 60) -> DataFrame:
    """keys, path, metric, value. Slow: correlation of windowed means of rate and envelope, from three windows on. Fast: mean
    and peak coherence of both in a band; ``band``: segment, step, lowest and highest frequency. Guards as in
    ``matched_to_rate``."""
    pairs = matched_to_rate(peaks, envelope, fs, keys, least=least)
    means = op.windowed(pairs, width, step, [F.avg("x").alias("x"), F.avg("y").alias("y")], keys)
    slow = cp.correlation(means, keys).filter("n >= 3").select(*keys, F.lit("slow").alias("path"), F.lit("r").alias("metric"), F.col("r").alias("value"))
    n, hop, low, high = band
    spectrum = sp.coherence(pairs, n, hop, fs, keys).filter(F.col("k").between(round(low * n / fs), round(high * n / fs)))
    g = spectrum.groupBy(*keys).agg(F.avg("c").alias("coherence"), F.max("c").alias("peak_coherence"))
    fast = [g.select(*keys, F.lit("fast").alias("path"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("coherence", "peak_coherence")]
    return reduce(DataFrame.unionByName, [slow, *fast])


def gridded_feature(windows: DataFrame, value: str, fs: float, keys: list[str], valid_ratio: float = 0.5, clip_margin: float = 0.5) -> DataFrame:
    """keys, idx, t, x: a feature of windows (time_start, time_end) linearly on a regular grid from the first to the last window
    that has it. Values stay within the feature's range and ``clip_margin`` of it to either side. Series with fewer than two
    values, or with a share of values below ``valid_ratio``, are left out."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    rows = windows.select(*keys, ((F.col("time_start") + F.col("time_end")) / 2).cast("double").alias("t"), v.alias("x"))
    spans = rows.groupBy(*keys).agg(F.count("x").alias("_n"), F.count("*").alias("_all"), F.min(F.when(F.col("x").isNotNull(), F.col("t"))).alias("_a"), F.max(F.when(F.col("x").isNotNull(), F.col("t"))).alias("_b"), F.min("x").alias("_low"), F.max("x").alias("_high"))
    spans = spans.filter((F.col("_n") >= 2) & (F.col("_n") >= valid_ratio * F.col("_all")) & (F.col("_b") > F.col("_a")))
    steps = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("_b") - F.col("_a")) * fs - 1e-9).cast("long") - 1)
    grid = spans.select(*keys, "_a", F.explode(steps).alias("idx")).select(*keys, "idx", (F.col("_a") + F.col("idx") / fs).alias("t"))
    known = rows.filter("x IS NOT NULL").join(spans.select(*keys), keys, "left_semi")
    on = op.interpolated(known, grid.select(*keys, "t"), keys)
    margin = (F.col("_high") - F.col("_low")) * clip_margin
    held = F.greatest(F.least(F.col("x"), F.col("_high") + margin), F.col("_low") - margin)
    return on.join(spans, keys).select(*keys, F.round((F.col("t") - F.col("_a")) * fs).cast("long").alias("idx"), "t", held.alias("x"))


def two_path_measures(pairs: DataFrame, fs: float, width: int, step: int, max_lag: int, bins: int, segment: int, keys: list[str], band_width: float, search: tuple[float, float]) -> DataFrame:
    """keys, path, metric, value for pairs that ``matched_to_rate`` has guarded. Slow, on windowed means, from three windows on:
    the largest correlation over lags, its lag in windows, and binned mutual information. Fast, on the samples, around the
    envelope's strongest frequency between those of ``search``: that frequency, PLV, its preferred lag, and wPLI."""
    pairs = cut_lineage(pairs)  # both paths read it
    means = op.windowed(pairs, width, step, [F.avg("x").alias("x"), F.avg("y").alias("y")], keys).withColumn("idx", F.col("w"))
    enough = means.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n >= 3").select(*keys)
    means = cut_lineage(means.join(enough, keys, "left_semi"))
    top = cp.peaks(cp.lagged_correlation(means, max_lag, keys), keys)
    mi = cp.mutual_information(cp.binned(means, bins, keys), keys)
    bands = sp.dominant_band(pairs, segment, fs, keys, band_width, search)
    fast = sp.phase_sync(pairs, fs, keys, bands)

    def rows(t: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
        metrics = [F.struct(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value")) for metric, c in columns.items()]
        return t.select(*keys, F.lit(path).alias("path"), F.inline(F.array(*metrics)))

    of_fast = {"frequency": "f0", "plv": "plv", "preferred_lag_s": "preferred_lag_s", "wpli": "wpli"}
    parts = [rows(top, "slow", {"xcorr_peak": "peak_r", "xcorr_lag": "peak_lag"}), rows(mi, "slow", {"mi": "mi_nats"}), rows(fast, "fast", of_fast)]
    return reduce(DataFrame.unionByName, parts)
