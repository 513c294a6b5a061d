"""Entropy, fractal and variability features of a series or window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import corr, ratio
from .series import KEYS, coarse_grained, ordered, whole


def _entropy(counts: DataFrame, keys: list[str], n: str, scale: float) -> DataFrame:
    q = counts.withColumn("_q", F.col(n) / F.sum(n).over(whole(keys)))
    return q.groupBy(*keys).agg((-F.sum(F.col("_q") * F.log2("_q")) / scale + 0.0).alias("entropy"))


def permutation_entropy(df: DataFrame, order: int = 3, delay: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Entropy of the orders of ``order`` successive values, 0 to 1; equal values rank by place."""
    w = ordered(keys)
    ahead = [F.lead("x", k * delay).over(w) if k else F.col("x") for k in range(order)]
    pattern = F.transform(F.array_sort(F.array(*[F.struct(a.alias("v"), F.lit(k).alias("k")) for k, a in enumerate(ahead)])), lambda s: s["k"])
    rows = df.select(*keys, ahead[-1].alias("_last"), pattern.alias("_pattern")).filter("_last IS NOT NULL")
    return _entropy(rows.groupBy(*keys, "_pattern").agg(F.count("*").alias("n")), keys, "n", math.log2(math.factorial(order)))


def _templates(df: DataFrame, m: int, keys: list[str], x: str) -> DataFrame:
    w = ordered(keys, "idx")
    t = df.select(*keys, "idx", F.array(*[F.lead(x, k).over(w) if k else F.col(x) for k in range(m + 1)]).alias("t"), F.col("_r"))
    return t.filter(F.element_at("t", m + 1).isNotNull() & (F.col("_r") > 0))


def _matches(a: DataFrame, b: DataFrame, m: int, keys: list[str], same: bool) -> DataFrame:
    """n_short and n_long: template pairs closer than r in m, and in m + 1, values. Buckets of width r make it an
    equi-join: the partner is in the same bucket or next to it."""
    first = F.floor(F.element_at("t", 1) / F.col("_r")).cast("long")
    left = a.select(*keys, F.col("idx").alias("_i"), F.col("t").alias("_a"), F.col("_r"), F.explode(F.array(first - 1, first, first + 1)).alias("_bucket"))
    right = b.select(*keys, F.col("idx").alias("_j"), F.col("t").alias("_b"), first.alias("_bucket"))
    pairs = left.join(right, [*keys, "_bucket"])
    if same:
        pairs = pairs.filter("_i < _j")
    close = [F.abs(F.col("_a")[k] - F.col("_b")[k]) < F.col("_r") for k in range(m + 1)]
    short = close[0]
    for c in close[1:m]:
        short = short & c
    return pairs.filter(short).groupBy(*keys).agg(F.count("*").alias("n_short"), F.count_if(close[m]).alias("n_long"))


def _sampen(counts: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    out = every.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["n_short", "n_long"])
    return out.withColumn("sampen", F.when((F.col("n_long") > 0) & (F.col("n_short") > 0), -F.ln(F.col("n_long") / F.col("n_short")) + 0.0))


def sample_entropy(df: DataFrame, m: int = 2, r: float = 0.2, keys: list[str] = KEYS, absolute: Column | None = None) -> DataFrame:
    """Of series: r times the population deviation (or ``absolute``) is the tolerance; null where nothing matches."""
    tolerance = absolute if absolute is not None else r * F.stddev_pop("x").over(whole(keys))
    t = _templates(df.withColumn("_r", tolerance), m, keys, "x")
    return _sampen(_matches(t, t, m, keys, True), df, keys)


def approximate_entropy(df: DataFrame, m: int = 2, r: float = 0.2, keys: list[str] = KEYS) -> DataFrame:
    """keys, apen: phi(m) - phi(m + 1), where phi is the mean log of the share of templates within r deviations of each one,
    itself included. Every template counts for its own length; a constant series, or one without a template, gives null."""
    w = whole(keys)
    rows = df.filter(F.col("x").isNotNull()).withColumn("_r", r * F.stddev_pop("x").over(w)).filter("_r > 0")
    parts = []
    for size in (m, m + 1):
        ahead = [F.lead("x", k).over(ordered(keys)) if k else F.col("x") for k in range(size)]
        t = rows.select(*keys, "idx", "_r", F.array(*ahead).alias("t")).filter(F.element_at("t", size).isNotNull())
        first = F.floor(F.element_at("t", 1) / F.col("_r")).cast("long")
        left = t.select(*keys, F.col("idx").alias("_i"), F.col("t").alias("_a"), "_r", F.explode(F.array(first - 1, first, first + 1)).alias("_bucket"))
        right = t.select(*keys, F.col("t").alias("_b"), first.alias("_bucket"))
        close = F.lit(True)
        for k in range(size):
            close = close & (F.abs(F.col("_a")[k] - F.col("_b")[k]) <= F.col("_r"))
        near = left.join(right, [*keys, "_bucket"]).filter(close).groupBy(*keys, "_i").agg(F.count("*").alias("_n"))
        phi = near.groupBy(*keys).agg((F.avg(F.ln("_n")) - F.ln(F.count("*"))).alias("_phi"))
        parts.append(phi.withColumn("_size", F.lit(size)))
    both = parts[0].unionByName(parts[1]).groupBy(*keys).agg(F.max(F.when(F.col("_size") == m, F.col("_phi"))).alias("_p"), F.max(F.when(F.col("_size") == m + 1, F.col("_phi"))).alias("_q"))
    return df.select(*keys).distinct().join(both, keys, "left").select(*keys, (F.col("_p") - F.col("_q") + 0.0).alias("apen"))


def cross_sample_entropy(pairs: DataFrame, m: int = 2, r: float = 0.2, keys: list[str] = KEYS) -> DataFrame:
    """Of x against y, both standardised first; every pair of templates counts."""
    w = whole(keys)
    z = pairs.withColumns({v: (F.col(v) - F.avg(v).over(w)) / F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)) for v in ("x", "y")}).withColumn("_r", F.lit(r))
    return _sampen(_matches(_templates(z, m, keys, "x"), _templates(z, m, keys, "y"), m, keys, False), pairs, keys)


def _at_scales(df: DataFrame, scales: list[int], keys: list[str], columns: list[str]) -> DataFrame:
    scaled = df.withColumn("scale", F.explode(F.array(*[F.lit(s).cast("long") for s in scales])))
    groups = scaled.groupBy(*keys, "scale", F.floor(F.col("idx") / F.col("scale")).cast("long").alias("k")).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("_n"))
    return groups.filter("_n = scale").drop("_n").withColumnRenamed("k", "idx")


def multiscale_entropy(df: DataFrame, scales: list[int], m: int = 2, r: float = 0.2, keys: list[str] = KEYS) -> DataFrame:
    """Sample entropy of the coarse-grained series with the tolerance of the original at every scale."""
    sd = df.withColumn("_sd", F.stddev_pop("x").over(whole(keys)))
    coarse = _at_scales(sd, scales, keys, ["x", "_sd"])
    return sample_entropy(coarse, m, r, [*keys, "scale"], r * F.col("_sd"))


def multiscale_cross_entropy(pairs: DataFrame, scales: list[int], m: int = 2, r: float = 0.2, keys: list[str] = KEYS) -> DataFrame:
    w = whole(keys)
    z = pairs.withColumns({v: (F.col(v) - F.avg(v).over(w)) / F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)) for v in ("x", "y")})
    coarse = _at_scales(z, scales, keys, ["x", "y"]).withColumn("_r", F.lit(r))
    by = [*keys, "scale"]
    return _sampen(_matches(_templates(coarse, m, by, "x"), _templates(coarse, m, by, "y"), m, by, False), coarse, by)


def svd_gram(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The six sums of products of a delay embedding of order three: what SVD entropy depends on."""
    w = ordered(keys)
    t = df.select(*keys, F.col("x").alias("_0"), F.lead("x").over(w).alias("_1"), F.lead("x", 2).over(w).alias("_2")).filter("_2 IS NOT NULL")
    return t.groupBy(*keys).agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)])


def katz(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    w = ordered(keys)
    s = df.select(*keys, F.abs(F.col("x") - F.lag("x").over(w)).alias("_d"), F.abs(F.col("x") - F.first("x").over(w)).alias("_far"))
    g = s.groupBy(*keys).agg(F.sum("_d").alias("_l"), F.avg("_d").alias("_a"), F.max("_far").alias("_m"))
    n = F.log10(ratio("_l", "_a"))
    return g.select(*keys, ratio(n, n + F.log10(ratio("_m", "_l"))).alias("fd"))


def petrosian(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    w = ordered(keys)
    d = df.withColumn("_d", F.col("x") - F.lag("x").over(w)).withColumn("_turn", F.signum("_d") * F.signum(F.lag("_d").over(w)) < 0)
    g = d.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), F.count_if("_turn").alias("_t"))
    return g.select(*keys, (F.log10("_n") / (F.log10("_n") + F.log10(F.col("_n") / (F.col("_n") + 0.4 * F.col("_t"))))).alias("fd"))


def higuchi(df: DataFrame, kmax: int = 8, keys: list[str] = KEYS) -> DataFrame:
    n = F.count("*").over(whole(keys))
    s = df.withColumn("_n", n).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, kmax + 1)]))).withColumn("m", F.col("idx") % F.col("k"))
    step = F.abs(F.col("x") - F.lag("x").over(W.partitionBy(*keys, "k", "m").orderBy("idx")))
    g = s.withColumn("_d", step).groupBy(*keys, "k", "m").agg(F.sum("_d").alias("_l"), F.count("_d").alias("_c"), F.max("_n").alias("_n")).filter("_c > 0")
    length = F.col("_l") * (F.col("_n") - 1) / (F.col("_c") * F.col("k")) / F.col("k")
    curve = g.groupBy(*keys, "k").agg(F.avg(length).alias("length")).filter("length > 0")
    return curve.groupBy(*keys).agg(F.regr_slope(F.ln("length"), F.ln(1.0 / F.col("k"))).alias("fd"))


def hjorth(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    w = ordered(keys)
    d = df.withColumn("_1", F.col("x") - F.lag("x").over(w)).withColumn("_2", F.col("_1") - F.lag("_1").over(w))
    g = d.groupBy(*keys).agg(F.var_pop("x").alias("activity"), F.var_pop("_1").alias("_v1"), F.var_pop("_2").alias("_v2"))
    mobility = F.sqrt(ratio("_v1", "activity"))
    return g.select(*keys, "activity", mobility.alias("mobility"), ratio(F.sqrt(ratio("_v2", "_v1")), mobility).alias("complexity"))


def profile(df: DataFrame, keys: list[str], columns: tuple[str, ...] = ("x",)) -> DataFrame:
    """Running sums of the centred columns."""
    centred = df.withColumns({c: F.col(c) - F.avg(c).over(whole(keys)) for c in columns})
    return centred.withColumns({c: F.sum(c).over(ordered(keys).rowsBetween(W.unboundedPreceding, 0)) for c in columns})


def _boxes(df: DataFrame, scales: list[int], keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Per scale and complete box of the profile: covariances of what a line leaves over, in closed form."""
    b = profile(df, keys, columns).withColumn("s", F.explode(F.array(*[F.lit(s).cast("long") for s in scales]))).withColumn("seg", F.floor(F.col("idx") / F.col("s")).cast("long"))
    sums = [F.regr_sxy(c, "idx").alias(f"_t{c}") for c in columns]
    pairs = [(a, c) for i, a in enumerate(columns) for c in columns[i:]]
    g = b.groupBy(*keys, "s", "seg").agg(F.count("*").alias("_n"), F.regr_sxx("idx", "idx").alias("_tt"), *sums, *[(F.covar_pop(a, c) * F.count("*")).alias(f"_{a}{c}") for a, c in pairs]).filter("_n = s")
    return g.groupBy(*keys, "s").agg(*[F.avg((F.col(f"_{a}{c}") - F.col(f"_t{a}") * F.col(f"_t{c}") / F.col("_tt")) / F.col("_n")).alias(f"f2_{a}{c}") for a, c in pairs])


def dfa_curve(df: DataFrame, scales: list[int], keys: list[str] = KEYS) -> DataFrame:
    """keys, s, f: the fluctuation at each scale."""
    return _boxes(df, scales, keys, ("x",)).select(*keys, "s", F.sqrt(F.greatest("f2_xx", F.lit(0.0))).alias("f"))


def dfa(df: DataFrame, scales: list[int], keys: list[str] = KEYS) -> DataFrame:
    return dfa_curve(df, scales, keys).filter("f > 0").groupBy(*keys).agg(F.regr_slope(F.ln("f"), F.ln("s")).alias("alpha"))


def dcca(pairs: DataFrame, scales: list[int], keys: list[str]) -> DataFrame:
    """keys, s, f2_xy, rho: detrended cross-correlation."""
    b = _boxes(pairs, scales, keys, ("x", "y"))
    return b.select(*keys, "s", F.col("f2_xy"), ratio("f2_xy", F.sqrt(F.greatest(F.col("f2_xx") * F.col("f2_yy"), F.lit(0.0)))).alias("rho"))


def hurst(df: DataFrame, sizes: list[int], keys: list[str] = KEYS) -> DataFrame:
    """Rescaled range over complete chunks of several sizes."""
    c = df.withColumn("s", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]))).withColumn("seg", F.floor(F.col("idx") / F.col("s")).cast("long"))
    by = [*keys, "s", "seg"]
    c = c.withColumn("_c", F.col("x") - F.avg("x").over(whole(by))).withColumn("_p", F.sum("_c").over(ordered(by).rowsBetween(W.unboundedPreceding, 0)))
    g = c.groupBy(*by).agg(F.count("*").alias("_n"), ratio(F.max("_p") - F.min("_p"), F.stddev_samp("x")).alias("_rs")).filter("_n = s AND _rs > 0")
    means = g.groupBy(*keys, "s").agg(F.avg("_rs").alias("_rs"))
    return means.groupBy(*keys).agg(F.regr_slope(F.ln("_rs"), F.ln("s")).alias("hurst"))


def heart_rate_windows(peaks: DataFrame, width: float, step: float, least: int, keys: list[str] = KEYS, t: str = "t_s") -> DataFrame:
    """Per window of ``width`` seconds with ``least`` peaks: mean RR (ms), SDNN, RMSSD, pNN50, mean rate."""
    w = ordered(keys, t)
    rr = peaks.withColumn("_rr", (F.col(t) - F.lag(t).over(w)) * 1000.0).withColumn("_drr", F.col("_rr") - F.lag("_rr").over(w))
    first = F.greatest(F.lit(0), F.floor((F.col(t) - width) / step) + 1).cast("long")
    x = rr.withColumn("w", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col(t) / step).cast("long")))))
    inside = (F.col(t) >= F.col("w") * step) & (F.col(t) < F.col("w") * step + width)
    g = x.filter(inside).groupBy(*keys, "w").agg(F.count("*").alias("n_peaks"), F.avg("_rr").alias("mean_rr"), F.stddev_samp("_rr").alias("sdnn"), F.sqrt(F.avg(F.col("_drr") * F.col("_drr"))).alias("rmssd"), (100.0 * F.count_if(F.abs("_drr") > 50) / F.nullif(F.count("_drr"), F.lit(0))).alias("pnn50"))
    return g.filter(F.col("n_peaks") >= least).withColumn("rate", 60000.0 / F.col("mean_rr"))


def instantaneous_rate(peaks: DataFrame, keys: list[str] = KEYS, t: str = "t_s") -> DataFrame:
    """Rate per minute at the middle of each pair of neighbouring peaks."""
    gap = F.lead(t).over(ordered(keys, t)) - F.col(t)
    return peaks.select(*keys, (F.col(t) + gap / 2).alias("t"), ratio(F.lit(60.0), gap).alias("x")).filter("t IS NOT NULL AND x IS NOT NULL")


def correlation_matrix(df: DataFrame, ids: list[str], group: list[str] | None = None) -> DataFrame:
    """feature_a, feature_b, r over all rows (or per group) of the other columns of ``df``."""
    group = group or []
    names = [c for c in df.columns if c not in ids and c not in group]
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), corr(a, b).alias("r")) for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*group).agg(F.array(*cells).alias("_m")).select(*group, F.inline("_m"))


def coarse(df: DataFrame, factor: int, keys: list[str] = KEYS) -> DataFrame:
    return coarse_grained(df, factor, keys)
