"""Coupling of pairs of series: linear, information and complexity measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import corr, ratio
from .features import dfa, higuchi, hurst
from .series import binned_columns, exploded_windows, ordered, ranked, whole

PAIR = ["pair_id"]
#: Places of a series that one row holds while lags are read off.
LAG_CHUNK = 4096


def correlation(pairs: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """r, n and the t statistic with its degrees of freedom."""
    g = pairs.groupBy(*keys).agg(corr("x", "y").alias("r"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"))
    return g.withColumn("t", F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def _lag_rows(pairs: DataFrame, max_lag: int, keys: list[str], pos: str) -> DataFrame:
    """keys, lag, x, y: y is ``lag`` places before x, so at a positive lag x comes later. One row per window is grouped and
    its lags are read off the two arrays: nothing is joined, and what is shuffled does not grow with the lags."""
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("i"), "x", "y"))).alias("_v"))
    n = F.size("_v")
    at = rows.select(*keys, "_v", n.alias("_n"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).filter(F.abs("lag") < F.col("_n"))
    both = F.transform(F.sequence(F.greatest(F.lit(0), F.col("lag")), F.col("_n") - 1 + F.least(F.lit(0), F.col("lag"))), lambda i: F.struct(F.col("_v")[i]["x"].alias("x"), F.col("_v")[i - F.col("lag")]["y"].alias("y")))
    return at.select(*keys, F.col("lag").cast("long").alias("lag"), F.col("_n").cast("long").alias("n"), both.alias("both"))


def _lagged(pairs: DataFrame, max_lag: int, keys: list[str], chunk: int = LAG_CHUNK) -> DataFrame:
    """keys, lag, x, y as in ``_lag_rows``, for series of any length: a row holds a chunk of places and, on both sides, the
    places that its lags reach."""
    place = F.col("_i")
    rows = pairs.select(*keys, "x", "y", (F.row_number().over(ordered(keys)) - 1).cast("long").alias("_i"))
    reached = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((place - max_lag) / chunk)), F.floor((place + max_lag) / chunk))
    dealt = rows.select(*keys, F.explode(reached).alias("_chunk"), F.struct("_i", "x", "y").alias("_r"))
    held = dealt.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list("_r")).alias("_v"))
    lag, first = F.col("lag"), F.col("_v")[0]["_i"]
    last = first + F.size("_v") - 1
    low = F.greatest(F.col("_chunk") * chunk, first + lag)
    high = F.least(F.col("_chunk") * chunk + chunk - 1, last, last + lag)
    at = held.select("*", F.explode(F.sequence(F.lit(-max_lag).cast("long"), F.lit(max_lag).cast("long"))).alias("lag"))
    at = at.select(*keys, "lag", "_v", first.alias("_first"), low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    there = lambda i: F.col("_v")[(i - F.col("_first")).cast("int")]
    both = F.transform(F.sequence("_low", "_high"), lambda i: F.struct(there(i)["x"].alias("x"), there(i - lag)["y"].alias("y")))
    return at.select(*keys, "lag", F.inline(both))


def windowed_xcorr(pairs: DataFrame, width: int, step: int, max_lag: int, keys: list[str] = PAIR, unbiased: bool = False) -> DataFrame:
    """keys, w, lag, r of every window; biased by default, that is divided by the whole width at every lag."""
    w = whole([*keys, "w"])
    z = exploded_windows(pairs, width, step, keys).withColumns({v: (F.col(v) - F.avg(v).over(w)) for v in ("x", "y")}).withColumns({"_sx": F.stddev_pop("x").over(w), "_sy": F.stddev_pop("y").over(w)})
    lagged = _lag_rows(z, max_lag, [*keys, "w", "_sx", "_sy"], "pos")
    total = F.aggregate("both", F.lit(0.0), lambda s, p: s + p["x"] * p["y"])
    count = F.size("both") if unbiased else F.lit(width)
    return lagged.select(*keys, "w", "lag", (total / (F.col("_sx") * F.col("_sy") * count + 1e-12)).alias("r"))


def peaks(lags: DataFrame, keys: list[str], by_size: bool = False) -> DataFrame:
    """The lag with the largest r (or largest absolute r); of equal ones the smallest lag."""
    value = F.round(F.abs("r") if by_size else F.col("r"), 9)
    best = lags.groupBy(*keys).agg(F.max_by(F.struct("lag", "r"), F.struct(value, -F.col("lag"))).alias("_b"))
    return best.select(*keys, F.col("_b.lag").alias("peak_lag"), F.col("_b.r").alias("peak_r"))


def lagged_correlation(pairs: DataFrame, max_lag: int, keys: list[str] = PAIR) -> DataFrame:
    """Pearson correlation of what overlaps at each lag."""
    return _lagged(pairs, max_lag, keys).groupBy(*keys, "lag").agg(corr("x", "y").alias("r"))


def window_mean_correlation(pairs: DataFrame, width: int, step: int, keys: list[str] = PAIR) -> DataFrame:
    w = exploded_windows(pairs, width, step, keys).groupBy(*keys, "w").agg(corr("x", "y").alias("_r"))
    return w.groupBy(*keys).agg(F.avg(F.abs("_r")).alias("mean_abs_r"), F.count("_r").alias("n_windows"))


def spearman(pairs: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    r = ranked(ranked(pairs, "x", keys, "_a"), "y", keys, "_b")
    return r.groupBy(*keys).agg(corr("_a", "_b").alias("rho"))


def binned(pairs: DataFrame, bins: int, keys: list[str] = PAIR, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Each column as one of at most ``bins`` codes from 0: by percentile edges, or the values themselves where there are few.
    Equal values have equal codes, nulls none."""
    return binned_columns(pairs, bins, keys, {c: c for c in columns})


def mutual_information(cells: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """mi_nats of discrete x and y over the rows that have both."""
    n = cells.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "x", "y").agg(F.count("*").alias("_n"))
    n = n.withColumns({"_x": F.sum("_n").over(whole([*keys, "x"])), "_y": F.sum("_n").over(whole([*keys, "y"])), "_all": F.sum("_n").over(whole(keys))})
    return n.groupBy(*keys).agg((F.sum(F.col("_n") / F.col("_all") * F.ln(F.col("_n") * F.col("_all") / (F.col("_x") * F.col("_y"))))).alias("mi_nats"))


def lagged_mutual_information(pairs: DataFrame, bins: int, max_lag: int, keys: list[str] = PAIR) -> DataFrame:
    """mi_nats at each lag; positive: y comes later (other than in cross-correlation, where x does)."""
    rows = _lagged(binned(pairs, bins, keys), max_lag, keys).withColumn("lag", -F.col("lag"))
    return mutual_information(rows, [*keys, "lag"])


def transfer_entropy(pairs: DataFrame, bins: int, keys: list[str] = PAIR, source: str = "x", target: str = "y", history: int = 1) -> DataFrame:
    """Bits that the source's last value adds to the target's last ``history`` values about its next one. Steps with a
    missing value are left out."""
    b = binned(pairs, bins, keys)
    past = [F.lag(target, k).over(ordered(keys)) if k else F.col(target) for k in range(history)]
    t = b.select(*keys, F.lead(target).over(ordered(keys)).alias("_f"), F.array(*past).alias("_h"), F.col(source).alias("_s"))
    t = t.filter(F.col("_f").isNotNull() & F.col("_s").isNotNull() & ~F.exists("_h", lambda v: v.isNull()))
    n = t.groupBy(*keys, "_f", "_h", "_s").agg(F.count("*").alias("_n"))
    n = n.withColumns({"_hs": F.sum("_n").over(whole([*keys, "_h", "_s"])), "_fh": F.sum("_n").over(whole([*keys, "_f", "_h"])), "_hh": F.sum("_n").over(whole([*keys, "_h"])), "_all": F.sum("_n").over(whole(keys))})
    return n.groupBy(*keys).agg((F.sum(F.col("_n") / F.col("_all") * F.log2(F.col("_n") * F.col("_hh") / (F.col("_hs") * F.col("_fh")))) + 0.0).alias("te_bits"))


def pid(triples: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """redundancy, unique_x1, unique_x2, synergy (bits) of discrete x1, x2 about y, by the least specific information."""
    n = triples.groupBy(*keys, "x1", "x2", "y").agg(F.count("*").cast("double").alias("_n"))
    total = F.sum("_n").over(whole(keys))

    def information(columns: list[str]) -> tuple[Column, DataFrame]:
        g = n.groupBy(*keys, *columns, "y").agg(F.sum("_n").alias("_n"))
        return g.withColumns({"_x": F.sum("_n").over(whole([*keys, *columns])), "_y": F.sum("_n").over(whole([*keys, "y"])), "_all": total})

    def specific(column: str, name: str) -> DataFrame:
        g = information([column])
        term = F.col("_n") / F.col("_y") * F.log2(F.col("_n") * F.col("_all") / (F.col("_x") * F.col("_y")))
        return g.groupBy(*keys, "y").agg(F.sum(term).alias(name), F.max(F.col("_y") / F.col("_all")).alias(f"_p{name}"))

    def mutual(columns: list[str], name: str) -> DataFrame:
        term = F.col("_n") / F.col("_all") * F.log2(F.col("_n") * F.col("_all") / (F.col("_x") * F.col("_y")))
        return information(columns).groupBy(*keys).agg(F.sum(term).alias(name))

    least = specific("x1", "_a").join(specific("x2", "_b"), [*keys, "y"]).groupBy(*keys).agg(F.sum(F.col("_p_a") * F.least("_a", "_b")).alias("redundancy"))
    m = mutual(["x1"], "_m1").join(mutual(["x2"], "_m2"), keys).join(mutual(["x1", "x2"], "_m"), keys).join(least, keys)
    r = F.col("redundancy")
    return m.select(*keys, r, (F.col("_m1") - r).alias("unique_x1"), (F.col("_m2") - r).alias("unique_x2"), (F.col("_m") - F.col("_m1") - F.col("_m2") + r).alias("synergy"))


def gaussian_atoms_input(pairs: DataFrame, tau: int, keys: list[str] = PAIR) -> DataFrame:
    """The ten covariances of (x, y) now and ``tau`` later: what integrated information decomposition depends on."""
    w = ordered(keys)
    v = {"a": F.col("x"), "b": F.col("y"), "c": F.lead("x", tau).over(w), "d": F.lead("y", tau).over(w)}
    t = pairs.select(*keys, *[c.alias(k) for k, c in v.items()]).filter("c IS NOT NULL AND d IS NOT NULL")
    return t.groupBy(*keys).agg(*[F.covar_pop(p, q).alias(f"c_{p}{q}") for i, p in enumerate("abcd") for q in "abcd"[i:]])


def sides(pairs: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """x and y as series of their own: keys, side, idx, x."""
    return pairs.select(*keys, "idx", F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("x")), F.struct(F.lit("y").alias("side"), F.col("y").alias("x")))).alias("_s")).select(*keys, "_s.side", "idx", "_s.x")


def exponent_matching(exponents: DataFrame, value: str, keys: list[str] = PAIR, largest: float = 1.0) -> DataFrame:
    """1 - |difference of exponents| / largest."""
    g = exponents.groupBy(*keys).agg(F.max(F.when(F.col("side") == "x", F.col(value))).alias("_a"), F.max(F.when(F.col("side") == "y", F.col(value))).alias("_b"))
    return g.select(*keys, (1.0 - F.abs(F.col("_a") - F.col("_b")) / largest).alias("match"))


def curve_matching(curves: DataFrame, at: str, value: Column, keys: list[str] = PAIR) -> DataFrame:
    """Correlation of two curves over their common places."""
    c = curves.withColumn("_v", value).groupBy(*keys, at).agg(F.max(F.when(F.col("side") == "x", F.col("_v"))).alias("_a"), F.max(F.when(F.col("side") == "y", F.col("_v"))).alias("_b"))
    return c.groupBy(*keys).agg(corr("_a", "_b").alias("match"))


def windowed_dfa(df: DataFrame, width: int, step: int, scales: list[int], keys: list[str]) -> DataFrame:
    w = exploded_windows(df, width, step, keys).withColumn("idx", F.col("pos"))
    return dfa(w, scales, [*keys, "w"])


def complexity_coupling(pairs: DataFrame, width: int, step: int, scales: list[int], keys: list[str] = PAIR) -> DataFrame:
    """Correlation of the two windowed scaling exponents."""
    return curve_matching(windowed_dfa(sides(pairs, keys), width, step, scales, [*keys, "side"]), "w", F.col("alpha"), keys)


def complexity_information(pairs: DataFrame, width: int, step: int, scales: list[int], bins: int, keys: list[str] = PAIR) -> DataFrame:
    """Mutual information of the two windowed scaling exponents."""
    a = windowed_dfa(sides(pairs, keys), width, step, scales, [*keys, "side"])
    both = a.groupBy(*keys, F.col("w").alias("idx")).agg(*[F.max(F.when(F.col("side") == v, F.col("alpha"))).alias(v) for v in "xy"])
    return mutual_information(binned(both, bins, keys), keys)


def exponent_correlation(exponents: DataFrame, value: str, cells: list[str], keys: list[str] | None = None) -> DataFrame:
    """r, n and t of paired exponents over the cells of each ``keys``: does one side's scaling follow the other's? Null with
    fewer than three cells."""
    keys = keys or []
    g = exponents.groupBy(*keys, *cells).agg(F.max(F.when(F.col("side") == "x", F.col(value))).alias("x"), F.max(F.when(F.col("side") == "y", F.col(value))).alias("y"))
    return correlation(g, keys).withColumns({c: F.when(F.col("n") >= 3, F.col(c)) for c in ("r", "t")})


def dcca_exponent(curve: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """lambda_xy: the slope of ln sqrt |f2_xy| over ln s."""
    return curve.groupBy(*keys).agg(F.regr_slope(F.ln(F.sqrt(F.abs(F.nullif("f2_xy", F.lit(0.0))))), F.ln("s")).alias("lambda_xy"))


#: Scaling exponents by name: (series, scales, keys) to keys and ``exponent``. Callers may add their own.
EXPONENTS: dict[str, Callable[[DataFrame, list[int], list[str]], DataFrame]] = {
    "dfa": lambda df, scales, keys: dfa(df, scales, keys).withColumnRenamed("alpha", "exponent"),
    "hurst": lambda df, scales, keys: hurst(df, scales, keys).withColumnRenamed("hurst", "exponent"),
    "higuchi": lambda df, scales, keys: higuchi(df, max(scales), keys).withColumnRenamed("fd", "exponent"),
}


def matched_exponents(pairs: DataFrame, exponent: str | Callable, scales: list[int], keys: list[str] = PAIR, largest: float = 1.0) -> DataFrame:
    """keys, match: 1 - |difference of the sides' exponents| / largest, for an exponent by name or as a function."""
    of = EXPONENTS[exponent] if isinstance(exponent, str) else exponent
    return exponent_matching(of(sides(pairs, keys), scales, [*keys, "side"]), "exponent", keys, largest)
