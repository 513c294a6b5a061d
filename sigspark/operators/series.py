"""Per-series scaling, windows, gap filling, resampling and detrending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import ratio

KEYS = ["series_id"]


def whole(keys: list[str]):
    return W.partitionBy(*keys)


def ordered(keys: list[str], by: str = "idx"):
    return W.partitionBy(*keys).orderBy(by)


def so_far(keys: list[str], *by: str):
    """The rows up to this one in order of ``by``."""
    return W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)


def from_here(keys: list[str], *by: str):
    """This row and those after it in order of ``by``, from the last row back to this one: its last value is the nearest. A frame
    that ends unbounded would be read anew for every row, so its time is quadratic in a series."""
    return so_far(keys, *[F.col(c).desc() for c in by])


def unpivot_prefix(df: DataFrame, ids: list[str], prefix: str, exclude: tuple[str, ...] = (), name: str = "channel", value: str = "x") -> DataFrame:
    """The columns with this prefix as (channel, x) rows."""
    columns = [c for c in df.columns if c.startswith(prefix) and c not in exclude and c not in ids]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)


def passes_quality(df: DataFrame, keys: list[str], least: int, eps: float = 1e-12, x: str = "x") -> DataFrame:
    """Rows of series that have ``least`` values, all finite, and vary by more than ``eps``."""
    good = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.count("*").alias("_all"), F.count_if(F.isnan(x)).alias("_nan"), F.stddev_pop(x).alias("_sd"))
    good = good.filter((F.col("_n") >= least) & (F.col("_n") == F.col("_all")) & (F.col("_nan") == 0) & (F.col("_sd") > eps))
    return df.join(good.select(*keys), keys, "left_semi")


def zscore(df: DataFrame, keys: list[str] = KEYS, x: str = "x", out: str = "z") -> DataFrame:
    w = whole(keys)
    return df.withColumn(out, (F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-12))


def max_abs_scaled(df: DataFrame, keys: list[str] = KEYS, x: str = "x", out: str = "scaled") -> DataFrame:
    """Centred, then divided by the largest absolute value; null for a constant series."""
    w = whole(keys)
    centred = df.withColumn("_c", F.col(x) - F.avg(x).over(w))
    return centred.withColumn(out, ratio("_c", F.max(F.abs("_c")).over(w))).drop("_c")


def log_minmax(df: DataFrame, keys: list[str] = KEYS, x: str = "x", out: str = "scaled") -> DataFrame:
    w = whole(keys)
    logged = df.withColumn("_l", F.log10(1e-8 + F.greatest(F.col(x), F.lit(0.0))))
    low, high = F.min("_l").over(w), F.max("_l").over(w)
    return logged.withColumn(out, ratio(F.col("_l") - low, high - low)).drop("_l")


def equal_frequency_bins(df: DataFrame, bins: int, keys: list[str] = KEYS, x: str = "x", out: str = "bin") -> DataFrame:
    """0 to bins - 1 by percentile edges; a series with few distinct values keeps them as its bins. Equal values share a bin;
    nulls have none."""
    return binned_columns(df, bins, keys, {x: out})


def _not_above(x: str) -> Callable[[Column], Column]:
    return lambda c: c <= F.col(x)


def binned_columns(df: DataFrame, bins: int, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``equal_frequency_bins`` of several columns (value: name of its bins) by one aggregation and one join. Exact percentiles and
    the set of values both hold a series' distinct values; what is joined back has at most ``bins`` + 1 of them."""
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    few = {f"_few{i}": x for i, x in enumerate(columns)}
    cuts = [F.percentile(x, share).alias(f"_cuts{i}") for i, x in enumerate(columns)]
    kinds = [F.slice(F.array_sort(F.collect_set(x)), 1, bins + 1).alias(name) for name, x in few.items()]
    edges = df.groupBy(*keys).agg(*cuts, *kinds)
    joined = df.join(edges, keys)
    codes = {}
    for i, (x, name) in enumerate(columns.items()):
        counted = F.size(F.filter(f"_cuts{i}", _not_above(x))).cast("long")
        dense = (F.array_position(f"_few{i}", F.col(x)) - 1).cast("long")
        codes[name] = F.when(F.col(x).isNotNull(), F.when(F.size(f"_few{i}") <= bins, dense).otherwise(counted))
    return joined.withColumns(codes).drop(*[f"_cuts{i}" for i in range(len(columns))], *few)


def trace(df: DataFrame, series: Column, fs: float, name: str, modality: str, t0: float, units: str, x: str = "x", idx: str = "idx") -> DataFrame:
    """A signal with its rate, origin and labels; time is t0 + idx / fs."""
    return df.select(series.alias("series_id"), F.lit(name).alias("name"), F.lit(modality).alias("modality"), F.lit(fs).alias("fs"), F.lit(t0).alias("t0"), F.lit(units).alias("units"), F.col(idx).alias("idx"), (F.col(idx) / fs + t0).alias("t_s"), F.col(x).alias("x"))


def crop(df: DataFrame, t0: float, t1: float, fs: float, origin: float = 0.0) -> DataFrame:
    """Samples from the first at or after t0 to the last at or before t1, counted from 0."""
    low, high = F.ceil((F.lit(t0) - origin) * fs), F.floor((F.lit(t1) - origin) * fs)
    return df.filter(F.col("idx").between(low, high)).withColumn("idx", F.col("idx") - low)


def _window_rows(df: DataFrame, width: int, step: int, idx: str, name: str = "w") -> DataFrame:
    """Every row once per window that may hold it. Windows are found by integer arithmetic, not by a range join."""
    i = F.col(idx)
    first = F.greatest(F.lit(0), F.ceil((i - (width - 1)) / step).cast("long"))
    last = F.floor(i / step).cast("long")
    out = df.withColumn(name, F.explode(F.when(last >= first, F.sequence(first, last))))
    return out.withColumn("pos", i - F.col(name) * step)


def exploded_windows(df: DataFrame, width: int, step: int, keys: list[str] = KEYS, idx: str = "idx", name: str = "w") -> DataFrame:
    """Every row once per window that holds it, with the window's number ``name`` and the place ``pos`` in it.

    Only complete windows are given: the last partial one is left out, as are windows with missing rows. Rows are counted
    per window, so nothing is ordered or counted over a whole series.
    """
    return _window_rows(df, width, step, idx, name).withColumn("_n", F.count("*").over(whole([*keys, name]))).filter(F.col("_n") == width).drop("_n")


def windowed(df: DataFrame, width: int, step: int, aggregates: list[Column], keys: list[str] = KEYS, fs: float = 1.0) -> DataFrame:
    """Aggregates per window, with its start, end and centre in seconds: the built-in surface for window features."""
    out = _window_rows(df, width, step, "idx").groupBy(*keys, "w").agg(F.count("*").alias("_n"), *aggregates).filter(F.col("_n") == width).drop("_n")
    return out.withColumns({"time_start": F.col("w") * step / fs, "time_end": (F.col("w") * step + width) / fs, "time_centre": (F.col("w") * step + width / 2) / fs})


def windowed_apply(df: DataFrame, width: int, step: int, feature: Callable, schema: str, keys: list[str] = KEYS) -> DataFrame:
    """Any function of one window (a pandas frame sorted by pos, giving a frame): for what built-ins cannot say."""

    def run(frame):
        return feature(frame.sort_values("pos"))

    return exploded_windows(df, width, step, keys).groupBy(*keys, "w").applyInPandas(run, schema)


def filled(df: DataFrame, keys: list[str] = KEYS, x: str = "x", idx: str = "idx", out: str = "x") -> DataFrame:
    """Linear over inner gaps, the nearest value at the edges; an all-null series stays null."""
    before, after = so_far(keys, idx), from_here(keys, idx)
    at = F.when(F.col(x).isNotNull(), F.col(idx))
    g = df.withColumns({"_a": F.last(x, True).over(before), "_b": F.last(x, True).over(after), "_i": F.last(at, True).over(before), "_j": F.last(at, True).over(after)})
    blend = F.col("_a") + (F.col("_b") - F.col("_a")) * ratio(F.col(idx) - F.col("_i"), F.col("_j") - F.col("_i"))
    return g.withColumn(out, F.coalesce(x, blend, F.col("_a"), F.col("_b"))).drop("_a", "_b", "_i", "_j")


def detrended(df: DataFrame, keys: list[str] = KEYS, x: str = "x", idx: str = "idx", out: str = "d", linear: bool = True) -> DataFrame:
    w = whole(keys)
    if not linear:
        return df.withColumn(out, F.col(x) - F.avg(x).over(w))
    slope, base = F.regr_slope(x, idx).over(w), F.regr_intercept(x, idx).over(w)
    return df.withColumn(out, F.col(x) - (slope * F.col(idx) + base))


def interpolated(samples: DataFrame, grid: DataFrame, keys: list[str] = KEYS, t: str = "t", x: str = "x", hold: bool = True) -> DataFrame:
    """``samples`` (keys, t, x) linearly at the times of ``grid`` (keys, t); beyond the ends held, or null.

    One union and a sort each way per series: brackets come from running last values, never from a range join.
    """
    return interpolated_columns(samples, grid, keys, [x], t, hold)


def interpolated_columns(samples: DataFrame, grid: DataFrame, keys: list[str], columns: list[str], t: str = "t", hold: bool = True) -> DataFrame:
    """``interpolated`` of several columns by the same sorts; each is bracketed by its own values."""
    both = samples.select(*keys, F.col(t), *columns, F.lit(0).alias("_grid")).unionByName(grid.select(*keys, F.col(t), *[F.lit(None).cast("double").alias(x) for x in columns], F.lit(1).alias("_grid")))
    before, after = so_far(keys, t, "_grid"), from_here(keys, t, "_grid")
    found = {}
    for n, x in enumerate(columns):
        at = F.when(F.col(x).isNotNull(), F.col(t))
        found |= {f"_a{n}": F.last(x, True).over(before), f"_b{n}": F.last(x, True).over(after), f"_i{n}": F.last(at, True).over(before), f"_j{n}": F.last(at, True).over(after)}
    g = both.withColumns(found).filter("_grid = 1")

    def value(n: int) -> Column:
        a, b, i, j = (F.col(f"_{c}{n}") for c in "abij")
        inner = F.when(i == F.col(t), a).otherwise(a + (b - a) * ratio(F.col(t) - i, j - i))
        return F.coalesce(inner, a, b) if hold else inner

    return g.select(*keys, t, *[value(n).alias(x) for n, x in enumerate(columns)])


def resampled(df: DataFrame, fs_from: float, fs_to: float, keys: list[str] = KEYS) -> DataFrame:
    """A regular series linearly at another rate, over the same span."""
    t = df.select(*keys, (F.col("idx") / fs_from).alias("t"), "x")
    spans = df.groupBy(*keys).agg(F.max("idx").alias("_last"))
    grid = spans.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") * fs_to / fs_from).cast("long"))).alias("idx"))
    values = interpolated(t, grid.select(*keys, (F.col("idx") / fs_to).alias("t")), keys)
    return values.select(*keys, F.round(F.col("t") * fs_to).cast("long").alias("idx"), "t", "x")


def normalised_grid(df: DataFrame, points: int, keys: list[str] = KEYS, t: str = "t", x: str = "x") -> DataFrame:
    """Values at ``points`` even places of each series' own span, scaled to 0..1; null outside."""
    w = whole(keys)
    scaled = df.select(*keys, ratio(F.col(t) - F.min(t).over(w), F.max(t).over(w) - F.min(t).over(w)).alias("u"), F.col(x).alias("x"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k")).select(*keys, (F.col("_k") / (points - 1.0)).alias("u"))
    return interpolated(scaled, grid, keys, "u", "x", hold=False)


def moving_rms(df: DataFrame, half: int, keys: list[str] = KEYS, x: str = "x", out: str = "rms") -> DataFrame:
    return df.withColumn(out, F.sqrt(F.avg(F.col(x) * F.col(x)).over(ordered(keys).rowsBetween(-half, half))))


def coarse_grained(df: DataFrame, factor: int | Column, keys: list[str] = KEYS, x: str = "x") -> DataFrame:
    """Means of successive groups of ``factor`` samples; a partial last group is dropped."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    return df.groupBy(*keys, F.floor(F.col("idx") / f).cast("long").alias("k")).agg(F.avg(x).alias("x"), F.count("*").alias("_n"), F.max(f).alias("_f")).filter("_n = _f").drop("_n", "_f")


def without_reference(df: DataFrame, reference: str, keys: list[str] = KEYS, x: str = "x", out: str = "cleaned") -> DataFrame:
    """The part of x that a linear fit on the reference does not explain."""
    w = whole(keys)
    return df.withColumn(out, F.col(x) - F.coalesce(F.regr_slope(x, reference).over(w), F.lit(0.0)) * (F.col(reference) - F.avg(reference).over(w)))


def ranked(df: DataFrame, by: str, keys: list[str] = KEYS, out: str = "rank") -> DataFrame:
    """Mean ranks: ties share the mean of the places they take."""
    ties = F.count("*").over(W.partitionBy(*keys, by))
    return df.withColumn(out, F.rank().over(ordered(keys, by)) + (ties - 1) / 2.0)
