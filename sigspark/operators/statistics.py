"""Repeated-measures statistics. Statistic columns are aggregations; only tail probabilities go through Arrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import special
from ..functions.scalar import ratio
from ..functions.shared import cut_lineage
from .models import on_keys
from .series import ranked, whole


def order_bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: sign, binary exponent and ten bits of the mantissa. It depends on the
    value alone, so rows are put in order in parts without looking at other rows."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    inside = F.least(F.greatest(F.floor((size / F.pow(F.lit(2.0), power) - 1) * 1024), F.lit(0)), F.lit(1023))
    return F.coalesce((F.signum(v) * ((power + 1100) * 1024 + inside)).cast("long"), F.lit(0).cast("long"))


def running(df: DataFrame, keys: list[str], by: str, x: Column, kind: str, out: str, descending: bool = False) -> DataFrame:
    """Adds ``out``: the sum, min or max of ``x`` over the rows of the same ``keys`` up to this one in order of ``by`` (a
    number, different in every row). No window spans a family: parts of the order are summed by themselves, in two steps, and
    the few thousand totals of the upper step travel as one array per family."""
    f, both = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}[kind]
    rows = df.withColumns({"_x": x, "_b": order_bucket(F.col(by))}).withColumn("_c", F.floor(F.col("_b") / 1024).cast("long"))

    def towards(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    part = rows.groupBy(*keys, "_c", "_b").agg(f("_x").alias("_t"))
    tops = part.groupBy(*keys, "_c").agg(f("_t").alias("_t")).groupBy(*keys).agg(F.collect_list(F.struct("_c", "_t")).alias("_tops"))
    part = part.withColumn("_before", f("_t").over(W.partitionBy(*keys, "_c").orderBy(towards("_b")).rowsBetween(W.unboundedPreceding, -1))).drop("_t")
    inside = rows.withColumn("_in", f("_x").over(W.partitionBy(*keys, "_c", "_b").orderBy(towards(by)).rowsBetween(W.unboundedPreceding, 0)))
    met = on_keys(on_keys(inside, part, [*keys, "_c", "_b"]), tops, keys)
    upper = F.filter("_tops", lambda t: t["_c"] > F.col("_c") if descending else t["_c"] < F.col("_c"))
    above = F.aggregate(upper, F.lit(None).cast(dict(rows.dtypes)["_x"]), lambda a, t: F.coalesce(both(a, t["_t"]), t["_t"]))
    total = F.col("_in")
    for more in (F.col("_before"), above):
        total = F.coalesce(both(total, more), total)
    return met.withColumn(out, total).drop("_x", "_b", "_c", "_before", "_in", "_tops")


def _family(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """keys, _p, _n, _k, _m: every distinct p once, with its rows, the rows up to it and the rows of the family."""
    counted = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*keys, F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    return on_keys(running(counted, keys, "_p", F.col("_n"), "sum", "_k"), sizes, keys)


def _corrected(df: DataFrame, p: str, keys: list[str], out: str, found: DataFrame) -> DataFrame:
    """``df`` with ``out`` of the row with its p; null where there is none."""
    table = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p"), F.col("_q"))
    met = F.col(p).cast("double") == F.col("_p")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rest = df.drop(out)
    return rest.join(table, met, "left").select(*[F.col(f"`{c}`") for c in rest.columns], F.col("_q").alias(out))


def bh_fdr(df: DataFrame, p: str = "p", keys: list[str] | None = None, out: str = "p_fdr", spread: bool | None = None) -> DataFrame:
    """Benjamini-Hochberg within each family; null and NaN p stay out and get null. ``spread``: a family is ranked by many
    tasks (by default where there are no keys, so that one family is the whole table); else a family is one window."""
    keys = keys or []
    if spread or spread is None and not keys:
        df = cut_lineage(df)  # p is read twice and must be the same number both times
        found = _family(df, p, keys).withColumn("_each", F.col("_p") * F.col("_m") / F.col("_k"))
        found = running(found, keys, "_p", F.col("_each"), "min", "_low", descending=True)
        return _corrected(df, p, keys, out, found.withColumn("_q", F.least(F.lit(1.0), "_low")))
    valid = F.when(~F.isnan(p), F.col(p))
    w = W.partitionBy(*keys).orderBy(F.col("_p").asc_nulls_last())
    d = df.withColumn("_p", valid).withColumns({"_m": F.count("_p").over(whole(keys)), "_k": F.row_number().over(w)})
    back = W.partitionBy(*keys).orderBy(F.col("_p").desc_nulls_first(), F.desc("_k"))  # from the last row, as a frame that ends there is read anew for every row
    q = F.min(F.col("_p") * F.col("_m") / F.col("_k")).over(back.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), q))).drop("_p", "_m", "_k")


def holm(df: DataFrame, p: str = "p", keys: list[str] | None = None, out: str = "p_holm", spread: bool | None = None) -> DataFrame:
    """Holm's step-down within each family; null and NaN p stay out and get null. ``spread`` as in ``bh_fdr``."""
    keys = keys or []
    if spread or spread is None and not keys:
        df = cut_lineage(df)  # p is read twice and must be the same number both times
        found = _family(df, p, keys).withColumn("_each", F.col("_p") * (F.col("_m") - F.col("_k") + F.col("_n")))
        found = running(found, keys, "_p", F.col("_each"), "max", "_high")
        return _corrected(df, p, keys, out, found.withColumn("_q", F.least(F.lit(1.0), "_high")))
    valid = F.when(~F.isnan(p), F.col(p))
    w = W.partitionBy(*keys).orderBy(F.col("_p").asc_nulls_last())
    d = df.withColumn("_p", valid).withColumns({"_m": F.count("_p").over(whole(keys)), "_k": F.row_number().over(w)})
    q = F.max(F.col("_p") * (F.col("_m") - F.col("_k") + 1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), q))).drop("_p", "_m", "_k")


def complete_cases(df: DataFrame, subject: str, condition: str, n_conditions: int, keys: list[str], value: str = "value") -> DataFrame:
    n = F.count(value).over(W.partitionBy(*keys, subject))
    return df.filter(F.col(value).isNotNull()).withColumn("_n", n).filter(F.col("_n") == n_conditions).drop("_n")


def friedman(df: DataFrame, subject: str, condition: str, n_conditions: int, keys: list[str] | None = None, value: str = "value", with_p: bool = True) -> DataFrame:
    """chi2 with tie correction over complete cases of at least three subjects."""
    keys, k = keys or [], n_conditions
    full = ranked(complete_cases(df, subject, condition, k, keys, value), value, [*keys, subject], "_r")
    ties = full.groupBy(*keys, subject, value).agg(F.count("*").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    sums = full.groupBy(*keys, condition).agg(F.sum("_r").alias("_s"), F.count("*").alias("_n")).groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.max("_n").alias("n"))
    both = sums.join(ties, keys) if keys else sums.crossJoin(ties)  # one row each
    n = F.col("n")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1)
    out = both.filter(n >= 3).select(*keys, "n", ratio(raw, 1 - F.col("_ties") / (n * k * (k * k - 1.0))).alias("chi2"))
    return out.withColumn("p", special.chi2_p("chi2", F.lit(float(k - 1)))) if with_p else out


def signed_rank(df: DataFrame, keys: list[str], diff: str = "diff", with_p: bool = True) -> DataFrame:
    """Wilcoxon: zero differences dropped, n, w (the smaller rank sum), and p."""
    d = df.filter((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("_a", F.abs(diff))
    r = ranked(d, "_a", keys, "_r")
    tied = r.groupBy(*keys, "_a").agg(F.count("*").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("ties"))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(diff) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    g = (g.join(tied, keys) if keys else g.crossJoin(tied)).withColumn("w", F.least("w_plus", "w_minus"))
    variance = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties") / 48.0
    out = g.withColumn("variance", variance)
    return out.withColumn("p", special.signed_rank_p("w", F.col("n").cast("double"), F.col("ties").cast("double"), "variance")) if with_p else out


def circular(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """n, mean_angle, resultant and Rayleigh's p."""
    g = df.groupBy(*keys).agg(F.count(angle).alias("n"), F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"))
    n, r = F.col("n").cast("double"), F.hypot("_c", "_s")
    z = n * r
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - z * z)) - (1 + 2 * n))
    return g.select(*keys, "n", F.atan2("_s", "_c").alias("mean_angle"), r.alias("resultant"), F.least(F.lit(1.0), p).alias("rayleigh_p"))


def t_one_sample(df: DataFrame, keys: list[str], value: str = "diff", with_p: bool = True) -> DataFrame:
    """n, mean, t, df of the mean against 0; of a column of differences this is the paired test."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    out = g.withColumns({"t": ratio("mean", F.col("_s") / F.sqrt("n")), "df": (F.col("n") - 1).cast("double")}).drop("_s")
    return out.withColumn("p", special.t_p("t", "df")) if with_p else out


def t_two_sample(df: DataFrame, keys: list[str], group: str, first: str, second: str, value: str = "value", welch: bool = False) -> DataFrame:
    def of(g: str, f) -> Column:
        return f(F.when(F.col(group) == g, F.col(value)))

    g = df.groupBy(*keys).agg(*[of(x, f).alias(f"_{n}{k}") for k, x in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = (F.col(c) for c in ("_n1", "_n2", "_v1", "_v2"))
    if welch:
        a, b = v1 / n1, v2 / n2
        se, free = F.sqrt(a + b), ratio((a + b) ** 2, a * a / (n1 - 1) + b * b / (n2 - 1))
    else:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, free = F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    return g.filter((n1 > 1) & (n2 > 1)).select(*keys, ratio(F.col("_m1") - F.col("_m2"), se).alias("t"), free.alias("df"))


def slopes(df: DataFrame, keys: list[str], t: str, value: str, least: int = 4) -> DataFrame:
    """Slope over each series' own time scaled to 0..1."""
    w = whole(keys)
    u = ratio(F.col(t) - F.min(t).over(w), F.max(t).over(w) - F.min(t).over(w))
    return df.withColumn("_u", u).groupBy(*keys).agg(F.count(value).alias("n"), F.regr_slope(value, "_u").alias("slope")).filter(F.col("n") >= least)


def effect_size(df: DataFrame, keys: list[str], group: str, first: str, second: str, value: str = "value") -> DataFrame:
    """Cohen's d with the deviation pooled by degrees of freedom, the raw and the relative difference, second against first."""
    def of(g: str, f) -> Column:
        return f(F.when(F.col(group) == g, F.col(value)))

    g = df.groupBy(*keys).agg(of(first, F.avg).alias("_a"), of(second, F.avg).alias("_b"), of(first, F.var_samp).alias("_va"), of(second, F.var_samp).alias("_vb"), of(first, F.count).alias("_na"), of(second, F.count).alias("_nb"))
    pooled = ((F.col("_na") - 1) * F.col("_va") + (F.col("_nb") - 1) * F.col("_vb")) / F.nullif(F.col("_na") + F.col("_nb") - 2, F.lit(0))
    raw = F.col("_b") - F.col("_a")
    return g.select(*keys, raw.alias("raw"), ratio(raw, F.sqrt(pooled)).alias("cohens_d"), ratio(100 * raw, F.abs("_a")).alias("percent"))


def direction(df: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(diff).alias("n"), F.count_if(F.col(diff) > 0).alias("n_up"))
    return g.withColumn("consistency", ratio(F.greatest("n_up", F.col("n") - F.col("n_up")), "n"))


def trajectory(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """keys, auc: area under the curve by rank sum of a 0/1 label, ties shared. Distinct scores are counted and ranked in
    parts, so no family is sorted by one task; rows with a null stay out; one label only gives null."""
    yes, no = F.sum(F.col(label).cast("long")), F.sum(1 - F.col(label).cast("long"))
    counted = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(yes.alias("_yes"), no.alias("_no"))
    r = running(counted, keys, "_s", F.col("_no"), "sum", "_below")
    wins = F.sum(F.col("_yes") * (F.col("_below") - F.col("_no") / 2.0))
    return r.groupBy(*keys).agg(ratio(wins, (F.sum("_yes") * F.sum("_no")).cast("double")).alias("auc"))


def accuracy(df: DataFrame, keys: list[str], label: str, predicted: Column) -> DataFrame:
    """keys, accuracy: the share of rows with both a label and a prediction where they agree."""
    return df.groupBy(*keys).agg(F.avg((predicted == (F.col(label) == 1)).cast("double")).alias("accuracy"))


def balanced_components(df: DataFrame, subject: str, channel: str, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Variance components of a balanced subject x channel table by sums of squares: the crossed model's closed form."""
    keys = keys or []
    s, c, a = whole([*keys, subject]), whole([*keys, channel]), whole(keys)
    d = df.withColumns({"_ms": F.avg(value).over(s), "_mc": F.avg(value).over(c), "_m": F.avg(value).over(a)})
    ns, nc = F.count_distinct(subject), F.count_distinct(channel)
    g = d.groupBy(*keys).agg(F.sum((F.col("_ms") - F.col("_m")) ** 2).alias("_ss"), F.sum((F.col("_mc") - F.col("_m")) ** 2).alias("_sc"), F.sum((F.col(value) - F.col("_ms") - F.col("_mc") + F.col("_m")) ** 2).alias("_se"), ns.alias("_a"), nc.alias("_b"), F.max("_m").alias("mean"))
    e = ratio("_se", (F.col("_a") - 1) * (F.col("_b") - 1) * 1.0)
    return g.select(*keys, "mean", e.alias("var_error"), F.greatest(F.lit(0.0), ratio(ratio("_ss", F.col("_a") - 1.0) - e, "_b")).alias("var_subject"), F.greatest(F.lit(0.0), ratio(ratio("_sc", F.col("_b") - 1.0) - e, "_a")).alias("var_channel"))
