"""Queries on direction and information: Granger from lagged products, nearest neighbours, surrogate tests of any metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coupling as cp, features as ft, granger as gr, kernels as kn, neighbours as nn, series as op, surrogates as su
from .coupled import _PRO, _SH, SCALES
from .registry import ORACLE, pair_emb, query, r6, rounded

P = ["pair_id"]
W = ["pair_id", "w"]
_FOUND = ("f_xy", "f_yx", "p_xy", "p_yx", "direction")


def _windows(spark, d, width=32, step=16):
    return op.exploded_windows(pair_emb(spark, d), width, step, P)


_LAGGED = ", w AS (SELECT pair_id, w.w, idx - w.w * 16 AS pos, x, y FROM pair_emb, (SELECT range AS w FROM range(3)) w WHERE idx >= w.w * 16 AND idx < w.w * 16 + 32), c AS (SELECT pair_id, w, pos, x - (regr_slope(x, pos) OVER g * pos + regr_intercept(x, pos) OVER g) AS x, y - (regr_slope(y, pos) OVER g * pos + regr_intercept(y, pos) OVER g) AS y FROM w WINDOW g AS (PARTITION BY pair_id, w))"


@query(_LAGGED + " SELECT a.pair_id, a.w, l.range AS lag, round(sum(a.x * b.x), 6) + 0e0 AS xx, round(sum(a.x * b.y), 6) + 0e0 AS xy, round(sum(a.y * b.x), 6) + 0e0 AS yx, round(sum(a.y * b.y), 6) + 0e0 AS yy FROM c a, range(0, 6) l, c b WHERE a.pair_id = b.pair_id AND a.w = b.w AND b.pos = a.pos - l.range GROUP BY ALL", "pair_emb")
def cpl_lag_products(spark, d):
    """All that Granger's tests of every order see of a window, but for its ends."""
    w = _windows(spark, d).select("pair_id", "w", "pos", "x", "y")
    for v in "xy":
        w = op.detrended(w, W, v, "pos", v)
    p = gr.lag_products(w, 5, W, "pos")
    rows = p.select(*W, F.posexplode(F.arrays_zip("xx", "xy", "yx", "yy")).alias("lag", "_p")).select(*W, F.col("lag").cast("long").alias("lag"), "_p.*")
    return rounded(rows, "xx", "xy", "yx", "yy")


@query(None)
def cpl_granger(spark, d):
    return rounded(gr.granger(pair_emb(spark, d), P), *_FOUND)


@query(None)
def cpl_granger_windowed(spark, d):
    return rounded(gr.granger(_windows(spark, d), W, 4, pos="pos"), *_FOUND)


@query(None)
def cpl_mi_knn(spark, d):
    return rounded(kn.per_group(pair_emb(spark, d), P, ["x", "y"], nn.mutual_information, "mi_knn double"), "mi_knn")


@query(None)
def cpl_te_knn(spark, d):
    return rounded(kn.per_group(pair_emb(spark, d), P, ["x", "y"], nn.transfer_entropy, "te_knn double"), "te_knn")


@query(None)
def cpl_mi_knn_windowed(spark, d):
    return rounded(nn.windowed_information(pair_emb(spark, d), 32, 16, 64.0, P), "mi_knn")


@query(None)
def cpl_mi_knn_effective(spark, d):
    """Neighbour information less its mean over phase-shuffled surrogates, in every window."""
    w = _windows(spark, d).select("pair_id", "w", F.col("pos").alias("idx"), "x", "y")
    return rounded(nn.effective_information(w, 9, W), "observed", "null_mean", "null_std", "effective", "p", "z")


def _absolute(rows, by):
    return rows.groupBy(*by).agg(F.abs(F.corr("x", "y")).alias("value"))


@query(None)
def surr_metric_corr(spark, d):
    """The surrogate test with a metric given as a plan: absolute correlation."""
    return rounded(su.tested_metric(pair_emb(spark, d), _absolute, 19, P), "observed", "null_mean", "null_std", "p2_5", "p95", "p97_5", "p").withColumn("z", F.round("z", 4) + 0.0)


ORACLE["surr_metric_corr"] = ORACLE["surr_test"]

_SPREAD = _SH + ", v AS (SELECT pair_id, surrogate, round(-avg((x - y) ** 2), 9) AS v FROM moved GROUP BY ALL), o AS (SELECT *, max(v) FILTER (surrogate = 0) OVER (PARTITION BY pair_id) AS o FROM v) SELECT pair_id, round(max(o), 6) + 0e0 AS observed, round(avg(v) FILTER (surrogate > 0), 6) + 0e0 AS null_mean, round((count(*) FILTER (surrogate > 0 AND v >= o) + 1) / 20e0, 6) AS p FROM o GROUP BY pair_id"


@query(_SPREAD, "pair_emb")
def surr_metric_distance(spark, d):
    """The same test with another metric: the negative mean squared distance."""
    t = su.tested_metric(pair_emb(spark, d), lambda rows, by: rows.groupBy(*by).agg((-F.avg((F.col("x") - F.col("y")) ** 2)).alias("value")), 19, P)
    return t.select("pair_id", r6("observed").alias("observed"), r6("null_mean").alias("null_mean"), r6("p").alias("p"))


@query(_PRO + ", e AS (SELECT pair_id, regr_slope(ln(sqrt(fxx)), ln(s)) AS a, regr_slope(ln(sqrt(fyy)), ln(s)) AS b FROM f GROUP BY pair_id) SELECT pair_id, round(1 - abs(a - b), 6) + 0e0 AS match FROM e", "pair_emb")
def cpl_matched_dfa(spark, d):
    """Exponent matching with the exponent looked up by name."""
    return rounded(cp.matched_exponents(pair_emb(spark, d), "dfa", SCALES), "match")


# The sides of pair k are the series 2k and 2k + 1.
_HIGUCHI = ORACLE["frac_higuchi"].replace("round(", "(").replace(", 6) + 0e0 AS fd", ") AS fd").replace(", 6) AS fd", ") AS fd")


@query(f"SELECT series_id // 2 AS pair_id, round(1 - abs(max(fd) FILTER (series_id % 2 = 0) - max(fd) FILTER (series_id % 2 = 1)), 5) + 0e0 AS match FROM ({_HIGUCHI}) WHERE series_id // 2 IN (SELECT a.vec_id // 2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) GROUP BY ALL")
def cpl_matched_higuchi(spark, d):
    """The same with a function instead of a name."""
    own = lambda df, scales, keys: ft.higuchi(df, max(scales), keys).withColumnRenamed("fd", "exponent")
    return cp.matched_exponents(pair_emb(spark, d), own, [8]).withColumn("match", F.round("match", 5) + 0.0)
