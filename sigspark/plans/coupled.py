"""Queries on pairs of series: coupling, surrogates and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S, special
from ..operators import coupling as cp, features as ft, series as op, spectral as sp, statistics as st, surrogates as su
from .registry import pair_emb, query, r6, rounded, sig_emb, sig_hourly
from .signal import _FILL

P = ["pair_id"]
SCALES = [4, 8, 16]


@query("SELECT pair_id, round(corr(x, y), 6) + 0e0 AS r, count(*)::BIGINT AS n, round(corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) ** 2)), 5) + 0e0 AS t FROM pair_emb GROUP BY pair_id", "pair_emb")
def cpl_corr(spark, d):
    return rounded(cp.correlation(pair_emb(spark, d)), "r").withColumn("t", F.round("t", 5) + 0.0)


_XC = ", w AS (SELECT pair_id, w.w, idx - w.w * 8 AS pos, x, y FROM pair_emb, (SELECT range AS w FROM range(5)) w WHERE idx >= w.w * 8 AND idx < w.w * 8 + 32), z AS (SELECT pair_id, w, pos, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, stddev_pop(x) OVER g AS sx, stddev_pop(y) OVER g AS sy FROM w WINDOW g AS (PARTITION BY pair_id, w)), xc AS (SELECT a.pair_id, a.w, l.range AS lag, sum(a.x * b.y) / (any_value(a.sx) * any_value(a.sy) * 32 + 1e-12) AS r FROM z a, range(-4, 5) l, z b WHERE a.pair_id = b.pair_id AND a.w = b.w AND b.pos = a.pos - l.range GROUP BY a.pair_id, a.w, l.range)"


def _xc(spark, d):
    return cp.windowed_xcorr(pair_emb(spark, d), 32, 8, 4)


@query(_XC + " SELECT pair_id, w, lag, round(r, 6) + 0e0 AS r FROM xc", "pair_emb")
def cpl_xcorr_window(spark, d):
    return rounded(_xc(spark, d), "r")


@query(_XC + " SELECT pair_id, w, arg_max(lag, (round(r, 9), -lag)) AS peak_lag, round(arg_max(r, (round(r, 9), -lag)), 6) + 0e0 AS peak_r, arg_max(lag, (round(abs(r), 9), -lag)) AS abs_lag FROM xc GROUP BY pair_id, w", "pair_emb")
def cpl_xcorr_peak(spark, d):
    lags = _xc(spark, d)
    by_size = cp.peaks(lags, ["pair_id", "w"], True).select("pair_id", "w", F.col("peak_lag").alias("abs_lag"))
    return rounded(cp.peaks(lags, ["pair_id", "w"]).join(by_size, ["pair_id", "w"]), "peak_r")


@query(", l AS (SELECT a.pair_id, l.range AS lag, corr(a.x, b.y) AS r FROM pair_emb a, range(-6, 7) l, pair_emb b WHERE a.pair_id = b.pair_id AND b.idx = a.idx - l.range GROUP BY a.pair_id, l.range) SELECT pair_id, lag, round(r, 6) + 0e0 AS r FROM l", "pair_emb")
def cpl_corr_lagged(spark, d):
    return rounded(cp.lagged_correlation(pair_emb(spark, d), 6), "r")


@query(", w AS (SELECT pair_id, w.w, corr(x, y) AS r FROM pair_emb, (SELECT range AS w FROM range(5)) w WHERE idx >= w.w * 8 AND idx < w.w * 8 + 32 GROUP BY ALL) SELECT pair_id, round(avg(abs(r)), 6) AS mean_abs_r, count(r)::BIGINT AS n_windows FROM w GROUP BY pair_id", "pair_emb")
def cpl_corr_window(spark, d):
    return rounded(cp.window_mean_correlation(pair_emb(spark, d), 32, 8), "mean_abs_r")


@query(", r AS (SELECT pair_id, rank() OVER (PARTITION BY pair_id ORDER BY a) + (count(*) OVER (PARTITION BY pair_id, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY pair_id ORDER BY b) + (count(*) OVER (PARTITION BY pair_id, b) - 1) / 2e0 AS rb FROM (SELECT pair_id, round(x, 2) AS a, round(y, 2) AS b FROM pair_emb)) SELECT pair_id, round(corr(ra, rb), 6) + 0e0 AS rho FROM r GROUP BY pair_id", "pair_emb")
def cpl_spearman(spark, d):
    return rounded(cp.spearman(pair_emb(spark, d).withColumns({"x": F.round("x", 2), "y": F.round("y", 2)})), "rho")


_AN = ", b AS (SELECT pair_id, k.range AS k, sum(x * cos(2 * pi() * k.range * idx / 64)) AS xr, -sum(x * sin(2 * pi() * k.range * idx / 64)) AS xi, sum(y * cos(2 * pi() * k.range * idx / 64)) AS yr, -sum(y * sin(2 * pi() * k.range * idx / 64)) AS yi FROM pair_emb, range({0}, {1}) k GROUP BY ALL), an AS (SELECT pair_id, i.range AS idx, sum(xr * cos(2 * pi() * k * i.range / 64) - xi * sin(2 * pi() * k * i.range / 64)) / 32 AS ax, sum(xr * sin(2 * pi() * k * i.range / 64) + xi * cos(2 * pi() * k * i.range / 64)) / 32 AS bx, sum(yr * cos(2 * pi() * k * i.range / 64) - yi * sin(2 * pi() * k * i.range / 64)) / 32 AS ay, sum(yr * sin(2 * pi() * k * i.range / 64) + yi * cos(2 * pi() * k * i.range / 64)) / 32 AS \"by\" FROM b, range(64) i GROUP BY ALL)"


@query(_AN.format(3, 9) + ", p AS (SELECT pair_id, bx * ay - ax * \"by\" AS im, atan2(bx * ay - ax * \"by\", ax * ay + bx * \"by\") AS d FROM an) SELECT pair_id, round(sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2), 6) AS plv, round(atan2(avg(sin(d)), avg(cos(d))), 5) + 0e0 AS mean_phase, round(abs(avg(sin(d))) / (avg(abs(sin(d))) + 1e-12), 6) AS pli_sin, round(abs(avg(im)) / (avg(abs(im)) + 1e-12), 6) AS wpli FROM p GROUP BY pair_id", "pair_emb")
def cpl_phase(spark, d):
    out = sp.phase_coupling(sp.analytic(pair_emb(spark, d), 64, range(3, 9), P, ("x", "y")), P)
    return rounded(out, "plv", "pli_sin", "wpli").withColumn("mean_phase", F.round("mean_phase", 5) + 0.0)


_PAC = _AN.format(2, 6).replace("b AS (", "b1 AS (").replace(" an AS (", " an1 AS (").replace("FROM b, range(64)", "FROM b1, range(64)") + _AN.format(12, 24) + ", pa AS (SELECT an1.pair_id, atan2(an1.bx, an1.ax) AS phase, sqrt(an.ay ** 2 + an.\"by\" ** 2) AS amp FROM an1 JOIN an ON an1.pair_id = an.pair_id AND an1.idx = an.idx), q AS (SELECT pair_id, least(floor((phase + pi()) / (2 * pi() / 18)), 17) AS bin, avg(amp) AS m FROM pa GROUP BY ALL), s AS (SELECT pair_id, m / sum(m) OVER (PARTITION BY pair_id) AS q FROM q), mi AS (SELECT pair_id, 1 + sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(18) AS mi FROM s GROUP BY pair_id), v AS (SELECT pair_id, avg(amp * cos(phase)) AS c, avg(amp * sin(phase)) AS s, avg(amp) AS a FROM pa GROUP BY pair_id)"


@query(_PAC + " SELECT pair_id, round(mi, 6) AS mi, round(sqrt(c * c + s * s), 6) AS mvl, round(sqrt(c * c + s * s) / a, 6) AS mvl_norm, round(atan2(s, c), 4) + 0e0 AS preferred_phase FROM mi JOIN v USING (pair_id)", "pair_emb")
def cpl_phase_amplitude(spark, d):
    pairs = pair_emb(spark, d)
    slow, fast = sp.analytic(pairs, 64, range(2, 6), P, ("x",)), sp.analytic(pairs, 64, range(12, 24), P, ("y",))
    pa = slow.join(fast, ["pair_id", "idx"]).select("pair_id", F.atan2("b_x", "a_x").alias("phase"), F.hypot("a_y", "b_y").alias("amp"))
    return rounded(sp.phase_amplitude(pa, P), "mi", "mvl", "mvl_norm").withColumn("preferred_phase", F.round("preferred_phase", 4) + 0.0)




def bins_sql(name: str, source: str, keys: str, n: int, columns: str = "idx") -> str:
    """Tables that replace x and y of ``source`` by codes: quantile edges, or the values themselves where there are few."""
    cuts = [k / n for k in range(1, n)]
    on = " AND ".join(f"s.{k} = e.{k}" for k in keys.split(", "))
    by = ", ".join(f"s.{k}" for k in keys.split(", "))
    code = ", ".join(f"CASE WHEN s.{v} IS NULL THEN NULL WHEN k{v} <= {n} THEN dense_rank() OVER (PARTITION BY {by} ORDER BY s.{v} NULLS LAST) - 1 ELSE len(list_filter(q{v}, lambda c: c <= s.{v})) END AS {v}" for v in "xy")
    return f", {name}_edges AS (SELECT {keys}, " + ", ".join(f"count(DISTINCT {v}) AS k{v}, quantile_cont({v}, {cuts}) AS q{v}" for v in "xy") + f" FROM {source} GROUP BY {keys}), {name} AS (SELECT {by}, s.{columns}, {code} FROM {source} s JOIN {name}_edges e ON {on})"


_BIN = bins_sql("bins", "pair_emb", "pair_id", 4)
#: The same pairs with few values: ties everywhere in y, three values in x, and some missing.
_TIED = ", tied AS (SELECT pair_id, idx, CASE WHEN idx % 11 <> 5 THEN sign(round(x * 4)) END AS x, round(y * 12) AS y FROM pair_emb)"
_MI = "SELECT {0}, round(sum(n / total * ln(n * total / (nx * ny))), 6) + 0e0 AS mi_nats FROM (SELECT {0}, n::DOUBLE AS n, sum(n) OVER (PARTITION BY {0}, x) AS nx, sum(n) OVER (PARTITION BY {0}, y) AS ny, sum(n) OVER (PARTITION BY {0}) AS total FROM (SELECT {0}, x, y, count(*) AS n FROM {1} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)) GROUP BY {0}"


@query(_BIN + " " + _MI.format("pair_id", "bins"), "pair_emb")
def cpl_mi_binned(spark, d):
    return rounded(cp.mutual_information(cp.binned(pair_emb(spark, d), 4)), "mi_nats")


@query(_BIN + ", l AS (SELECT a.pair_id, l.range AS lag, a.x, b.y FROM bins a, range(-3, 4) l, bins b WHERE a.pair_id = b.pair_id AND b.idx = a.idx + l.range) " + _MI.format("pair_id, lag", "l"), "pair_emb")
def cpl_mi_lagged(spark, d):
    return rounded(cp.lagged_mutual_information(pair_emb(spark, d), 4, 3), "mi_nats")


_TE = ", t AS (SELECT pair_id, lead(y) OVER o AS f, {0} AS h, x AS s FROM {1} WINDOW o AS (PARTITION BY pair_id ORDER BY idx)), n AS (SELECT pair_id, f, h, s, count(*)::DOUBLE AS n FROM t WHERE f IS NOT NULL AND h IS NOT NULL AND s IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, h, s) AS hs, sum(n) OVER (PARTITION BY pair_id, f, h) AS fh, sum(n) OVER (PARTITION BY pair_id, h) AS hh, sum(n) OVER (PARTITION BY pair_id) AS total FROM n) SELECT pair_id, round(sum(n / total * log2(n * hh / (hs * fh))), 6) + 0e0 AS te_bits FROM c GROUP BY pair_id"


@query(_BIN + _TE.format("y", "bins"), "pair_emb")
def cpl_te_binned(spark, d):
    return rounded(cp.transfer_entropy(pair_emb(spark, d), 4), "te_bits")


def _tied(spark, d):
    few = F.when(F.col("idx") % 11 != 5, F.signum(F.round(F.col("x") * 4)))
    return pair_emb(spark, d).select("pair_id", "idx", few.alias("x"), F.round(F.col("y") * 12).alias("y"))


@query(_TIED + bins_sql("bins", "tied", "pair_id", 4) + " " + _MI.format("pair_id", "bins"), "pair_emb")
def cpl_mi_tied(spark, d):
    """Mutual information where values tie or are missing."""
    return rounded(cp.mutual_information(cp.binned(_tied(spark, d), 4)), "mi_nats")


@query(_TIED + bins_sql("bins", "tied", "pair_id", 4) + _TE.format("y || '/' || lag(y) OVER o", "bins"), "pair_emb")
def cpl_te_history(spark, d):
    """Transfer entropy with two past values of the target, where values tie or are missing."""
    return rounded(cp.transfer_entropy(_tied(spark, d), 4, history=2), "te_bits")



_PID = ", t AS (SELECT pair_id, (x > 0)::INT AS x1, (y > 0)::INT AS x2, (lead(y) OVER (PARTITION BY pair_id ORDER BY idx) > 0)::INT AS y FROM pair_emb), n AS (SELECT pair_id, x1, x2, y, count(*)::DOUBLE AS n FROM t WHERE y IS NOT NULL GROUP BY ALL), a AS (SELECT pair_id, x1, y, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY pair_id, x1) AS nx, sum(sum(n)) OVER (PARTITION BY pair_id, y) AS ny, sum(sum(n)) OVER (PARTITION BY pair_id) AS total FROM n GROUP BY pair_id, x1, y), b AS (SELECT pair_id, x2, y, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY pair_id, x2) AS nx, sum(sum(n)) OVER (PARTITION BY pair_id, y) AS ny, sum(sum(n)) OVER (PARTITION BY pair_id) AS total FROM n GROUP BY pair_id, x2, y), c AS (SELECT pair_id, x1, x2, y, n, sum(n) OVER (PARTITION BY pair_id, x1, x2) AS nx, sum(n) OVER (PARTITION BY pair_id, y) AS ny, sum(n) OVER (PARTITION BY pair_id) AS total FROM n), sa AS (SELECT pair_id, y, sum(n / ny * log2(n * total / (nx * ny))) AS i, max(ny / total) AS p FROM a GROUP BY ALL), sb AS (SELECT pair_id, y, sum(n / ny * log2(n * total / (nx * ny))) AS i FROM b GROUP BY ALL), r AS (SELECT sa.pair_id, sum(p * least(sa.i, sb.i)) AS r FROM sa JOIN sb ON sa.pair_id = sb.pair_id AND sa.y = sb.y GROUP BY sa.pair_id), m1 AS (SELECT pair_id, sum(n / total * log2(n * total / (nx * ny))) AS m FROM a GROUP BY ALL), m2 AS (SELECT pair_id, sum(n / total * log2(n * total / (nx * ny))) AS m FROM b GROUP BY ALL), m AS (SELECT pair_id, sum(n / total * log2(n * total / (nx * ny))) AS m FROM c GROUP BY ALL)"


@query(_PID + " SELECT r.pair_id, round(r, 6) + 0e0 AS redundancy, round(m1.m - r, 6) + 0e0 AS unique_x1, round(m2.m - r, 6) + 0e0 AS unique_x2, round(m.m - m1.m - m2.m + r, 6) + 0e0 AS synergy FROM r JOIN m1 USING (pair_id) JOIN m2 USING (pair_id) JOIN m USING (pair_id)", "pair_emb")
def cpl_pid(spark, d):
    t = pair_emb(spark, d).select("pair_id", (F.col("x") > 0).cast("int").alias("x1"), (F.col("y") > 0).cast("int").alias("x2"), (F.lead("y").over(op.ordered(P)) > 0).cast("int").alias("y")).filter("y IS NOT NULL")
    return rounded(cp.pid(t), "redundancy", "unique_x1", "unique_x2", "synergy")


@query(", t AS (SELECT pair_id, x AS a, y AS b, lead(x) OVER w AS c, lead(y) OVER w AS d FROM pair_emb WINDOW w AS (PARTITION BY pair_id ORDER BY idx)) SELECT pair_id, " + ", ".join(f"round(covar_pop({p}, {q}), 8) + 0e0 AS c_{p}{q}" for i, p in enumerate("abcd") for q in "abcd"[i:]) + " FROM t WHERE c IS NOT NULL GROUP BY pair_id", "pair_emb")
def cpl_gaussian_covariances(spark, d):
    c = cp.gaussian_atoms_input(pair_emb(spark, d), 1)
    return c.select("pair_id", *[(F.round(n, 8) + 0.0).alias(n) for n in c.columns[1:]])


_PRO = ", c AS (SELECT pair_id, idx, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM pair_emb WINDOW w AS (PARTITION BY pair_id)), p AS (SELECT pair_id, idx, sum(x) OVER w AS x, sum(y) OVER w AS y FROM c WINDOW w AS (PARTITION BY pair_id ORDER BY idx)), b AS (SELECT pair_id, s.s, idx // s.s AS seg, count(*) AS n, regr_sxx(idx, idx) AS tt, regr_sxy(x, idx) AS tx, regr_sxy(y, idx) AS ty, covar_pop(x, x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy, covar_pop(y, y) * count(*) AS yy FROM p, (SELECT unnest([4, 8, 16])::BIGINT AS s) s GROUP BY ALL HAVING count(*) = s.s), f AS (SELECT pair_id, s, avg((xx - tx * tx / tt) / n) AS fxx, avg((xy - tx * ty / tt) / n) AS fxy, avg((yy - ty * ty / tt) / n) AS fyy FROM b GROUP BY ALL)"


@query(_PRO + " SELECT pair_id, s, round(fxy, 7) + 0e0 AS f2_xy, round(fxy / sqrt(fxx * fyy), 6) + 0e0 AS rho FROM f", "pair_emb")
def cpl_dcca(spark, d):
    return rounded(ft.dcca(pair_emb(spark, d), SCALES, P), "rho").withColumn("f2_xy", F.round("f2_xy", 7) + 0.0)


@query(_PRO + ", e AS (SELECT pair_id, regr_slope(ln(sqrt(fxx)), ln(s)) AS a, regr_slope(ln(sqrt(fyy)), ln(s)) AS b FROM f GROUP BY pair_id) SELECT pair_id, round(1 - abs(a - b), 6) + 0e0 AS match FROM e", "pair_emb")
def cpl_exponent_matching(spark, d):
    return rounded(cp.exponent_matching(ft.dfa(cp.sides(pair_emb(spark, d)), SCALES, ["pair_id", "side"]), "alpha"), "match")


@query(_PRO + " SELECT pair_id, round(corr(ln(sqrt(fxx)), ln(sqrt(fyy))), 6) + 0e0 AS match FROM f GROUP BY pair_id", "pair_emb")
def cpl_fluctuation_matching(spark, d):
    return rounded(cp.curve_matching(ft.dfa_curve(cp.sides(pair_emb(spark, d)), SCALES, ["pair_id", "side"]), "s", F.ln("f")), "match")


_CX = ", z AS (SELECT pair_id, idx, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y FROM pair_emb WINDOW w AS (PARTITION BY pair_id)), t AS (SELECT pair_id, idx, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c, y AS d, lead(y) OVER w AS e, lead(y, 2) OVER w AS f FROM z WINDOW w AS (PARTITION BY pair_id ORDER BY idx)), m AS (SELECT t.pair_id, count(*) AS n_short, count(*) FILTER (abs(t.c - u.f) < 0.3) AS n_long FROM t JOIN t u ON t.pair_id = u.pair_id AND abs(t.a - u.d) < 0.3 AND abs(t.b - u.e) < 0.3 WHERE t.c IS NOT NULL AND u.f IS NOT NULL GROUP BY t.pair_id)"


@query(_CX + " SELECT p.pair_id, coalesce(n_short, 0)::BIGINT AS n_short, coalesce(n_long, 0)::BIGINT AS n_long, CASE WHEN n_long > 0 THEN round(-ln(n_long / n_short), 6) + 0e0 END AS sampen FROM (SELECT DISTINCT pair_id FROM pair_emb) p LEFT JOIN m USING (pair_id)", "pair_emb")
def cpl_cross_sample_entropy(spark, d):
    return rounded(ft.cross_sample_entropy(pair_emb(spark, d), 2, 0.3, P), "sampen")


@query(None)
def cpl_multiscale_cross_entropy(spark, d):
    return rounded(ft.multiscale_cross_entropy(pair_emb(spark, d), [1, 2, 4], 2, 0.3, P), "sampen")


@query(None)
def cpl_complexity(spark, d):
    return rounded(cp.complexity_coupling(pair_emb(spark, d), 32, 8, [4, 8]), "match")


@query(None)
def cpl_mse_matching(spark, d):
    curves = ft.multiscale_entropy(cp.sides(pair_emb(spark, d)), [1, 2, 3], 2, 0.3, ["pair_id", "side"])
    return rounded(cp.curve_matching(curves, "scale", F.col("sampen"), P), "match")


_U = "cast('0x' || substr(md5(concat_ws(':', {0})), 1, 8) AS BIGINT)"
_SH = ", s AS (SELECT pair_id, i.range AS surrogate, CASE WHEN i.range = 0 THEN 0 ELSE 3 + " + _U.format("pair_id, i.range") + " % 59 END AS shift FROM (SELECT DISTINCT pair_id FROM pair_emb), range(0, 20) i), moved AS (SELECT a.pair_id, surrogate, a.idx, a.x, b.y FROM pair_emb a JOIN s ON a.pair_id = s.pair_id JOIN pair_emb b ON b.pair_id = a.pair_id AND b.idx = (a.idx - shift + 64) % 64)"


@query(_SH + " SELECT * FROM moved", "pair_emb")
def surr_shift(spark, d):
    return su.time_shifted(pair_emb(spark, d), 19, P)


@query(_SH + ", v AS (SELECT pair_id, surrogate, round(abs(corr(x, y)), 9) AS v FROM moved GROUP BY ALL), o AS (SELECT *, max(v) FILTER (surrogate = 0) OVER (PARTITION BY pair_id) AS o FROM v), g AS (SELECT pair_id, max(o) AS observed, avg(v) FILTER (surrogate > 0) AS m, stddev_pop(v) FILTER (surrogate > 0) AS s, quantile_cont(v, [0.025, 0.95, 0.975]) FILTER (surrogate > 0) AS q, (count(*) FILTER (surrogate > 0 AND v >= o) + 1) / (count(*) FILTER (surrogate > 0) + 1e0) AS p FROM o GROUP BY pair_id) SELECT pair_id, round(observed, 6) AS observed, round(m, 6) AS null_mean, round(s, 6) AS null_std, round(q[1], 6) AS p2_5, round(q[2], 6) AS p95, round(q[3], 6) AS p97_5, round(p, 6) AS p, round((observed - m) / s, 4) + 0e0 AS z FROM g", "pair_emb")
def surr_test(spark, d):
    v = su.time_shifted(pair_emb(spark, d), 19, P).groupBy("pair_id", "surrogate").agg(F.round(F.abs(F.corr("x", "y")), 9).alias("value"))
    return rounded(su.surrogate_test(v, P), "observed", "null_mean", "null_std", "p2_5", "p95", "p97_5", "p").withColumn("z", F.round("z", 4) + 0.0)


@query(_BIN + ", sh AS (SELECT pair_id, i.range AS surrogate, CASE WHEN i.range = 0 THEN 0 ELSE 3 + " + _U.format("pair_id, i.range") + " % 59 END AS shift FROM (SELECT DISTINCT pair_id FROM pair_emb), range(0, 20) i), moved AS (SELECT a.pair_id, surrogate, a.x, b.y FROM bins a JOIN sh ON a.pair_id = sh.pair_id JOIN bins b ON b.pair_id = a.pair_id AND b.idx = (a.idx - shift + 64) % 64), n AS (SELECT pair_id, surrogate, x, y, count(*)::DOUBLE AS n FROM moved GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, surrogate, x) AS nx, sum(n) OVER (PARTITION BY pair_id, surrogate, y) AS ny, sum(n) OVER (PARTITION BY pair_id, surrogate) AS total FROM n), v AS (SELECT pair_id, surrogate, round(sum(n / total * ln(n * total / (nx * ny))), 9) AS v FROM m GROUP BY ALL), o AS (SELECT *, max(v) FILTER (surrogate = 0) OVER (PARTITION BY pair_id) AS o FROM v) SELECT pair_id, round(max(o), 6) + 0e0 AS mi_nats, round(max(o) - avg(v) FILTER (surrogate > 0), 6) + 0e0 AS effective_mi, (count(*) FILTER (surrogate > 0 AND v >= o) + 1) / (count(*) FILTER (surrogate > 0) + 1e0) AS p FROM o GROUP BY pair_id", "pair_emb")
def surr_effective_mi(spark, d):
    """Binned mutual information less its mean over shifted surrogates."""
    v = cp.mutual_information(su.time_shifted(cp.binned(pair_emb(spark, d), 4), 19, P), ["pair_id", "surrogate"])
    t = su.surrogate_test(v.withColumn("value", F.round("mi_nats", 9)), P)
    return t.select("pair_id", r6("observed").alias("mi_nats"), r6(F.col("observed") - F.col("null_mean")).alias("effective_mi"), "p")


_DIFF = ", diffs AS (SELECT grp, series_id AS subject, idx, x - 0.02e0 * (idx % 16 > 8)::INT AS diff FROM sig_emb)"


@query(_DIFF + ", v AS (SELECT grp, p.range AS perm, idx, diff * CASE WHEN p.range > 0 AND " + _U.format("subject, p.range") + " >= 2147483648 THEN -1e0 ELSE 1e0 END AS d FROM diffs, range(0, 51) p), t AS (SELECT grp, perm, idx, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM v GROUP BY ALL), h AS (SELECT *, sign(t) AS s, idx - row_number() OVER (PARTITION BY grp, perm, sign(t) ORDER BY idx) AS g FROM t WHERE abs(t) > 2), c AS (SELECT grp, perm, s, g, min(idx) AS first, max(idx) AS last, sum(t) AS mass FROM h GROUP BY ALL), m AS (SELECT grp, perm, max(abs(mass)) AS top FROM c WHERE perm > 0 GROUP BY ALL) SELECT c.grp, first, last, round(mass, 5) + 0e0 AS mass, round((count(*) FILTER (round(top, 9) >= round(abs(mass), 9)) + 1) / 51e0, 6) AS p FROM c LEFT JOIN m USING (grp) WHERE c.perm = 0 GROUP BY c.grp, first, last, mass", "sig_emb")
def perm_cluster(spark, d):
    diffs = sig_emb(spark, d).select("grp", F.col("series_id").alias("subject"), "idx", (F.col("x") - 0.02 * (F.col("idx") % 16 > 8).cast("int")).alias("diff"))
    return rounded(su.cluster_test_paired(diffs, 50, 2.0, ["grp"]), "p").withColumn("mass", F.round("mass", 5) + 0.0)


@query(", v AS (SELECT series_id AS subject, (grp >= 5)::INT AS grp, idx, x FROM sig_emb), people AS (SELECT subject, grp, p.range AS perm, row_number() OVER (PARTITION BY p.range ORDER BY " + _U.format("subject, p.range") + ", subject) AS o, count(*) FILTER (grp = 0) OVER (PARTITION BY p.range) AS n0 FROM (SELECT DISTINCT subject, grp FROM v), range(0, 21) p), w AS (SELECT perm, idx, x, CASE WHEN perm = 0 THEN people.grp ELSE (o > n0)::INT END AS g FROM v JOIN people USING (subject)), t AS (SELECT perm, idx, (avg(x) FILTER (g = 0) - avg(x) FILTER (g = 1)) / sqrt(var_samp(x) FILTER (g = 0) / count(*) FILTER (g = 0) + var_samp(x) FILTER (g = 1) / count(*) FILTER (g = 1)) AS t FROM w GROUP BY ALL), h AS (SELECT *, sign(t) AS s, idx - row_number() OVER (PARTITION BY perm, sign(t) ORDER BY idx) AS g FROM t WHERE abs(t) > 1.5), c AS (SELECT perm, s, g, min(idx) AS first, max(idx) AS last, sum(t) AS mass FROM h GROUP BY ALL), m AS (SELECT perm, max(abs(mass)) AS top FROM c WHERE perm > 0 GROUP BY ALL) SELECT first, last, round(mass, 5) + 0e0 AS mass, round((count(*) FILTER (round(top, 9) >= round(abs(mass), 9)) + 1) / 21e0, 6) AS p FROM c LEFT JOIN m ON true WHERE c.perm = 0 GROUP BY first, last, mass", "sig_emb")
def perm_cluster_two_sample(spark, d):
    v = sig_emb(spark, d).select(F.col("series_id").alias("subject"), (F.col("grp") >= 5).cast("int").alias("grp"), "idx", "x")
    return rounded(su.cluster_test_two_sample(v, 20, 1.5), "p").withColumn("mass", F.round("mass", 5) + 0.0)


def _peak_statistic(spark, d):
    """Click against other activity per user bucket: gap fill, windowed lag search, peak, Fisher z, t against 0."""
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"])
    base = h.filter("channel = 'click'").select("series_id", "idx", "x")
    other = h.filter("channel <> 'click'").select("series_id", "idx", "channel", F.col("x").alias("y"))
    pairs = other.join(base, ["series_id", "idx"])
    keys = ["series_id", "channel"]
    top = cp.peaks(cp.windowed_xcorr(pairs, 48, 24, 6, keys), [*keys, "w"])
    subject = top.groupBy(*keys).agg(F.avg(S.fisher_z("peak_r")).alias("z"), F.avg("peak_lag").alias("lag"))
    return st.t_one_sample(subject, ["channel"], "z", with_p=False)


@query(_FILL + ", pairs AS (SELECT a.series_id, b.channel, a.idx, a.x, b.x AS y FROM filled a JOIN filled b ON a.series_id = b.series_id AND a.idx = b.idx AND a.channel = 'click' AND b.channel <> 'click'), w AS (SELECT series_id, channel, w.w, idx - w.w * 24 AS pos, x, y FROM pairs, (SELECT range AS w FROM range(29)) w WHERE idx >= w.w * 24 AND idx < w.w * 24 + 48), z AS (SELECT series_id, channel, w, pos, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, stddev_pop(x) OVER g AS sx, stddev_pop(y) OVER g AS sy FROM w WINDOW g AS (PARTITION BY series_id, channel, w)), xc AS (SELECT a.series_id, a.channel, a.w, l.range AS lag, sum(a.x * b.y) / (any_value(a.sx) * any_value(a.sy) * 48 + 1e-12) AS r FROM z a, range(-6, 7) l, z b WHERE a.series_id = b.series_id AND a.channel = b.channel AND a.w = b.w AND b.pos = a.pos - l.range GROUP BY a.series_id, a.channel, a.w, l.range), p AS (SELECT series_id, channel, w, arg_max(r, (round(r, 9), -lag)) AS r FROM xc GROUP BY ALL), s AS (SELECT series_id, channel, avg(atanh(greatest(least(r, 0.9999), -0.9999))) AS z FROM p GROUP BY ALL) SELECT channel, count(z)::BIGINT AS n, round(avg(z), 6) AS mean, round(avg(z) / (stddev_samp(z) / sqrt(count(z))), 5) AS t, (count(z) - 1)::DOUBLE AS df FROM s GROUP BY channel", "sig_hourly")
def cpl_peak_statistic(spark, d):
    return rounded(_peak_statistic(spark, d), "mean").withColumn("t", F.round("t", 5))


@query(None)
def cpl_peak_significance(spark, d):
    """The flagship: which activities couple with clicks, with p and its correction over activities."""
    tested = _peak_statistic(spark, d)
    return st.bh_fdr(tested.withColumn("p", special.t_p("t", "df")), spread=False).select("channel", "n", r6("mean").alias("mean_z"), r6("t").alias("t"), r6("p").alias("p"), r6("p_fdr").alias("p_fdr"))
