"""Queries on spectra and on per-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft, series as op, spectral as sp
from .registry import pair_emb, query, r6, rounded, sig_emb, sig_events, table

G = ["grp", "series_id"]
_SEG = ", s AS (SELECT grp, series_id, w.w, idx - w.w * 16 AS pos, x FROM sig_emb, (SELECT range AS w FROM range(3)) w WHERE idx >= w.w * 16 AND idx < w.w * 16 + 32), h AS (SELECT grp, series_id, w, pos, (x - avg(x) OVER (PARTITION BY series_id, w)) * (0.5e0 - 0.5e0 * cos(pos * 2 * pi() / 32)) AS x FROM s)"
_PSD = _SEG + ", b AS (SELECT grp, series_id, w, k.range AS k, sum(x * cos(k.range * pos * 2 * pi() / 32)) AS re, sum(x * sin(k.range * pos * 2 * pi() / 32)) AS im FROM h, range(17) k GROUP BY ALL), psd AS (SELECT grp, series_id, k, k * 2e0 AS f, avg(CASE WHEN k IN (0, 16) THEN 1e0 ELSE 2e0 END * (re * re + im * im) / (64 * 12e0)) AS p FROM b GROUP BY ALL)"
SCALES = [4, 8, 16, 32]


def _psd(spark, d):
    return sp.welch(sig_emb(spark, d), 32, 16, 64.0, G)


@query("SELECT series_id, k.range AS k, round(sum(x * cos(2 * pi() * k.range * idx / 64)), 6) + 0e0 AS re_x, round(-sum(x * sin(2 * pi() * k.range * idx / 64)), 6) + 0e0 AS im_x FROM sig_emb, range(1, 9) k GROUP BY ALL", "sig_emb")
def spec_dft(spark, d):
    return rounded(sp.dft(sig_emb(spark, d), 64, range(1, 9), ["series_id"]), "re_x", "im_x")


@query(_PSD + " SELECT grp, series_id, k, f, round(p, 7) AS p FROM psd", "sig_emb")
def spec_welch(spark, d):
    return _psd(spark, d).withColumn("p", F.round("p", 7))


@query(_PSD + ", t AS (SELECT *, lead(f) OVER w AS nf, (lead(f) OVER w - f) * (lead(p) OVER w + p) / 2 AS a FROM psd WINDOW w AS (PARTITION BY series_id ORDER BY k)), u AS (SELECT *, sum(a) OVER (PARTITION BY series_id) AS total FROM t), bands AS (FROM (VALUES ('low', 2e0, 8e0), ('mid', 8e0, 20e0), ('high', 20e0, 32e0)) v(band, low, high)) SELECT grp, series_id, band, round(sum(a), 6) AS power, round(sum(a) / max(total), 6) AS relative FROM u JOIN bands ON f >= low AND nf <= high GROUP BY ALL", "sig_emb")
def spec_bandpower(spark, d):
    bands = spark.createDataFrame([("low", 2.0, 8.0), ("mid", 8.0, 20.0), ("high", 20.0, 32.0)], "band string, low double, high double")
    return rounded(sp.band_powers(_psd(spark, d), bands, G), "power", "relative")


@query(_PSD + " SELECT grp, series_id, arg_max(f, (round(p, 12), -k)) AS peak_f, round(arg_max(p, (round(p, 12), -k)), 6) AS peak_p FROM psd WHERE f BETWEEN 2 AND 30 GROUP BY ALL", "sig_emb")
def spec_peak(spark, d):
    return rounded(sp.peak_frequency(_psd(spark, d), 2.0, 30.0, G), "peak_p")


@query(_PSD + ", q AS (SELECT grp, series_id, p / sum(p) OVER (PARTITION BY series_id) AS q FROM psd) SELECT grp, series_id, round(-sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2(count(*)), 6) AS entropy FROM q GROUP BY ALL", "sig_emb")
def ent_spectral(spark, d):
    return rounded(sp.spectral_entropy(_psd(spark, d), G), "entropy")


@query(_PSD + ", q AS (SELECT grp, k, p / sum(p) OVER (PARTITION BY series_id) AS q FROM psd) SELECT grp, k, round(avg(q), 6) AS mean, round(stddev_samp(q) / sqrt(count(q)), 6) AS sem, round(quantile_cont(q, 0.25), 6) AS q25, round(quantile_cont(q, 0.5), 6) AS median, round(quantile_cont(q, 0.75), 6) AS q75 FROM q GROUP BY ALL", "sig_emb")
def spec_group_mean(spark, d):
    return rounded(sp.group_spectrum(_psd(spark, d), ["grp"], G), "mean", "sem", "q25", "median", "q75")


@query(_PSD + ", l AS (SELECT *, log10(f) AS lf, log10(p) AS lp FROM psd WHERE f BETWEEN 2 AND 30 AND p > 0), r AS (SELECT *, lp - (regr_slope(lp, lf) OVER w * lf + regr_intercept(lp, lf) OVER w) AS r FROM l WINDOW w AS (PARTITION BY series_id)), c AS (SELECT series_id, quantile_cont(r, 0.75) AS cut FROM r GROUP BY series_id), u AS (SELECT r.*, CASE WHEN r <= cut + 1e-9 THEN lp END AS y, CASE WHEN r <= cut + 1e-9 THEN lf END AS x FROM r JOIN c USING (series_id)), f AS (SELECT *, regr_slope(y, x) OVER w AS s, regr_intercept(y, x) OVER w AS b, regr_r2(y, x) OVER w AS r2 FROM u WINDOW w AS (PARTITION BY series_id)), e AS (SELECT *, lp - (s * lf + b) AS e FROM f), sd AS (SELECT *, sqrt(avg(e * e) OVER (PARTITION BY series_id)) AS sd, round(e, 9) AS e9 FROM e), t AS (SELECT *, e9 > coalesce(lag(e9) OVER w, e9 - 1) AND e9 > coalesce(lead(e9) OVER w, e9 - 1) AND e > 2 * sd AS top FROM sd WINDOW w AS (PARTITION BY series_id ORDER BY k)) SELECT grp, series_id, round(max(b), 5) + 0e0 AS \"offset\", round(-max(s), 5) + 0e0 AS exponent, round(max(r2), 5) AS r2, round(max(sd), 5) AS error, count(*) FILTER (top)::BIGINT AS n_peaks FROM t GROUP BY ALL", "sig_emb")
def spec_aperiodic(spark, d):
    a = sp.aperiodic(_psd(spark, d), 2.0, 30.0, G)
    return a.withColumns({c: F.round(c, 5) + 0.0 for c in ("offset", "exponent", "r2", "error")})


@query(_PSD + ", m AS (SELECT grp, k, f, avg(p) AS p FROM psd GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(p, 12) DESC, k) AS place FROM m) SELECT grp, k, f, round(p, 7) AS p, place FROM o WHERE place <= 5", "sig_emb")
def spec_top_freq(spark, d):
    return sp.top_frequencies(_psd(spark, d), 5, ["grp"]).withColumn("p", F.round("p", 7))


_COH = ", s AS (SELECT pair_id, w.w, idx - w.w * 8 AS pos, x, y FROM pair_emb, (SELECT range AS w FROM range(7)) w WHERE idx >= w.w * 8 AND idx < w.w * 8 + 16), h AS (SELECT pair_id, w, pos, (x - avg(x) OVER g) * (0.5e0 - 0.5e0 * cos(pos * 2 * pi() / 16)) AS x, (y - avg(y) OVER g) * (0.5e0 - 0.5e0 * cos(pos * 2 * pi() / 16)) AS y FROM s WINDOW g AS (PARTITION BY pair_id, w)), b AS (SELECT pair_id, w, k.range AS k, sum(x * cos(k.range * pos * 2 * pi() / 16)) AS xr, -sum(x * sin(k.range * pos * 2 * pi() / 16)) AS xi, sum(y * cos(k.range * pos * 2 * pi() / 16)) AS yr, -sum(y * sin(k.range * pos * 2 * pi() / 16)) AS yi FROM h, range(9) k GROUP BY ALL), coh AS (SELECT pair_id, k, k * 4e0 AS f, (avg(xr * yr + xi * yi) ** 2 + avg(xi * yr - xr * yi) ** 2) / nullif(avg(xr * xr + xi * xi) * avg(yr * yr + yi * yi), 0) AS c FROM b GROUP BY ALL)"


@query(_COH + " SELECT pair_id, k, f, round(c, 6) AS c FROM coh", "pair_emb")
def spec_coherence(spark, d):
    return rounded(sp.coherence(pair_emb(spark, d), 16, 8, 64.0, ["pair_id"]), "c")


@query(_COH + " SELECT pair_id, round(avg(c), 6) AS mean, round(arg_max(c, (round(c, 9), -k)), 6) AS peak, arg_max(f, (round(c, 9), -k)) AS peak_f FROM coh WHERE f BETWEEN 4 AND 20 GROUP BY ALL", "pair_emb")
def spec_coherence_band(spark, d):
    n = sp.segment_length(64, 64.0, 4.0, 20.0)
    return rounded(sp.band_coherence(sp.coherence(pair_emb(spark, d), n, n // 2, 64.0, ["pair_id"]), 4.0, 20.0, ["pair_id"]), "mean", "peak")


@query(", p AS (SELECT grp, series_id, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)), n AS (SELECT grp, series_id, a <= b AS p, b <= c AS q, a <= c AS r, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY ALL), q AS (SELECT grp, series_id, n / sum(n) OVER (PARTITION BY series_id) AS q FROM n) SELECT grp, series_id, round(-sum(q * log2(q)) / log2(6), 6) + 0e0 AS entropy FROM q GROUP BY ALL", "sig_emb")
def ent_perm(spark, d):
    return rounded(ft.permutation_entropy(sig_emb(spark, d), 3, 1, G), "entropy")


_T = ", t AS (SELECT grp, series_id, idx, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c, 0.2e0 * stddev_pop(x) OVER (PARTITION BY series_id) AS r FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)), m AS (SELECT t.series_id, count(*) AS n_short, count(*) FILTER (abs(t.c - u.c) < t.r) AS n_long FROM t JOIN t u ON t.series_id = u.series_id AND t.idx < u.idx AND abs(t.a - u.a) < t.r AND abs(t.b - u.b) < t.r WHERE t.c IS NOT NULL AND u.c IS NOT NULL GROUP BY t.series_id)"


@query(_T + " SELECT s.grp, s.series_id, coalesce(n_short, 0)::BIGINT AS n_short, coalesce(n_long, 0)::BIGINT AS n_long, CASE WHEN n_long > 0 THEN round(-ln(n_long / n_short), 6) + 0e0 END AS sampen FROM (SELECT DISTINCT grp, series_id FROM sig_emb) s LEFT JOIN m USING (series_id)", "sig_emb")
def ent_sample(spark, d):
    return rounded(ft.sample_entropy(sig_emb(spark, d), keys=G), "sampen")


@query(", sd AS (SELECT series_id, stddev_pop(x) * 0.2e0 AS r FROM sig_emb GROUP BY series_id), z AS (SELECT series_id, s.s AS scale, idx // s.s AS idx, avg(x) AS x FROM sig_emb, (SELECT unnest([1, 2, 3])::BIGINT AS s) s GROUP BY ALL HAVING count(*) = s.s), t AS (SELECT z.series_id, scale, idx, r, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM z JOIN sd USING (series_id) WINDOW w AS (PARTITION BY series_id, scale ORDER BY idx)), m AS (SELECT t.series_id, t.scale, count(*) AS n_short, count(*) FILTER (abs(t.c - u.c) < t.r) AS n_long FROM t JOIN t u ON t.series_id = u.series_id AND t.scale = u.scale AND t.idx < u.idx AND abs(t.a - u.a) < t.r AND abs(t.b - u.b) < t.r WHERE t.c IS NOT NULL AND u.c IS NOT NULL GROUP BY ALL) SELECT s.series_id, s.scale, coalesce(n_short, 0)::BIGINT AS n_short, coalesce(n_long, 0)::BIGINT AS n_long, CASE WHEN n_long > 0 THEN round(-ln(n_long / n_short), 6) + 0e0 END AS sampen FROM (SELECT DISTINCT series_id, scale FROM z) s LEFT JOIN m ON s.series_id = m.series_id AND s.scale = m.scale", "sig_emb")
def ent_multiscale(spark, d):
    return rounded(ft.multiscale_entropy(sig_emb(spark, d), [1, 2, 3]), "sampen")


@query(", t AS (SELECT series_id, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)) SELECT series_id, round(sum(a * a), 6) AS g00, round(sum(a * b), 6) + 0e0 AS g01, round(sum(a * c), 6) + 0e0 AS g02, round(sum(b * b), 6) AS g11, round(sum(b * c), 6) + 0e0 AS g12, round(sum(c * c), 6) AS g22 FROM t WHERE c IS NOT NULL GROUP BY series_id", "sig_emb")
def ent_svd_gram(spark, d):
    return rounded(ft.svd_gram(sig_emb(spark, d)), "g00", "g01", "g02", "g11", "g12", "g22")


@query(", s AS (SELECT series_id, abs(x - lag(x) OVER w) AS d, abs(x - first_value(x) OVER w) AS far FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)), g AS (SELECT series_id, sum(d) AS l, avg(d) AS a, max(far) AS m FROM s GROUP BY series_id) SELECT series_id, round(log10(l / a) / (log10(l / a) + log10(m / l)), 6) AS fd FROM g", "sig_emb")
def frac_katz(spark, d):
    return rounded(ft.katz(sig_emb(spark, d)), "fd")


@query(", s AS (SELECT series_id, idx, x - lag(x) OVER w AS d FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)), t AS (SELECT series_id, sign(d) * sign(lag(d) OVER w) < 0 AS turn FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)), g AS (SELECT series_id, count(*)::DOUBLE AS n, count(*) FILTER (turn) AS t FROM t GROUP BY series_id) SELECT series_id, round(log10(n) / (log10(n) + log10(n / (n + 0.4e0 * t))), 6) AS fd FROM g", "sig_emb")
def frac_petrosian(spark, d):
    return rounded(ft.petrosian(sig_emb(spark, d)), "fd")


@query(", s AS (SELECT series_id, k.k, idx % k.k AS m, abs(x - lag(x) OVER (PARTITION BY series_id, k.k, idx % k.k ORDER BY idx)) AS d FROM sig_emb, (SELECT range AS k FROM range(1, 9)) k), g AS (SELECT series_id, k, m, sum(d) * 63 / (count(d) * k) / k AS l FROM s GROUP BY series_id, k, m HAVING count(d) > 0), c AS (SELECT series_id, k, avg(l) AS l FROM g GROUP BY ALL HAVING avg(l) > 0) SELECT series_id, round(regr_slope(ln(l), ln(1e0 / k)), 6) AS fd FROM c GROUP BY series_id", "sig_emb")
def frac_higuchi(spark, d):
    return rounded(ft.higuchi(sig_emb(spark, d)), "fd")


@query(", a AS (SELECT series_id, idx, x, x - lag(x) OVER w AS d FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)), b AS (SELECT *, d - lag(d) OVER w AS e FROM a WINDOW w AS (PARTITION BY series_id ORDER BY idx)), g AS (SELECT series_id, var_pop(x) AS v, var_pop(d) AS v1, var_pop(e) AS v2 FROM b GROUP BY series_id) SELECT series_id, round(v, 6) AS activity, round(sqrt(v1 / v), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v), 6) AS complexity FROM g", "sig_emb")
def feat_hjorth(spark, d):
    return rounded(ft.hjorth(sig_emb(spark, d)), "activity", "mobility", "complexity")


_DFA = ", c AS (SELECT series_id, idx, x - avg(x) OVER (PARTITION BY series_id) AS c FROM sig_emb), p AS (SELECT series_id, idx, sum(c) OVER (PARTITION BY series_id ORDER BY idx) AS x FROM c), b AS (SELECT series_id, s.s, idx // s.s AS seg, (regr_syy(x, idx) - regr_sxy(x, idx) ** 2 / regr_sxx(x, idx)) / count(*) AS v FROM p, (SELECT unnest([4, 8, 16, 32])::BIGINT AS s) s GROUP BY ALL HAVING count(*) = s.s), dfa AS (SELECT series_id, s, sqrt(greatest(avg(v), 0)) AS f FROM b GROUP BY ALL)"


@query(_DFA + " SELECT series_id, s, round(f, 6) AS f FROM dfa", "sig_emb")
def frac_dfa_curve(spark, d):
    return rounded(ft.dfa_curve(sig_emb(spark, d), SCALES), "f")


@query(_DFA + " SELECT series_id, round(regr_slope(ln(f), ln(s)), 6) AS alpha FROM dfa WHERE f > 0 GROUP BY series_id", "sig_emb")
def frac_dfa(spark, d):
    return rounded(ft.dfa(sig_emb(spark, d), SCALES), "alpha")


@query(", c AS (SELECT series_id, s.s, idx // s.s AS seg, idx, x, x - avg(x) OVER (PARTITION BY series_id, s.s, idx // s.s) AS c FROM sig_emb, (SELECT unnest([8, 16, 32])::BIGINT AS s) s), p AS (SELECT *, sum(c) OVER (PARTITION BY series_id, s, seg ORDER BY idx) AS p FROM c), g AS (SELECT series_id, s, seg, (max(p) - min(p)) / nullif(stddev_samp(x), 0) AS rs FROM p GROUP BY ALL HAVING count(*) = s), m AS (SELECT series_id, s, avg(rs) AS rs FROM g WHERE rs > 0 GROUP BY ALL) SELECT series_id, round(regr_slope(ln(rs), ln(s)), 6) AS hurst FROM m GROUP BY series_id", "sig_emb")
def frac_hurst(spark, d):
    return rounded(ft.hurst(sig_emb(spark, d), [8, 16, 32]), "hurst")


@query(", r AS (SELECT series_id, t_s, (t_s - lag(t_s) OVER w) * 1e3 AS rr FROM sig_events WINDOW w AS (PARTITION BY series_id ORDER BY t_s)), q AS (SELECT *, rr - lag(rr) OVER (PARTITION BY series_id ORDER BY t_s) AS drr FROM r), x AS (SELECT q.*, w.range AS w FROM q, range(0, 31) w WHERE t_s >= w.range * 86400e0 AND t_s < w.range * 86400e0 + 172800) SELECT series_id, w, count(*)::BIGINT AS n_peaks, round(avg(rr), 0) AS mean_rr, round(stddev_samp(rr), 0) AS sdnn, round(sqrt(avg(drr * drr)), 0) AS rmssd, round(1e2 * count(*) FILTER (abs(drr) > 50) / nullif(count(drr), 0), 6) AS pnn50, round(6e4 / avg(rr), 6) AS rate FROM x GROUP BY ALL HAVING count(*) >= 5", "sig_events")
def feat_hrv(spark, d):
    h = ft.heart_rate_windows(sig_events(spark, d), 172800.0, 86400.0, 5)
    return rounded(h, "pnn50", "rate").withColumns({c: F.round(c, 0) for c in ("mean_rr", "sdnn", "rmssd")})


@query(", g AS (SELECT series_id, t_s, lead(t_s) OVER (PARTITION BY series_id ORDER BY t_s) - t_s AS g FROM sig_events) SELECT series_id, t_s + g / 2 AS t, round(60 / nullif(g, 0), 6) AS x FROM g WHERE g IS NOT NULL AND g > 0", "sig_events")
def feat_instantaneous_rate(spark, d):
    return rounded(ft.instantaneous_rate(sig_events(spark, d)), "x")


@query(", r AS (SELECT series_id, t.t AS threshold, idx - row_number() OVER (PARTITION BY series_id, t.t ORDER BY idx) AS g FROM sig_events, (SELECT unnest([10e0, 30e0, 60e0]) AS t) t WHERE x > t.t) SELECT s.series_id, t.t AS threshold, coalesce(n, 0)::BIGINT AS n_runs, round(p50, 6) AS p50, round(p99, 6) AS p99 FROM (SELECT series_id, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99 FROM sig_events GROUP BY series_id) s CROSS JOIN (SELECT unnest([10e0, 30e0, 60e0]) AS t) t LEFT JOIN (SELECT series_id, threshold, count(DISTINCT g) AS n FROM r GROUP BY ALL) n ON n.series_id = s.series_id AND n.threshold = t.t", "sig_events")
def feat_trigger_profile(spark, d):
    from ..operators.align import runs

    e = sig_events(spark, d)
    levels = F.explode(F.array(*map(F.lit, (10.0, 30.0, 60.0)))).alias("threshold")
    found = runs(e.select("*", levels), F.col("x") > F.col("threshold"), ["series_id", "threshold"]).groupBy("series_id", "threshold").agg(F.count("*").alias("n_runs"))
    every = e.groupBy("series_id").agg(F.percentile("x", 0.5).alias("p50"), F.percentile("x", 0.99).alias("p99")).select("*", levels)
    return rounded(every.join(found, ["series_id", "threshold"], "left").fillna(0, ["n_runs"]), "p50", "p99")


@query("SELECT channel, count(*)::BIGINT AS n, count(*) FILTER (x IS NULL)::BIGINT AS n_null, count(*) FILTER (isnan(x))::BIGINT AS n_nan FROM (SELECT 'x' AS channel, x FROM sig_hourly UNION ALL SELECT 'y', CASE WHEN x > 60 THEN 'NaN'::DOUBLE ELSE x END FROM sig_hourly) GROUP BY channel", "sig_hourly")
def feat_null_counts(spark, d):
    from .registry import sig_hourly

    long = sig_hourly(spark, d).select("x", F.when(F.col("x") > 60, F.lit(float("nan"))).otherwise(F.col("x")).alias("y")).unpivot([], ["x", "y"], "channel", "v")
    return long.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count_if(F.isnan("v")).alias("n_nan"))


@query("SELECT g, feature_a, feature_b, round(r, 6) + 0e0 AS r FROM (SELECT l_returnflag AS g, unnest(['quantity', 'quantity', 'quantity', 'discount', 'discount', 'tax']) AS feature_a, unnest(['quantity', 'discount', 'tax', 'discount', 'tax', 'tax']) AS feature_b, unnest([corr(l_quantity, l_quantity), corr(l_quantity, l_discount), corr(l_quantity, l_tax), corr(l_discount, l_discount), corr(l_discount, l_tax), corr(l_tax, l_tax)]) AS r FROM (SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) GROUP BY l_returnflag)")
def feat_correlation_matrix(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")])
    return rounded(ft.correlation_matrix(f, [], ["g"]), "r")
