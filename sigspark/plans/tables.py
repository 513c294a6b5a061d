"""Queries on result tables and frame tables: statistics, grouping, and frames."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scalar as S
from ..operators import features as ft, frames as fr, series as op, spectral as sp, statistics as st
from ..sources import recordings as rec
from .registry import cells, frame_emb, pair_emb, query, r6, rounded, sig_emb, sig_events, table

C5 = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PV = ", pv AS (SELECT l_suppkey AS id, l_returnflag AS fam, ((l_suppkey * 7919 + ascii(l_returnflag) * 31) % 1000) / 1e3 AS p FROM lineitem GROUP BY ALL)"


def _pvalues(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("fam")).distinct()
    return li.withColumn("p", (F.col("id") * 7919 + F.ascii("fam") * 31) % 1000 / 1e3)


@query(_PV + ", k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p) AS k, count(*) OVER (PARTITION BY fam) AS m FROM pv) SELECT id, fam, p, round(least(1, min(p * m / k) OVER (PARTITION BY fam ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_fdr FROM k")
def stat_bh_fdr(spark, d):
    return st.bh_fdr(_pvalues(spark, d), "p", ["fam"], spread=True).withColumn("p_fdr", F.round("p_fdr", 9))


@query(_PV + ", k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p) AS k, count(*) OVER (PARTITION BY fam) AS m FROM pv) SELECT id, fam, p, round(least(1, max(p * (m - k + 1)) OVER (PARTITION BY fam ORDER BY p ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM k")
def stat_holm(spark, d):
    return st.holm(_pvalues(spark, d), "p", ["fam"]).withColumn("p_holm", F.round("p_holm", 9))


@query(", c AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM (SELECT subject, condition, round(value, -2) AS value FROM cells)), r AS (SELECT subject, condition, value, rank() OVER (PARTITION BY subject ORDER BY value) + (count(*) OVER (PARTITION BY subject, value) - 1) / 2e0 AS r FROM c WHERE n = 5), s AS (SELECT sum(s * s) AS ss, max(n) AS n FROM (SELECT condition, sum(r) AS s, count(*) AS n FROM r GROUP BY condition)), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY subject, value)) SELECT n::BIGINT AS n, round((12e0 / (n * 30) * ss - 18e0 * n) / (1 - ties / (n * 120e0)), 6) AS chi2 FROM s, t WHERE n >= 3", "cells")
def stat_friedman(spark, d):
    c = cells(spark, d).withColumn("value", F.round("value", -2))
    return rounded(st.friedman(c, "subject", "condition", 5, with_p=False), "chi2")


_PAIRED = ", p AS (SELECT subject, max(value) FILTER (condition = '1-URGENT') AS a, unnest(['2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS other, unnest([max(value) FILTER (condition = '2-HIGH'), max(value) FILTER (condition = '3-MEDIUM'), max(value) FILTER (condition = '4-NOT SPECIFIED'), max(value) FILTER (condition = '5-LOW')]) AS b FROM cells GROUP BY subject), diffs AS (SELECT subject, other, b - a AS diff FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"


def _diffs(spark, d):
    c = cells(spark, d)
    base = c.filter(F.col("condition") == C5[0]).select("subject", F.col("value").alias("a"))
    return c.filter(F.col("condition") != C5[0]).join(base, "subject").select("subject", F.col("condition").alias("other"), (F.col("value") - F.col("a")).alias("diff"))


@query(_PAIRED + ", a AS (SELECT other, diff, round(abs(diff), -3) AS a FROM diffs WHERE round(diff, -3) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY other ORDER BY a) + (count(*) OVER (PARTITION BY other, a) - 1) / 2e0 AS r FROM a), t AS (SELECT other, sum(t * t * t - t) AS ties FROM (SELECT other, a, count(*) AS t FROM r GROUP BY ALL) GROUP BY other) SELECT other, count(*)::BIGINT AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus, least(sum(CASE WHEN diff > 0 THEN r ELSE 0 END), sum(CASE WHEN diff < 0 THEN r ELSE 0 END)) AS w, any_value(ties)::BIGINT AS ties FROM r JOIN t USING (other) GROUP BY other", "cells")
def stat_wilcoxon(spark, d):
    w = st.signed_rank(_diffs(spark, d).withColumn("diff", F.round("diff", -3)), ["other"], with_p=False)
    return w.select("other", "n", "w_plus", "w_minus", "w", "ties")


@query(_PAIRED + " SELECT other, count(diff)::BIGINT AS n, round(avg(diff), 4) + 0e0 AS mean, round(avg(diff) / (stddev_samp(diff) / sqrt(count(diff))), 6) + 0e0 AS t, (count(diff) - 1)::DOUBLE AS df FROM diffs GROUP BY other", "cells")
def stat_paired_t(spark, d):
    return rounded(st.t_one_sample(_diffs(spark, d), ["other"], with_p=False), "t").withColumn("mean", F.round("mean", 4) + 0.0)


@query(", s AS (SELECT l_shipmode AS k, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_quantity) FILTER (l_returnflag = 'A') AS m1, avg(l_quantity) FILTER (l_returnflag = 'R') AS m2, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS v1, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS v2 FROM (SELECT l_linestatus AS l_shipmode, l_returnflag, l_quantity::DOUBLE AS l_quantity FROM lineitem) GROUP BY ALL) SELECT k, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) + 0e0 AS t, (n1 + n2 - 2)::DOUBLE AS df, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0e0 AS welch_t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 3) AS welch_df FROM s WHERE n1 > 1 AND n2 > 1")
def stat_two_sample_t(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("k"), "l_returnflag", F.col("l_quantity").cast("double").alias("value"))
    a = st.t_two_sample(li, ["k"], "l_returnflag", "A", "R")
    b = st.t_two_sample(li, ["k"], "l_returnflag", "A", "R", welch=True).select("k", r6("t").alias("welch_t"), F.round("df", 3).alias("welch_df"))
    return rounded(a, "t").join(b, "k")


@query(", c AS (SELECT channel, x / 1e1 AS a FROM sig_events), g AS (SELECT channel, count(a) AS n, avg(cos(a)) AS c, avg(sin(a)) AS s FROM c GROUP BY channel) SELECT channel, n::BIGINT AS n, round(atan2(s, c), 6) + 0e0 AS mean_angle, round(sqrt(c * c + s * s), 6) AS resultant, round(least(1, exp(sqrt(1 + 4e0 * n + 4 * (n * n - n * n * (c * c + s * s))) - (1 + 2e0 * n))), 6) AS rayleigh_p FROM g", "sig_events")
def stat_rayleigh(spark, d):
    return rounded(st.circular(sig_events(spark, d).withColumn("a", F.col("x") / 10.0), ["channel"], "a"), "mean_angle", "resultant", "rayleigh_p")


@query(", u AS (SELECT series_id, channel, (t_s - min(t_s) OVER w) / nullif(max(t_s) OVER w - min(t_s) OVER w, 0) AS u, x FROM sig_events WINDOW w AS (PARTITION BY series_id, channel)) SELECT series_id, channel, count(x)::BIGINT AS n, round(regr_slope(x, u), 5) + 0e0 AS slope FROM u GROUP BY ALL HAVING count(x) >= 4", "sig_events")
def stat_slopes(spark, d):
    return st.slopes(sig_events(spark, d), ["series_id", "channel"], "t_s", "x").withColumn("slope", F.round("slope", 5) + 0.0)


@query(", s AS (SELECT grp, series_id, regr_slope(x, idx / 63e0) AS v FROM sig_emb GROUP BY ALL), r AS (SELECT grp, v, rank() OVER (PARTITION BY grp ORDER BY abs(v)) AS r FROM s WHERE v <> 0) SELECT grp, count(*)::BIGINT AS n, sum(CASE WHEN v > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, least(sum(CASE WHEN v > 0 THEN r ELSE 0 END), sum(CASE WHEN v < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY grp", "sig_emb")
def stat_wilcoxon_slopes(spark, d):
    s = st.slopes(sig_emb(spark, d), ["grp", "series_id"], "idx", "x")
    return st.signed_rank(s, ["grp"], "slope", with_p=False).select("grp", "n", "w_plus", "w")


@query(", e AS (SELECT channel, avg(x) FILTER (series_id % 2 = 0) AS a, avg(x) FILTER (series_id % 2 = 1) AS b, var_samp(x) FILTER (series_id % 2 = 0) AS va, var_samp(x) FILTER (series_id % 2 = 1) AS vb, count(x) FILTER (series_id % 2 = 0) AS na, count(x) FILTER (series_id % 2 = 1) AS nb FROM sig_events GROUP BY channel) SELECT channel, round(b - a, 6) + 0e0 AS raw, round((b - a) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) + 0e0 AS cohens_d, round(100 * (b - a) / abs(a), 6) + 0e0 AS percent FROM e", "sig_events")
def stat_effect_size(spark, d):
    e = sig_events(spark, d).withColumn("side", F.when(F.col("series_id") % 2 == 0, "even").otherwise("odd"))
    return rounded(st.effect_size(e, ["channel"], "side", "even", "odd", "x"), "raw", "cohens_d", "percent")


@query(_PAIRED + " SELECT other, count(diff)::BIGINT AS n, count(*) FILTER (diff > 0)::BIGINT AS n_up, round(greatest(count(*) FILTER (diff > 0), count(diff) - count(*) FILTER (diff > 0)) / count(diff), 6) AS consistency FROM diffs GROUP BY other", "cells")
def stat_direction(spark, d):
    return rounded(st.direction(_diffs(spark, d), ["other"]), "consistency")


@query("SELECT grp, idx, round(avg(x), 6) + 0e0 AS mean, round(stddev_pop(x) / sqrt(count(x)), 6) AS sem, count(x)::BIGINT AS n FROM sig_emb GROUP BY grp, idx", "sig_emb")
def stat_trajectory(spark, d):
    return rounded(st.trajectory(sig_emb(spark, d), ["grp", "idx"], "x"), "mean", "sem")


@query(", r AS (SELECT channel, (series_id % 2)::INT AS y, rank() OVER (PARTITION BY channel ORDER BY x) + (count(*) OVER (PARTITION BY channel, x) - 1) / 2e0 AS r FROM sig_events) SELECT channel, round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM r GROUP BY channel", "sig_events")
def stat_auc(spark, d):
    return rounded(st.auc(sig_events(spark, d).withColumn("label", F.col("series_id") % 2), ["channel"], "label", "x"), "auc")


@query(", b AS (SELECT grp, series_id AS subject, idx // 8 AS channel, avg(x) AS value FROM sig_emb GROUP BY ALL), m AS (SELECT *, avg(value) OVER (PARTITION BY grp, subject) AS ms, avg(value) OVER (PARTITION BY grp, channel) AS mc, avg(value) OVER (PARTITION BY grp) AS m FROM b), g AS (SELECT grp, max(m) AS mean, sum((ms - m) ** 2) AS ss, sum((mc - m) ** 2) AS sc, sum((value - ms - mc + m) ** 2) / ((count(DISTINCT subject) - 1) * (count(DISTINCT channel) - 1)) AS e, count(DISTINCT subject) AS a, count(DISTINCT channel) AS c FROM m GROUP BY grp) SELECT grp, round(mean, 6) + 0e0 AS mean, round(e, 8) AS var_error, round(greatest(0, (ss / (a - 1) - e) / c), 8) AS var_subject, round(greatest(0, (sc / (c - 1) - e) / a), 8) AS var_channel FROM g", "sig_emb")
def stat_balanced_components(spark, d):
    b = sig_emb(spark, d).groupBy("grp", F.col("series_id").alias("subject"), F.floor(F.col("idx") / 8).cast("long").alias("channel")).agg(F.avg("x").alias("value"))
    v = st.balanced_components(b, "subject", "channel", keys=["grp"])
    return rounded(v, "mean").withColumns({c: F.round(c, 8) for c in ("var_error", "var_subject", "var_channel")})


@query(", m AS (SELECT series_id, channel, avg(x) AS v FROM sig_events GROUP BY ALL) SELECT channel, round(avg(v), 6) AS mean, count(*)::BIGINT AS n FROM m GROUP BY channel", "sig_events")
def agg_two_level_mean(spark, d):
    return rounded(sig_events(spark, d).groupBy("series_id", "channel").agg(F.avg("x").alias("v")).groupBy("channel").agg(F.avg("v").alias("mean"), F.count("*").alias("n")), "mean")


@query("SELECT subject, " + ", ".join(f"round(max(value) FILTER (condition = '{c}'), 4) AS c{i}" for i, c in enumerate(C5, 1)) + " FROM cells GROUP BY subject", "cells")
def agg_pivot(spark, d):
    p = cells(spark, d).groupBy("subject").pivot("condition", C5).agg(F.max("value"))
    return p.select("subject", *[F.round(F.col(f"`{c}`"), 4).alias(f"c{i}") for i, c in enumerate(C5, 1)])


@query("SELECT o_custkey % 20 AS subject, round(quantile_cont(o_totalprice, 0.5), 4) AS median, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def agg_subject_median(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("subject")).agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.count("*").alias("n"))


@query("SELECT pair_id, w.w, unnest(['x', 'y']) AS metric, round(unnest([avg(x), avg(y)]), 6) + 0e0 AS value FROM pair_emb, (SELECT range AS w FROM range(4)) w WHERE idx // 16 = w.w GROUP BY pair_id, w.w", "pair_emb")
def agg_collected(spark, d):
    """Window values as arrays of a document, then flattened to rows again."""
    g = pair_emb(spark, d).groupBy("pair_id", F.floor(F.col("idx") / 16).cast("long").alias("w")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    document = g.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("w", "x", "y"))).alias("v")).select("pair_id", F.struct(F.col("v.w").alias("w"), F.col("v.x").alias("x"), F.col("v.y").alias("y")).alias("doc"))
    flat = document.select("pair_id", F.inline(F.arrays_zip("doc.w", "doc.x", "doc.y")))
    return rounded(flat.unpivot(["pair_id", "w"], ["x", "y"], "metric", "value"), "value")


@query("SELECT DISTINCT user_id % 8 AS subject, event_type AS condition FROM events")
def agg_distinct_labels(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 8).alias("subject"), F.col("event_type").alias("condition")).distinct()


@query(", r AS (SELECT channel, series_id, idx, x, row_number() OVER (PARTITION BY channel ORDER BY x DESC, series_id, idx) AS place FROM sig_events) SELECT * FROM r WHERE place <= 10", "sig_events")
def agg_top(spark, d):
    place = F.row_number().over(W.partitionBy("channel").orderBy(F.desc("x"), "series_id", "idx"))
    return sig_events(spark, d).select("channel", "series_id", "idx", "x", place.cast("long").alias("place")).filter("place <= 10")


@query(", r AS (SELECT floor(x / 20)::BIGINT AS bucket, series_id, idx, row_number() OVER (PARTITION BY floor(x / 20) ORDER BY cast('0x' || substr(md5(concat_ws(':', series_id, idx)), 1, 8) AS BIGINT), series_id, idx) AS place FROM sig_events) SELECT bucket, series_id, idx FROM r WHERE place <= 5", "sig_events")
def agg_sample_per_range(spark, d):
    b = sig_events(spark, d).withColumn("bucket", F.floor(F.col("x") / 20).cast("long"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(S.uniform("series_id", "idx"), "series_id", "idx"))
    return b.withColumn("_p", place).filter("_p <= 5").select("bucket", "series_id", "idx")


@query("SELECT channel, least(greatest(floor((x - 0) / 10)::BIGINT + 1, 0), 11) AS bin, count(*)::BIGINT AS n FROM sig_events GROUP BY ALL", "sig_events")
def agg_lag_histogram(spark, d):
    return sig_events(spark, d).groupBy("channel", F.width_bucket("x", F.lit(0.0), F.lit(100.0), F.lit(10)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_FR = ", fr AS (SELECT clip, frame, y, px, v FROM frame_emb)"


@query("SELECT clip, frame, y // 2 AS y, px // 2 AS px, round(avg(v), 6) + 0e0 AS v FROM frame_emb WHERE frame % 3 = 0 GROUP BY ALL", "frame_emb")
def vid_thinned(spark, d):
    return rounded(fr.thinned(frame_emb(spark, d), 3, 2), "v")


_HIST = "least(greatest(floor((v + 0.5e0) / (1e0 / {0})), 0), {0} - 1)"


@query(", b AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY clip, y, px ORDER BY frame)) AS d FROM frame_emb), n AS (SELECT clip, frame, " + _HIST.format(16) + " AS b, count(*) AS n FROM frame_emb GROUP BY ALL), h AS (SELECT clip, frame, -sum(n / 64 * log2(n / 64)) AS e FROM n GROUP BY ALL) SELECT b.clip, b.frame, round(avg(v), 6) + 0e0 AS luminance, round(stddev_pop(v), 6) AS contrast, round(avg(d), 6) AS frame_diff, round(any_value(e), 6) + 0e0 AS entropy FROM b JOIN h ON b.clip = h.clip AND b.frame = h.frame GROUP BY b.clip, b.frame", "frame_emb")
def vid_global(spark, d):
    return rounded(fr.global_signals(frame_emb(spark, d), 16, -0.5, 0.5), "luminance", "contrast", "frame_diff", "entropy")


_GRAD = ", nb AS (SELECT *, coalesce(lead(v) OVER a, v) - coalesce(lag(v) OVER a, v) AS dx, coalesce(lead(v) OVER b, v) - coalesce(lag(v) OVER b, v) AS dy FROM frame_emb WINDOW a AS (PARTITION BY clip, frame, y ORDER BY px), b AS (PARTITION BY clip, frame, px ORDER BY y)), gr AS (SELECT clip, frame, y, px, sqrt((coalesce(lag(dx) OVER b, dx) + 2 * dx + coalesce(lead(dx) OVER b, dx)) ** 2 + (coalesce(lag(dy) OVER a, dy) + 2 * dy + coalesce(lead(dy) OVER a, dy)) ** 2) AS g FROM nb WINDOW a AS (PARTITION BY clip, frame, y ORDER BY px), b AS (PARTITION BY clip, frame, px ORDER BY y))"


@query(_GRAD + " SELECT clip, frame, y, px, round(g, 6) AS g FROM gr", "frame_emb")
def vid_gradient(spark, d):
    return rounded(fr.gradient(frame_emb(spark, d)).select("clip", "frame", "y", "px", "g"), "g")


@query(_GRAD + ", c AS (SELECT clip, frame, quantile_cont(g, 0.6) AS cut, avg(g) AS m FROM gr GROUP BY ALL) SELECT gr.clip, gr.frame, round(max(cut), 6) AS cut, round(avg((g > cut)::INT), 6) AS mask, round(avg((g > 2 * m)::INT), 6) AS edges FROM gr JOIN c ON gr.clip = c.clip AND gr.frame = c.frame GROUP BY gr.clip, gr.frame", "frame_emb")
def vid_edges(spark, d):
    return rounded(fr.edge_density(frame_emb(spark, d)), "cut", "mask", "edges")


_S2 = ", fx AS (SELECT clip, frame, y, k.range AS kx, sum(v * cos(k.range * px * 2 * pi() / 8)) AS re, -sum(v * sin(k.range * px * 2 * pi() / 8)) AS im FROM frame_emb, range(8) k GROUP BY ALL), f2 AS (SELECT clip, frame, kx, k.range AS ky, sum(re * cos(k.range * y * 2 * pi() / 8) + im * sin(k.range * y * 2 * pi() / 8)) AS re, sum(im * cos(k.range * y * 2 * pi() / 8) - re * sin(k.range * y * 2 * pi() / 8)) AS im FROM fx, range(8) k GROUP BY ALL), s2 AS (SELECT clip, frame, CASE WHEN ky >= 4 THEN ky - 8 ELSE ky END AS ky, CASE WHEN kx >= 4 THEN kx - 8 ELSE kx END AS kx, re * re + im * im AS p FROM f2)"


@query(_S2 + ", r AS (SELECT clip, frame, floor(sqrt(kx * kx + ky * ky)) AS r, avg(p) AS p FROM s2 WHERE floor(sqrt(kx * kx + ky * ky)) > 0 GROUP BY ALL) SELECT clip, frame, round(regr_slope(ln(p), ln(r)), 5) + 0e0 AS slope FROM r GROUP BY ALL", "frame_emb")
def vid_radial_slope(spark, d):
    return fr.radial_slope(fr.spectrum_2d(frame_emb(spark, d), 8)).withColumn("slope", F.round("slope", 5) + 0.0)


@query(_S2 + ", a AS (SELECT clip, frame, kx, ky, p, 2 * atan2(ky, kx) AS a FROM s2 WHERE kx <> 0 OR ky <> 0) SELECT clip, frame, round(arg_max(sqrt(kx * kx + ky * ky), (round(p, 9), -sqrt(kx * kx + ky * ky))), 6) AS peak_k, round(sqrt(sum(p * cos(a)) ** 2 + sum(p * sin(a)) ** 2) / sum(p), 6) AS anisotropy, round(atan2(sum(p * sin(a)), sum(p * cos(a))) / 2, 4) + 0e0 AS orientation FROM a GROUP BY ALL", "frame_emb")
def vid_fft_shape(spark, d):
    return rounded(fr.spectral_shape(fr.spectrum_2d(frame_emb(spark, d), 8)), "peak_k", "anisotropy").withColumn("orientation", F.round("orientation", 4) + 0.0)


@query(", b AS (SELECT DISTINCT clip, frame, s.s, y // s.s AS y, px // s.s AS px FROM frame_emb, (SELECT unnest([1, 2, 4])::BIGINT AS s) s WHERE v > 0), n AS (SELECT clip, frame, s, count(*) AS n FROM b GROUP BY ALL) SELECT clip, frame, round(-regr_slope(ln(n), ln(s)), 6) + 0e0 AS dimension FROM n GROUP BY ALL", "frame_emb")
def vid_box_counting(spark, d):
    return rounded(fr.box_counting(frame_emb(spark, d), [1, 2, 4], F.col("v") > 0), "dimension")


@query(", side AS (SELECT clip, frame, least(max(y), max(px)) + 1 AS p FROM frame_emb GROUP BY ALL), dark AS (SELECT f.*, unnest(range(1, greatest(p // 2, 1) + 1)) AS s FROM frame_emb f JOIN side USING (clip, frame) WHERE v < 0), n AS (SELECT clip, frame, s, count(DISTINCT (y // s, px // s)) AS n FROM dark GROUP BY ALL), d AS (SELECT clip, frame, -regr_slope(ln(n), ln(s)) AS dimension FROM n GROUP BY ALL) SELECT clip, frame, round(dimension, 6) + 0e0 AS dimension FROM side LEFT JOIN d USING (clip, frame)", "frame_emb")
def vid_dark_dimension(spark, d):
    """Box-counting dimension of what is dark in every frame."""
    return rounded(fr.dark_dimension(frame_emb(spark, d), 0.0), "dimension")


@query(", b AS (SELECT clip, frame, s.s, sum(v + 1) AS m FROM frame_emb, (SELECT unnest([2, 4])::BIGINT AS s) s GROUP BY clip, frame, s.s, y // s.s, px // s.s), l AS (SELECT clip, frame, s, 1 + var_pop(m) / (avg(m) * avg(m)) AS l FROM b GROUP BY ALL) SELECT clip, frame, round(avg(ln(l)), 7) + 0e0 AS lacunarity FROM l GROUP BY ALL", "frame_emb")
def vid_lacunarity(spark, d):
    return fr.lacunarity(frame_emb(spark, d).withColumn("v", F.col("v") + 1), [2, 4]).withColumn("lacunarity", F.round("lacunarity", 7) + 0.0)


@query(", n AS (SELECT clip, frame, y // 4 AS gy, px // 4 AS gx, " + _HIST.format(8) + " AS b, count(*) AS n FROM frame_emb GROUP BY ALL), e AS (SELECT clip, frame, gy, gx, -sum(n / 16 * log2(n / 16)) AS e FROM n GROUP BY ALL) SELECT clip, frame, round(avg(e), 6) + 0e0 AS mean, round(stddev_pop(e), 6) AS sd, round(quantile_cont(e, 0.95), 6) + 0e0 AS p95, round(max(e) - min(e), 6) + 0e0 AS spread FROM e GROUP BY ALL", "frame_emb")
def vid_patch_entropy(spark, d):
    return rounded(fr.field_summary(fr.patch_entropy(frame_emb(spark, d), 4, 8, -0.5, 0.5), "entropy"), "mean", "sd", "p95", "spread")


@query(", q AS (SELECT clip, frame, y, px, " + _HIST.format(8) + " AS q FROM frame_emb), o AS (FROM (VALUES (0, 1), (-1, 1), (-1, 0), (-1, -1)) v(dy, dx)) SELECT a.clip, a.frame, round(avg((a.q - b.q) ** 2), 6) AS contrast, round(avg(1 / (1 + (a.q - b.q) ** 2)), 6) AS homogeneity FROM q a, o, q b WHERE a.clip = b.clip AND a.frame = b.frame AND b.y = a.y + dy AND b.px = a.px + dx GROUP BY a.clip, a.frame", "frame_emb")
def vid_glcm(spark, d):
    return rounded(fr.glcm(frame_emb(spark, d), 8, -0.5, 0.5), "contrast", "homogeneity")


_PX = (
    ", ps AS (SELECT clip, y, px, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v AS x FROM frame_emb), sg AS (SELECT clip, y, px, w.w, idx - w.w * 16 AS pos, x, count(*) OVER (PARTITION BY clip, y, px, w.w) AS n FROM ps, (SELECT unnest(range((SELECT max(idx) // 16 + 1 FROM ps))) AS w) w WHERE idx >= w.w * 16 AND idx < w.w * 16 + 32), "
    "ht AS (SELECT clip, y, px, w, pos, (x - avg(x) OVER (PARTITION BY clip, y, px, w)) * (0.5e0 - 0.5e0 * cos(pos * 2 * pi() / 32)) AS x FROM sg WHERE n = 32), ff AS (SELECT clip, y, px, w, k.range AS k, sum(x * cos(k.range * pos * 2 * pi() / 32)) AS re, sum(x * sin(k.range * pos * 2 * pi() / 32)) AS im FROM ht, range(1, 17) k GROUP BY ALL), "
    "pw AS (SELECT clip, y, px, k, avg(CASE WHEN k = 16 THEN 1e0 ELSE 2e0 END * (re * re + im * im)) AS p FROM ff GROUP BY ALL), pq AS (SELECT *, p / sum(p) OVER (PARTITION BY clip, y, px) AS q FROM pw), pk AS (SELECT clip, y, px, arg_max(k, (round(p / (32 * 12e0), 9), -k))::DOUBLE AS f, -sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 4 AS e, sum(CASE WHEN k BETWEEN 2 AND 8 THEN q ELSE 0 END) AS b FROM pq GROUP BY ALL)"
)


@query(_PX + " SELECT clip, round(avg(f), 6) AS mean_f, round(stddev_pop(f), 6) AS sd_f, round(1 / (1 + stddev_pop(f) / avg(f)), 6) AS sync, round(avg(e), 6) AS entropy, round(avg(b), 6) AS band FROM pk GROUP BY clip", "frame_emb")
def vid_pixel_spectrum(spark, d):
    """Each pixel's mean spectrum over every window of the clip: how far the peak frequencies agree, and the pixels' mean
    spectral entropy and share of a band."""
    s = fr.pixel_spectra(frame_emb(spark, d), 32, 16, 32.0, 2.0, 8.0)
    means = s.groupBy("clip").agg(F.avg("entropy").alias("entropy"), F.avg("band").alias("band"))
    return rounded(fr.synchrony(s, ["clip"], "peak_f").join(means, "clip"), "mean_f", "sd_f", "sync", "entropy", "band")


@query(", ps AS (SELECT clip, y, px, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v AS x FROM frame_emb), s AS (SELECT clip, y, px, abs(x - lag(x) OVER w) AS d, abs(x - first_value(x) OVER w) AS far FROM ps WINDOW w AS (PARTITION BY clip, y, px ORDER BY idx)), g AS (SELECT clip, y, px, sum(d) AS l, avg(d) AS a, max(far) AS m FROM s GROUP BY ALL) SELECT clip, y, px, round(log10(l / a) / (log10(l / a) + log10(m / l)), 6) AS fd FROM g", "frame_emb")
def vid_pixel_complexity(spark, d):
    return rounded(ft.katz(op.passes_quality(fr.pixel_series(frame_emb(spark, d)), ["clip", "y", "px"], 32, 1e-9), ["clip", "y", "px"]), "fd")


@query(", ps AS (SELECT clip, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v FROM frame_emb WHERE px = 3) SELECT clip, idx, round(avg(v), 6) + 0e0 AS x FROM ps GROUP BY ALL", "frame_emb")
def vid_timestack(spark, d):
    return rounded(fr.column_signal(frame_emb(spark, d), 3), "x")


@query(", ps AS (SELECT clip, y, px, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v - avg(v) OVER (PARTITION BY clip, y, px) AS x FROM frame_emb) SELECT a.clip, a.idx AS i, b.idx AS j, round(sum(a.x * b.x), 6) + 0e0 AS g FROM ps a JOIN ps b ON a.clip = b.clip AND a.y = b.y AND a.px = b.px AND a.idx <= b.idx GROUP BY ALL", "frame_emb")
def vid_snapshot_gram(spark, d):
    return rounded(fr.snapshots_gram(frame_emb(spark, d)), "g")


@query(None)
def vid_motion(spark, d):
    return rounded(fr.motion_summary(fr.block_motion(frame_emb(spark, d), 4, 2)), "mean", "p95", "u", "v", "divergence", "curl", "direction_entropy")


@query("SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY text) = doc_id AS first FROM documents")
def src_content_dedup(spark, d):
    """Which row of each group of equal contents is the first."""
    return rec.first_of_equal(table(spark, d, "documents"), F.col("text"), "doc_id").withColumnRenamed("sha256", "h")


@query("SELECT o_orderkey, lpad((o_custkey % 20)::VARCHAR, 2, '0') AS subject, ((o_orderkey % 90) * 60 + o_orderkey % 60)::DOUBLE AS seconds, printf('%02d:%02d', o_orderkey % 90, o_orderkey % 60) AS clock FROM orders")
def src_keys_and_clocks(spark, d):
    o = table(spark, d, "orders")
    text = F.concat_ws(":", (F.col("o_orderkey") % 90).cast("string"), (F.col("o_orderkey") % 60).cast("string"))
    seconds = S.clock_seconds(text)
    return o.select("o_orderkey", S.subject_key(F.concat(F.lit("sub-"), (F.col("o_custkey") % 20).cast("string"))).alias("subject"), seconds.alias("seconds"), S.clock_text(seconds).alias("clock"))
