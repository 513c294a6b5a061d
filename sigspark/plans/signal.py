"""Queries on single series: projection, scaling, windows, resampling, alignment."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scalar as S
from ..operators import align as A, series as op
from .registry import cells, pair_emb, query, r6, rounded, sig_emb, sig_events, sig_hourly, table

E = ["series_id"]
H = ["series_id", "channel"]


@query("SELECT channel, count(x)::BIGINT AS n, round(avg(x), 4) AS mean, max(x) AS largest FROM (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME channel VALUE x) GROUP BY channel")
def sig_select_prefix(spark, d):
    long = op.unpivot_prefix(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), [], "l_")
    return long.groupBy("channel").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.max("x").alias("largest"))


@query("SELECT series_id, channel, count(*)::BIGINT AS n FROM sig_events WHERE channel IN ('click', 'view', 'purchase') AND x > 5 GROUP BY ALL", "sig_events")
def sig_filter(spark, d):
    e = sig_events(spark, d).filter(F.col("channel").isin("click", "view", "purchase") & (F.col("x") > 5))
    return e.groupBy("series_id", "channel").agg(F.count("*").alias("n"))


@query(", g AS (SELECT grp, series_id FROM sig_emb GROUP BY ALL HAVING count(x) = count(*) AND count(x) >= 60 AND stddev_pop(x) > 0.12) SELECT s.grp, count(*)::BIGINT AS n, count(DISTINCT s.series_id)::BIGINT AS n_series FROM sig_emb s SEMI JOIN g ON s.series_id = g.series_id GROUP BY s.grp", "sig_emb")
def sig_quality(spark, d):
    return op.passes_quality(sig_emb(spark, d), ["grp", "series_id"], 60, 0.12).groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series"))


@query(", r AS (SELECT pair_id, corr(x, y) AS r FROM pair_emb GROUP BY pair_id) SELECT pair_id, round(atanh(greatest(least(r, 0.9999), -0.9999)), 6) AS z, round(tanh(atanh(greatest(least(r, 0.9999), -0.9999))), 6) AS back FROM r", "pair_emb")
def sig_fisher_z(spark, d):
    r = pair_emb(spark, d).groupBy("pair_id").agg(F.corr("x", "y").alias("r"))
    return r.select("pair_id", r6(S.fisher_z("r")).alias("z"), r6(S.inverse_fisher_z(S.fisher_z("r"))).alias("back"))


@query("SELECT series_id, idx, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12), 6) + 0e0 AS z FROM sig_emb WINDOW w AS (PARTITION BY series_id)", "sig_emb")
def sig_zscore(spark, d):
    return rounded(op.zscore(sig_emb(spark, d)).select("series_id", "idx", "z"), "z")


@query(", c AS (SELECT series_id, idx, x - avg(x) OVER (PARTITION BY series_id) AS c FROM sig_emb) SELECT series_id, idx, round(c / nullif(max(abs(c)) OVER (PARTITION BY series_id), 0), 6) + 0e0 AS scaled FROM c", "sig_emb")
def sig_max_abs_scale(spark, d):
    return rounded(op.max_abs_scaled(sig_emb(spark, d)).select("series_id", "idx", "scaled"), "scaled")


@query(", c AS (SELECT series_id, idx, log10(1e-8 + greatest(x, 0)) AS l FROM sig_events) SELECT series_id, idx, round((l - min(l) OVER w) / nullif(max(l) OVER w - min(l) OVER w, 0), 6) + 0e0 AS scaled FROM c WINDOW w AS (PARTITION BY series_id)", "sig_events")
def sig_log_minmax(spark, d):
    return rounded(op.log_minmax(sig_events(spark, d)).select("series_id", "idx", "scaled"), "scaled")


@query("SELECT o_orderkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '~' ELSE 'ns' END AS label, CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE printf('p = %.3f', p) END AS p_text FROM (SELECT o_orderkey, (o_orderkey % 997) / 5e3 AS p FROM orders)")
def stat_sig_label(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 997 / 5e3).alias("p"))
    return p.select("o_orderkey", S.significance("p").alias("label"), S.p_text("p").alias("p_text"))


@query("SELECT series_id, idx, round(atan2(sin(x * 40), cos(x * 40)), 6) + 0e0 AS angle FROM sig_emb", "sig_emb")
def sig_angle_wrap(spark, d):
    return sig_emb(spark, d).select("series_id", "idx", r6(S.wrapped(F.col("x") * 40)).alias("angle"))


@query("SELECT CASE WHEN channel IN ('click', 'view') THEN 'REST' WHEN channel IN ('purchase', 'error') THEN 'NATURE' END AS block, count(*)::BIGINT AS n, round(avg(x), 6) AS mean FROM sig_events GROUP BY 1", "sig_events")
def sig_block_label(spark, d):
    block = F.when(F.col("channel").isin("click", "view"), "REST").when(F.col("channel").isin("purchase", "error"), "NATURE")
    return sig_events(spark, d).groupBy(block.alias("block")).agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"))


@query(", p AS (SELECT subject, max(value) FILTER (condition = '1-URGENT') AS a, max(value) FILTER (condition = '5-LOW') AS b FROM cells GROUP BY subject) SELECT subject, round(greatest(least(1e2 * (b - a) / (abs(a) + 1e-10), 500), -500), 6) + 0e0 AS change FROM p WHERE a IS NOT NULL AND b IS NOT NULL", "cells")
def sig_percent_change(spark, d):
    return A.paired(cells(spark, d), "subject", "condition", "1-URGENT", "5-LOW").select("subject", r6(S.percent_change("second", "first")).alias("change"))


@query("SELECT o_orderkey, round(coalesce(log10(greatest(nullif((o_orderkey % 13) / 1e2, 0.05), 1e-300)) - log10(greatest((o_orderkey % 7) / 1e1, 1e-300)), 0), 6) + 0e0 AS score FROM orders")
def sig_directionality(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", r6(S.directionality(F.col("o_orderkey") % 7 / 1e1, F.nullif(F.col("o_orderkey") % 13 / 1e2, F.lit(0.05)))).alias("score"))


@query(", e AS (SELECT series_id, quantile_cont(x, [0.25, 0.5, 0.75]) AS cuts FROM sig_emb GROUP BY series_id) SELECT s.series_id, idx, len(list_filter(cuts, lambda c: c <= x))::BIGINT AS bin FROM sig_emb s JOIN e USING (series_id)", "sig_emb")
def sig_equal_freq_bins(spark, d):
    return op.equal_frequency_bins(sig_emb(spark, d), 4).select("series_id", "idx", "bin")


@query("SELECT series_id, count(*)::BIGINT AS n, least(50, count(*))::BIGINT AS width, greatest(1, least(10, count(*) // 5))::BIGINT AS step FROM sig_events GROUP BY series_id", "sig_events")
def sig_effective_window(spark, d):
    n = sig_events(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", "n", F.least(F.lit(50), "n").cast("long").alias("width"), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n") / 5))).cast("long").alias("step"))


@query("SELECT series_id, 'emb' AS name, 'eeg' AS modality, 256e0 AS fs, 1.5e0 AS t0, 'uV' AS units, idx, idx / 256e0 + 1.5e0 AS t_s, x FROM sig_emb", "sig_emb")
def sig_trace(spark, d):
    return op.trace(sig_emb(spark, d), F.col("series_id"), 256.0, "emb", "eeg", 1.5, "uV")


@query(", f AS (SELECT grp, series_id, avg(x) AS m, stddev_pop(x) AS s FROM sig_emb GROUP BY ALL), u AS (UNPIVOT f ON m, s INTO NAME feature VALUE v) SELECT grp, series_id, feature, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-12), 5) + 0e0 AS z, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 5) + 0e0 AS unit FROM u WINDOW w AS (PARTITION BY feature)", "sig_emb")
def sig_fingerprint(spark, d):
    f = sig_emb(spark, d).groupBy("grp", "series_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).unpivot(["grp", "series_id"], ["m", "s"], "feature", "v")
    w = W.partitionBy("feature")
    z, unit = (F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-12), S.ratio(F.col("v") - F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w))
    return f.select("grp", "series_id", "feature", (F.round(z, 5) + 0.0).alias("z"), (F.round(unit, 5) + 0.0).alias("unit"))


_WIN = ", n AS (SELECT *, max(idx) OVER (PARTITION BY series_id) + 1 AS n FROM sig_emb), w AS (SELECT n.*, w.w, idx - w.w * 8 AS pos FROM n, (SELECT range AS w FROM range(6)) w WHERE idx >= w.w * 8 AND idx < w.w * 8 + 24 AND w.w * 8 + 24 <= n)"


@query(_WIN + " SELECT series_id, w, pos, x FROM w", "sig_emb")
def sig_windows(spark, d):
    return op.exploded_windows(sig_emb(spark, d), 24, 8).select("series_id", "w", "pos", "x")


@query(_WIN + " SELECT series_id, w, round(avg(x), 6) + 0e0 AS mean, round(stddev_pop(x), 6) AS sd, w * 8 / 4e0 AS time_start, (w * 8 + 24) / 4e0 AS time_end, (w * 8 + 12) / 4e0 AS time_centre FROM w GROUP BY series_id, w", "sig_emb")
def sig_window_features(spark, d):
    return rounded(op.windowed(sig_emb(spark, d), 24, 8, [F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")], fs=4.0), "mean", "sd")


@query("SELECT series_id, idx, round(x - lag(x) OVER w, 6) + 0e0 AS d1, round(x - 2 * lag(x) OVER w + lag(x, 2) OVER w, 6) + 0e0 AS d2, round(sum(x) OVER w, 6) + 0e0 AS profile, lead(x, 3) OVER w AS ahead FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)", "sig_emb")
def sig_differences(spark, d):
    w = op.ordered(E)
    x = F.col("x")
    return sig_emb(spark, d).select("series_id", "idx", r6(x - F.lag("x").over(w)).alias("d1"), r6(x - 2 * F.lag("x").over(w) + F.lag("x", 2).over(w)).alias("d2"), r6(F.sum("x").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("profile"), F.lead("x", 3).over(w).alias("ahead"))


@query("SELECT series_id, idx, rank() OVER (PARTITION BY series_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, v) - 1) / 2e0 AS rank FROM (SELECT series_id, idx, round(x, 1) AS v FROM sig_emb)", "sig_emb")
def sig_ranks(spark, d):
    return op.ranked(sig_emb(spark, d).withColumn("v", F.round("x", 1)), "v").select("series_id", "idx", "rank")


_FILL = ", b AS (SELECT series_id, channel, idx, x, last_value(x IGNORE NULLS) OVER p AS a, first_value(x IGNORE NULLS) OVER q AS b, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS i, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER q AS j FROM sig_hourly WINDOW p AS (PARTITION BY series_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY series_id, channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), filled AS (SELECT series_id, channel, idx, coalesce(x, a + (b - a) * ((idx - i) / nullif((j - i)::DOUBLE, 0)), a, b) AS x FROM b)"


@query(_FILL + " SELECT series_id, channel, idx, round(x, 8) AS x FROM filled", "sig_hourly")
def sig_gapfill(spark, d):
    return op.filled(sig_hourly(spark, d), H).withColumn("x", F.round("x", 8))


@query("SELECT series_id, idx, round(x - (regr_slope(x, idx) OVER w * idx + regr_intercept(x, idx) OVER w), 6) + 0e0 AS d, round(x - avg(x) OVER w, 6) + 0e0 AS c FROM sig_emb WINDOW w AS (PARTITION BY series_id)", "sig_emb")
def sig_detrend(spark, d):
    return rounded(op.detrended(op.detrended(sig_emb(spark, d)), out="c", linear=False).select("series_id", "idx", "d", "c"), "d", "c")


@query(", g AS (SELECT DISTINCT series_id, k.range AS idx FROM sig_emb, range(0, 38) k) SELECT g.series_id, g.idx, g.idx / 6e0 AS t, round(a.x + (coalesce(b.x, a.x) - a.x) * (g.idx * 10 / 6e0 - g.idx * 10 // 6), 6) + 0e0 AS x FROM g JOIN sig_emb a ON a.series_id = g.series_id AND a.idx = g.idx * 10 // 6 LEFT JOIN sig_emb b ON b.series_id = g.series_id AND b.idx = g.idx * 10 // 6 + 1", "sig_emb")
def sig_resample(spark, d):
    return rounded(op.resampled(sig_emb(spark, d), 10.0, 6.0), "x")


@query(", s AS (SELECT series_id, (t_s - min(t_s) OVER w) / nullif(max(t_s) OVER w - min(t_s) OVER w, 0) AS u, x FROM sig_events WINDOW w AS (PARTITION BY series_id)), g AS (SELECT DISTINCT series_id, k.range / 2.9e1 AS u FROM sig_events, range(30) k), a AS (SELECT g.series_id, g.u, p.u AS i, p.x AS a FROM g ASOF LEFT JOIN s p ON p.series_id = g.series_id AND g.u >= p.u), b AS (SELECT a.*, q.u AS j, q.x AS b FROM a ASOF LEFT JOIN s q ON q.series_id = a.series_id AND a.u <= q.u) SELECT series_id, u, round(CASE WHEN i = u THEN a ELSE a + (b - a) * ((u - i) / nullif(j - i, 0)) END, 6) + 0e0 AS x FROM b", "sig_events")
def sig_normalised_grid(spark, d):
    return rounded(op.normalised_grid(sig_events(spark, d), 30, t="t_s"), "x")


@query("SELECT series_id, idx, round(sqrt(avg(x * x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS rms FROM sig_emb", "sig_emb")
def sig_moving_rms(spark, d):
    return rounded(op.moving_rms(sig_emb(spark, d), 3).select("series_id", "idx", "rms"), "rms")


@query("SELECT series_id, idx // 5 AS k, round(avg(x), 6) + 0e0 AS x FROM sig_emb GROUP BY ALL HAVING count(*) = 5", "sig_emb")
def sig_coarse_grain(spark, d):
    return rounded(op.coarse_grained(sig_emb(spark, d), 5), "x")


@query("SELECT pair_id, idx, round(x - coalesce(regr_slope(x, y) OVER w, 0) * (y - avg(y) OVER w), 6) + 0e0 AS cleaned FROM pair_emb WINDOW w AS (PARTITION BY pair_id)", "pair_emb")
def sig_reference_removed(spark, d):
    return rounded(op.without_reference(pair_emb(spark, d), "y", ["pair_id"]).select("pair_id", "idx", "cleaned"), "cleaned")


# Triggers: an event above its threshold is a high sample.
_HIGH = ", t AS (SELECT series_id, idx, t_s, coalesce(x > 30, false) AS high FROM sig_events)"


@query(_HIGH + ", r AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM t WHERE high) SELECT series_id, min(idx) AS first, max(idx) AS last, count(*)::BIGINT AS length FROM r GROUP BY series_id, g", "sig_events")
def sig_trigger_runs(spark, d):
    return A.runs(sig_events(spark, d), F.col("x") > 30)


@query(_HIGH + ", l AS (SELECT series_id, idx, high, coalesce(lead(high) OVER (PARTITION BY series_id ORDER BY idx), false) AS n FROM t) SELECT series_id, idx FROM l WHERE high AND NOT n", "sig_events")
def sig_trigger_ends(spark, d):
    return A.last_of_runs(sig_events(spark, d), F.col("x") > 30).select("series_id", "idx")


@query(", f AS (SELECT *, min(idx) FILTER (x > 30) OVER (PARTITION BY series_id) AS f FROM sig_events) SELECT series_id, idx - f AS idx, x FROM f WHERE idx >= f", "sig_events")
def sig_first_trigger(spark, d):
    e = sig_events(spark, d).withColumn("trigger", (F.col("x") > 30).cast("int"))
    return A.from_first_trigger(e, "trigger").select("series_id", "idx", "x")


@query("SELECT series_id, idx, CASE WHEN idx < 40 THEN x END AS a, CASE WHEN idx % 2 = 0 THEN t_s END AS b, channel AS c FROM sig_events", "sig_events")
def sig_zip(spark, d):
    e = sig_events(spark, d)
    frames = [e.filter("idx < 40").select("series_id", "idx", F.col("x").alias("a")), e.filter("idx % 2 = 0").select("series_id", "idx", F.col("t_s").alias("b")), e.select("series_id", "idx", F.col("channel").alias("c"))]
    return A.zipped(frames)


_ENDS = _HIGH + ", l AS (SELECT series_id, idx, high, coalesce(lead(high) OVER (PARTITION BY series_id ORDER BY idx), false) AS n FROM t), ends AS (SELECT series_id, idx FROM l WHERE high AND NOT n)"


def _ends(spark, d):
    return A.last_of_runs(sig_events(spark, d), F.col("x") > 30).select("series_id", "idx")


@query(_ENDS + ", every AS (SELECT * FROM ends UNION ALL SELECT series_id, max(idx) + 20 FROM ends WHERE series_id % 2 = 0 GROUP BY series_id), b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS back FROM every) SELECT series_id, idx FROM b WHERE NOT (back IN (2, 4) AND series_id % 3 = 0)", "sig_events")
def sig_trigger_patches(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("series_id")).distinct()
    patches = s.select("series_id", F.when(F.col("series_id") % 2 == 0, 2.0).alias("add_after_last_s"), F.when(F.col("series_id") % 3 == 0, F.array(F.lit(2), F.lit(4))).otherwise(F.array().cast("array<int>")).alias("remove"))
    return A.patched(_ends(spark, d), patches, 10.0)


@query(_ENDS + " SELECT series_id, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(list_sort(list(idx)), lambda i: [i])), lambda acc, i: CASE WHEN len(acc) = 0 OR i[1] - acc[len(acc)] >= 5 THEN list_concat(acc, i) ELSE acc END)) AS idx FROM ends GROUP BY series_id", "sig_events")
def sig_trigger_merge(spark, d):
    return A.merged_triggers(_ends(spark, d), 5)


_LABELS = _ENDS + ", b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) - 1 AS back, count(*) OVER (PARTITION BY series_id) AS n FROM ends), labels AS (SELECT series_id, idx, CASE WHEN back >= 6 THEN 'AUDIO_SYNC' ELSE (['RS1', 'VIZ', 'AUD'])[(5 - back) // 2 + 1] || CASE WHEN (5 - back) % 2 = 0 THEN '_start' ELSE '_stop' END END AS label FROM b WHERE n >= 6)"
_SEGMENTS = _LABELS + ", segments AS (SELECT series_id, regexp_replace(label, '_(start|stop)$', '') AS condition, min(idx) FILTER (label LIKE '%start') AS start, max(idx) FILTER (label LIKE '%stop') AS stop FROM labels WHERE label <> 'AUDIO_SYNC' GROUP BY ALL HAVING start < stop)"


def _labels(spark, d):
    ends = _ends(spark, d)
    return A.annotated(ends, ends.select("series_id").distinct().withColumn("conditions", F.array(*map(F.lit, ("RS1", "VIZ", "AUD")))))


@query(_LABELS + " SELECT * FROM labels", "sig_events")
def sig_annotate(spark, d):
    return _labels(spark, d)


@query(_LABELS + ", a AS (SELECT series_id, max(idx) AS cut FROM labels WHERE label = 'AUDIO_SYNC' GROUP BY series_id) SELECT series_id, idx - cut AS idx, x FROM sig_events JOIN a USING (series_id) WHERE idx >= cut", "sig_events")
def sig_trim(spark, d):
    return A.trimmed(sig_events(spark, d), _labels(spark, d)).select("series_id", "idx", "x")


@query(_SEGMENTS + " SELECT s.series_id, condition, idx, x FROM sig_events s JOIN segments g ON s.series_id = g.series_id AND idx >= start AND idx < stop", "sig_events")
def sig_segments(spark, d):
    return A.sliced(sig_events(spark, d), A.segments(_labels(spark, d))).select("series_id", "condition", "idx", "x")


@query(_SEGMENTS + ", m AS (SELECT series_id, condition, floor(start * 1.5)::BIGINT AS start, floor(stop * 1.5)::BIGINT AS stop FROM segments) SELECT s.series_id, condition, idx - start AS idx, x FROM sig_events s JOIN m ON s.series_id = m.series_id AND idx >= start AND idx < stop", "sig_events")
def sig_cross_rate_cut(spark, d):
    return A.cut_at_rate(sig_events(spark, d), A.segments(_labels(spark, d)), 10.0, 15.0).select("series_id", "condition", "idx", "x")


@query("SELECT series_id, idx - (series_id % 5) * 5 AS idx, x FROM sig_events WHERE idx >= (series_id % 5) * 5", "sig_events")
def sig_offset_cut(spark, d):
    e = sig_events(spark, d)
    return A.cut_from(e, e.select("series_id").distinct().withColumn("offset_s", F.col("series_id") % 5 * 0.5), 10.0).select("series_id", "idx", "x")


_ASOF = ", l AS (SELECT series_id, t_s, idx FROM sig_events WHERE channel = 'click'), r AS (SELECT series_id, t_s AS rt, x AS v FROM sig_events WHERE channel = 'view')"


@query(_ASOF + ", p AS (SELECT l.*, r.rt AS pt, r.v AS pv FROM l ASOF LEFT JOIN r ON l.series_id = r.series_id AND l.t_s >= r.rt), q AS (SELECT p.*, r.rt AS qt, r.v AS qv FROM p ASOF LEFT JOIN r ON p.series_id = r.series_id AND p.t_s <= r.rt) SELECT series_id, t_s, idx, CASE WHEN pt IS NOT NULL AND (qt IS NULL OR t_s - pt <= qt - t_s) THEN CASE WHEN t_s - pt <= 7200 THEN pv END WHEN qt - t_s <= 7200 THEN qv END AS value FROM q", "sig_events")
def sig_asof_nearest(spark, d):
    e = sig_events(spark, d)
    return A.nearest(e.filter("channel = 'click'").select("series_id", "t_s", "idx"), e.filter("channel = 'view'").select("series_id", "t_s", F.col("x").alias("value")), 7200.0)


@query(_ASOF + " SELECT r.series_id, rt AS t_s, v AS x FROM r JOIN (SELECT series_id, max(t_s) AS e FROM l GROUP BY series_id) e ON r.series_id = e.series_id AND rt <= e.e", "sig_events")
def sig_trim_right(spark, d):
    e = sig_events(spark, d)
    return A.not_after_left(e.filter("channel = 'click'"), e.filter("channel = 'view'")).select("series_id", "t_s", "x")


@query(", a AS (SELECT series_id, t_s AS t, x FROM sig_events WHERE channel = 'click'), b AS (SELECT series_id, t_s AS t FROM sig_events WHERE channel = 'view'), g AS (SELECT b.* FROM b JOIN (SELECT series_id, min(t) AS lo, max(t) AS hi FROM a GROUP BY series_id) s ON b.series_id = s.series_id AND t BETWEEN lo AND hi), p AS (SELECT g.*, a.t AS i, a.x AS a FROM g ASOF LEFT JOIN a ON a.series_id = g.series_id AND g.t >= a.t), q AS (SELECT p.*, a.t AS j, a.x AS b FROM p ASOF LEFT JOIN a ON a.series_id = p.series_id AND p.t <= a.t) SELECT series_id, t, round(CASE WHEN i = t THEN a ELSE a + (b - a) * ((t - i) / nullif(j - i, 0)) END, 6) AS x FROM q", "sig_events")
def sig_align_to(spark, d):
    e = sig_events(spark, d).withColumnRenamed("t_s", "t")
    a, b = e.filter("channel = 'click'").select("series_id", "t", "x"), e.filter("channel = 'view'").select("series_id", "t")
    return rounded(op.interpolated(a, A.overlap(a, b)), "x")


@query("SELECT series_id, idx - 11 AS idx, x FROM sig_emb WHERE idx BETWEEN 11 AND 48", "sig_emb")
def sig_crop(spark, d):
    return op.crop(sig_emb(spark, d), 1.05, 4.85, 10.0).select("series_id", "idx", "x")


@query("SELECT subject, round(first, 4) AS first, round(second, 4) AS second, round(second - first, 4) + 0e0 AS diff FROM (SELECT subject, max(value) FILTER (condition = '1-URGENT') AS first, max(value) FILTER (condition = '2-HIGH') AS second FROM cells GROUP BY subject) WHERE first IS NOT NULL AND second IS NOT NULL", "cells")
def sig_paired(spark, d):
    p = A.paired(cells(spark, d), "subject", "condition", "1-URGENT", "2-HIGH")
    return p.select("subject", *[(F.round(c, 4) + 0.0).alias(c) for c in ("first", "second", "diff")])


_GAPS = ", g AS (SELECT * FROM sig_emb WHERE (idx + series_id) % 29 <> 7), gw AS (SELECT series_id, w.w, idx - w.w * 8 AS pos, x, count(*) OVER (PARTITION BY series_id, w.w) AS n FROM g, (SELECT range AS w FROM range(6)) w WHERE idx >= w.w * 8 AND idx < w.w * 8 + 16)"


@query(_GAPS + " SELECT series_id, w, pos, x FROM gw WHERE n = 16", "sig_emb")
def sig_windows_gaps(spark, d):
    """Windows of series with missing rows: only complete ones."""
    s = sig_emb(spark, d).filter((F.col("idx") + F.col("series_id")) % 29 != 7)
    return op.exploded_windows(s, 16, 8).select("series_id", "w", "pos", "x").filter("w < 6")
