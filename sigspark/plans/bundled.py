"""Queries that join several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A, bundles as bd, coupling as cp, frames as fr, models as md, series as op, spectral as sp, statistics as st
from ..sources.recordings import one_per_time, union_all
from .coupled import _MI, bins_sql
from .registry import cells, frame_emb, pair_emb, query, rounded, sig_emb, sig_events, sig_hourly

P = ["pair_id"]


def _all(df, *but):
    return rounded(df, *[c for c, t in df.dtypes if t == "double" and c not in but])


@query(None)
def cpl_fingerprint(spark, d):
    return _all(bd.fingerprint(pair_emb(spark, d), 64, 64.0, (4.0, 20.0), 32, 8, 4, P))


@query(None)
def cpl_fingerprint_long(spark, d):
    return _all(bd.long_form(bd.fingerprint(pair_emb(spark, d), 64, 64.0, (4.0, 20.0), 32, 8, 4, P), P))


@query(None)
def cpl_band_phase(spark, d):
    return _all(bd.band_phase_table(pair_emb(spark, d), 64, [("low", 2, 5), ("mid", 5, 12), ("high", 12, 24)], P))


@query(None)
def cpl_comodulogram(spark, d):
    return _all(bd.comodulogram(pair_emb(spark, d), 64, [(2, 4), (4, 6)], [(12, 18), (18, 24)], P))


@query(None)
def cpl_sensitivity(spark, d):
    long = bd.long_form(bd.fingerprint(pair_emb(spark, d), 64, 64.0, (4.0, 20.0), 32, 8, 4, P), P).withColumn("case", F.col("pair_id") % 10)
    return _all(bd.sensitivity_matrix(long, "case", "metric", "value", ["xcorr_peak", "coherence", "plv", "pli_sin", "mi_nats"]))


@query(", c AS (SELECT series_id, idx, x FROM sig_hourly WHERE channel = 'click' AND x IS NOT NULL) SELECT c.series_id, s.channel, round(corr(c.x, s.x), 6) + 0e0 AS r, count(*)::BIGINT AS n FROM c JOIN sig_hourly s ON s.series_id = c.series_id AND s.idx = c.idx AND s.channel <> 'click' AND s.x IS NOT NULL GROUP BY ALL", "sig_hourly")
def cpl_envelope_sweep(spark, d):
    h = sig_hourly(spark, d).filter("x IS NOT NULL")
    pairs = bd.with_envelopes(h.filter("channel = 'click'").select("series_id", "idx", "x"), h.filter("channel <> 'click'"), ["series_id"])
    return rounded(pairs.groupBy("series_id", "channel").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")), "r")


@query(", b AS (FROM (VALUES ('click', 'view'), ('error', 'signup')) v(band, envelope)), h AS (SELECT * FROM sig_hourly WHERE x IS NOT NULL) SELECT a.series_id, b.band, b.envelope, round(corr(a.x, e.x), 6) + 0e0 AS r, count(*)::BIGINT AS n FROM h a JOIN b ON a.channel = b.band JOIN h e ON e.series_id = a.series_id AND e.idx = a.idx AND e.channel = b.envelope GROUP BY ALL", "sig_hourly")
def cpl_band_matched(spark, d):
    h = sig_hourly(spark, d).filter("x IS NOT NULL")
    bands = spark.createDataFrame([("click", "view"), ("error", "signup")], "band string, envelope string")
    m = bd.band_matched(h.select("series_id", "idx", F.col("channel").alias("band"), "x"), h, bands, ["series_id"])
    return rounded(m.groupBy("series_id", "band", "envelope").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")), "r")


@query(None)
def ent_all(spark, d):
    return _all(bd.all_entropies(sig_emb(spark, d), 32, 16, 64.0, ["series_id"]))


@query(None)
def frac_all(spark, d):
    return _all(bd.all_fractals(sig_emb(spark, d), [8, 16, 32], ["series_id"]))


@query(None)
def feat_complexity_summary(spark, d):
    return _all(bd.complexity_summary(sig_emb(spark, d), 32, 16, 64.0, [8, 16, 32], ["series_id"]))


@query(None)
def feat_windowed_complexity(spark, d):
    return _all(bd.windowed_complexity(sig_emb(spark, d), 32, 32, 64.0, [4, 8, 16], ["series_id"]))


@query(None)
def feat_windowed_complexity_pairs(spark, d):
    """Windows of the series 2k and 2k + 1 laid end to end: window w of pair k is series 2k + w."""
    s = sig_emb(spark, d).select(F.floor(F.col("series_id") / 2).cast("long").alias("pair_id"), (F.col("idx") + F.col("series_id") % 2 * 64).alias("idx"), "x")
    return _all(bd.windowed_complexity(s, 64, 64, 64.0, [8, 16, 32], P))


def _shaped(df):
    """Slopes and angles of small spectra are good to fewer decimals."""
    return _all(df, "slope", "orientation").withColumns({"slope": F.round("slope", 5) + 0.0, "orientation": F.round("orientation", 4) + 0.0})


@query(None)
def vid_spatial_complexity(spark, d):
    return _shaped(bd.spatial_complexity(frame_emb(spark, d), 8, -0.5, 0.5))


@query(None)
def vid_quantified(spark, d):
    return _shaped(bd.quantified_clip(frame_emb(spark, d), 8, -0.5, 0.5))


@query(None)
def feat_rate_on_grid(spark, d):
    return _all(bd.rate_on_grid(sig_events(spark, d), 1 / 3600, ["series_id"]))


@query(None)
def sig_common_grid(spark, d):
    e = sig_events(spark, d).select("channel", "series_id", F.col("t_s").alias("t"), "x")
    return _all(bd.common_grid_mean(e, ["channel"], "series_id", 86400.0), "t")


@query(", a AS (SELECT series_id, idx // 16 AS w, avg(x) AS m FROM sig_emb GROUP BY ALL HAVING avg(x) > 0), b AS (SELECT series_id, idx // 16 AS w, max(x) AS top FROM sig_emb GROUP BY ALL HAVING max(x) < 0.3) SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.w, b.w) AS w, round(m, 6) + 0e0 AS m, top FROM a FULL JOIN b ON a.series_id = b.series_id AND a.w = b.w", "sig_emb")
def sig_feature_merge(spark, d):
    s = sig_emb(spark, d).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    a = s.groupBy("series_id", "w").agg(F.avg("x").alias("m")).filter("m > 0")
    b = s.groupBy("series_id", "w").agg(F.max("x").alias("top")).filter("top < 0.3")
    return rounded(bd.bundle([a, b], ["series_id", "w"]), "m")


@query("SELECT c.subject, c.condition, round(c.value, 4) AS value, n.n FROM cells c JOIN (SELECT DISTINCT o_custkey % 20 AS subject, 1 AS n FROM orders) n USING (subject)", "cells")
def sig_distinct_join(spark, d):
    from .registry import table

    n = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("subject"), F.lit(1).alias("n")).distinct()
    return cells(spark, d).join(n, "subject").select("subject", "condition", F.round("value", 4).alias("value"), "n")


@query("SELECT series_id, floor(t_s / 3600)::BIGINT AS hour, idx, x FROM (SELECT *, row_number() OVER (PARTITION BY series_id, floor(t_s / 3600) ORDER BY idx) AS k FROM sig_events) WHERE k = 1", "sig_events")
def src_one_per_time(spark, d):
    e = sig_events(spark, d).withColumn("hour", F.floor(F.col("t_s") / 3600).cast("long"))
    return one_per_time(e, ["series_id"], "hour").select("series_id", "hour", "idx", "x")


@query("SELECT series_id, idx, x, NULL::DOUBLE AS t_s FROM sig_events WHERE channel = 'click' UNION ALL SELECT series_id, idx, NULL, t_s FROM sig_events WHERE channel = 'view'", "sig_events")
def src_union_missing(spark, d):
    e = sig_events(spark, d)
    return union_all([e.filter("channel = 'click'").select("series_id", "idx", "x"), e.filter("channel = 'view'").select("series_id", "idx", "t_s")])


@query(None)
def stat_window_blocks(spark, d):
    """Windows of every user's hourly activity as rest or nature, paired per user, and tested."""
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"])
    w = op.windowed(h, 48, 24, [F.avg("x").alias("value")], ["series_id", "channel"]).withColumn("block", F.when(F.col("channel").isin("click", "view"), "REST").otherwise("NATURE"))
    pairs = A.paired(w, "series_id", "block", "REST", "NATURE")
    return _all(st.t_one_sample(pairs, []))


@query(None)
def cpl_phase_windowed(spark, d):
    """Phase coupling in every window of half a series."""
    w = op.exploded_windows(pair_emb(spark, d), 32, 8, P)
    return _all(sp.phase_coupling(sp.analytic(w, 32, range(2, 6), ["pair_id", "w"], ("x", "y"), "pos"), ["pair_id", "w"]))


@query(None)
def cpl_coherence_windowed(spark, d):
    w = op.exploded_windows(pair_emb(spark, d), 32, 16, P).select("pair_id", F.col("w").alias("window"), F.col("pos").alias("idx"), "x", "y")
    return _all(sp.band_coherence(sp.coherence(w, 8, 4, 64.0, ["pair_id", "window"]), 8.0, 24.0, ["pair_id", "window"]))


@query(None)
def cpl_pac_windowed(spark, d):
    w = op.exploded_windows(pair_emb(spark, d), 32, 16, P)
    keys = ["pair_id", "w"]
    slow, fast = sp.analytic(w, 32, range(1, 4), keys, ("x",), "pos"), sp.analytic(w, 32, range(6, 12), keys, ("y",), "pos")
    pa = slow.join(fast, [*keys, "pos"]).select(*keys, F.atan2("b_x", "a_x").alias("phase"), F.hypot("a_y", "b_y").alias("amp"))
    return _all(sp.phase_amplitude(pa, keys))


@query(", pw AS (SELECT pair_id, w.w, idx, x, y FROM pair_emb, (SELECT range AS w FROM range(3)) w WHERE idx >= w.w * 16 AND idx < w.w * 16 + 32)" + bins_sql("b", "pw", "pair_id, w", 3) + " " + _MI.format("pair_id, w", "b"), "pair_emb")
def cpl_mi_windowed(spark, d):
    w = op.exploded_windows(pair_emb(spark, d), 32, 16, P)
    return rounded(cp.mutual_information(cp.binned(w, 3, ["pair_id", "w"]), ["pair_id", "w"]), "mi_nats")


@query(None)
def vid_pixel_spectrum_windowed(spark, d):
    """Every pixel's spectrum in sliding windows, and how far the pixels' peak frequencies agree in each."""
    keys = ["clip", "y", "px", "w"]
    s = op.detrended(op.exploded_windows(fr.pixel_series(frame_emb(spark, d)), 16, 8, ["clip", "y", "px"]), keys, "x", "pos", "x")
    p = sp.dft(s, 16, range(1, 9), keys, "pos").withColumn("p", F.col("re_x") ** 2 + F.col("im_x") ** 2)
    top = p.groupBy(*keys).agg(F.max_by("k", F.struct(F.round("p", 9), -F.col("k"))).alias("k"))
    return _all(fr.synchrony(top, ["clip", "w"], "k"))


@query(", p AS (SELECT clip, frame, y // 4 AS gy, px // 4 AS gx, avg(v) AS mean, stddev_pop(v) AS sd FROM frame_emb GROUP BY ALL) SELECT clip, frame, gy, gx, round(mean, 6) + 0e0 AS mean, round(sd, 6) AS sd FROM p", "frame_emb")
def vid_patch_field(spark, d):
    """Per-patch maps of every frame."""
    f = frame_emb(spark, d)
    patch = [F.floor(F.col(c) / 4).cast("long").alias(g) for c, g in (("y", "gy"), ("px", "gx"))]
    return _all(f.groupBy("clip", "frame", *patch).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")))


@query(None)
def mdl_channel_sweep(spark, d):
    """One random-intercept model per activity and weekday over users, corrected within the weekday."""
    e = sig_events(spark, d).withColumn("day", (F.floor(F.col("t_s") / 86400) % 7).cast("long"))
    return _all(st.bh_fdr(md.random_intercept(e, ["channel", "day"], "series_id", "t_s", "x"), keys=["day"]), "coefficient", "se")
