"""Queries on filters across chunks, rates and data-driven bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as bd, cardiac as cd, filters as fl, series as op, spectral as sp
from .extended import _HOURLY_RATE, _SEGMENTS, _beats
from .coupled import bins_sql
from .registry import ORACLE, VIEW_SQL, pair_emb, query, rounded, sig_events, sig_hourly
from .signal import _FILL

P = ["pair_id"]


@query(None)
def flt_envelope_bands(spark, d):
    """Twelve bands of an envelope; an hour of activity stands for a 512th of a second."""
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"]).filter("x IS NOT NULL")
    return rounded(fl.envelope_bands(h, 512, 256, 64, keys=["series_id", "channel"], chunk=256), "x")


@query(None)
def flt_wide_table(spark, d):
    """A wide table of channels, every one of them filtered."""
    h = sig_hourly(spark, d).withColumn("channel", F.concat(F.lit("ch_"), "channel"))
    wide = h.groupBy("series_id", "idx").pivot("channel", ["ch_click", "ch_error", "ch_view"]).agg(F.first("x"))
    return rounded(fl.filtered_table(wide, "ch_", (0.05, 0.2), 1.0, ["series_id"], "idx"), "ch_click", "ch_error", "ch_view")


@query(None)
def flt_ecg_peaks(spark, d):
    """Beats of a raw recording: high-passed, mains removed, peaks."""
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"]).filter("x IS NOT NULL")
    return fl.ecg_peaks(h, 10.0, ["series_id", "channel"], factor=0.8)


# The strongest frequency of y between 6 and 20 Hz: one Hann segment of the whole series.
_BAND = ", h AS (SELECT pair_id, idx, (y - avg(y) OVER (PARTITION BY pair_id)) * (0.5e0 - 0.5e0 * cos(2 * pi() * idx / 64)) AS z FROM pair_emb), t AS (SELECT pair_id, k.range AS k, sum(z * cos(2 * pi() * k.range * idx / 64)) ** 2 + sum(z * sin(2 * pi() * k.range * idx / 64)) ** 2 AS p FROM h, range(6, 21) k GROUP BY ALL), f AS (SELECT pair_id, arg_max(k, (round(2 * p / (64 * 64 * 3e0 / 8), 12), -k))::DOUBLE AS f0 FROM t GROUP BY pair_id)"


def _bands(spark, d):
    return sp.dominant_band(pair_emb(spark, d), 64, 64.0, P, 4.0, (6.0, 20.0))


@query(_BAND + " SELECT pair_id, f0, f0 - 2 AS low, f0 + 2 AS high FROM f", "pair_emb")
def cpl_dominant_band(spark, d):
    """Each pair's own band, around the strongest frequency of its second series."""
    return _bands(spark, d)


@query(None)
def cpl_phase_auto(spark, d):
    """Phase coupling of every pair in its own band."""
    s = sp.phase_sync(pair_emb(spark, d), 64.0, P, _bands(spark, d))
    return rounded(s, "plv", "mean_phase", "preferred_lag_s", "pli_sin", "wpli")


@query(None)
def cpl_phase_auto_windowed(spark, d):
    keys = ["pair_id", "w"]
    w = op.exploded_windows(pair_emb(spark, d), 32, 16, P).select(*keys, F.col("pos").alias("idx"), "x", "y")
    s = sp.phase_sync(w, 64.0, keys, sp.dominant_band(w, 32, 64.0, keys, 6.0, (6.0, 20.0)))
    return rounded(s, "plv", "mean_phase", "preferred_lag_s", "pli_sin", "wpli")


@query(None)
def cpl_band_matched_phase(spark, d):
    """Channels against the envelope that their band names: phase coupling of every cell in the envelope's own band."""
    keys = ["series_id", "band", "envelope"]
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"]).filter("x IS NOT NULL")
    bands = spark.createDataFrame([("click", "view"), ("error", "signup")], "band string, envelope string")
    m = bd.band_matched(h.select("series_id", "idx", F.col("channel").alias("band"), "x"), h, bands, ["series_id"])
    s = sp.phase_sync(m, 1.0, keys, sp.dominant_band(m, 240, 1.0, keys, 0.02, (0.02, 0.2)))
    return rounded(s, "plv", "mean_phase", "preferred_lag_s", "pli_sin", "wpli")


def _pairs(spark, d):
    envelope = op.filled(sig_hourly(spark, d).filter("channel = 'click'").select("series_id", "idx", "x"), ["series_id"])
    return cd.matched_to_rate(_beats(spark, d), envelope, 1 / 3600, ["series_id"], least=60)


@query(None)
def cpl_rate_paths(spark, d):
    """Event rate against clicks: lag search and information on windowed means, phase coupling on the gridded rate."""
    m = cd.two_path_measures(_pairs(spark, d), 1.0, 48, 24, 4, 3, 64, ["series_id"], 0.06, (0.05, 0.3))
    return rounded(m, "value")


_SLOW = f"""WITH sig_hourly AS ({VIEW_SQL['sig_hourly']}){_FILL}, {_HOURLY_RATE},
env AS (SELECT series_id, idx, x FROM filled WHERE channel = 'click' AND x IS NOT NULL), pr AS (SELECT hr.series_id, hr.idx, hr.x, env.x AS y FROM hr JOIN env ON hr.series_id = env.series_id AND hr.idx = env.idx),
ok AS (SELECT series_id FROM pr GROUP BY series_id HAVING count(*) >= 60 AND stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9),
sw AS (SELECT series_id, w.w AS idx, avg(x) AS x, avg(y) AS y FROM pr, {_SEGMENTS} WHERE series_id IN (SELECT series_id FROM ok) AND idx >= w.w * 24 AND idx < w.w * 24 + 48 GROUP BY ALL HAVING count(*) = 48),
en AS (SELECT * FROM sw WHERE series_id IN (SELECT series_id FROM sw GROUP BY series_id HAVING count(*) >= 3)), nn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS i FROM en),
lg AS (SELECT a.series_id, l.range AS lag, corr(a.x, b.y) AS r FROM nn a, range(-4, 5) l, nn b WHERE a.series_id = b.series_id AND b.i = a.i - l.range GROUP BY ALL),
tp AS (SELECT series_id, arg_max(lag, (round(r, 9), -lag)) AS lag, arg_max(r, (round(r, 9), -lag)) AS r FROM lg GROUP BY series_id){bins_sql('bn', 'en', 'series_id', 3)},
n AS (SELECT series_id, x, y, count(*)::DOUBLE AS n FROM bn GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY series_id, x) AS nx, sum(n) OVER (PARTITION BY series_id, y) AS ny, sum(n) OVER (PARTITION BY series_id) AS total FROM n)
SELECT series_id, 'xcorr_peak' AS metric, round(r, 6) + 0e0 AS value FROM tp UNION ALL SELECT series_id, 'xcorr_lag', lag::DOUBLE FROM tp UNION ALL SELECT series_id, 'mi', round(sum(n / total * ln(n * total / (nx * ny))), 6) + 0e0 FROM m GROUP BY series_id"""


@query(None)
def cpl_rate_slow_path(spark, d):
    m = cd.two_path_measures(_pairs(spark, d), 1.0, 48, 24, 4, 3, 64, ["series_id"], 0.06, (0.05, 0.3))
    return rounded(m.filter("path = 'slow'").drop("path"), "value")


ORACLE["cpl_rate_slow_path"] = _SLOW


@query(None)
def feat_gridded_windows(spark, d):
    """A feature of windows on a regular grid, for users with values in most windows."""
    e = sig_events(spark, d).withColumn("w", F.floor(F.col("t_s") / 86400).cast("long"))
    w = e.groupBy("series_id", "w").agg(F.avg("x").alias("v"), F.count("*").alias("n")).select("series_id", (F.col("w") * 86400.0).alias("time_start"), ((F.col("w") + 1) * 86400.0).alias("time_end"), F.when(F.col("n") >= 2, F.col("v")).alias("v"))
    return cd.gridded_feature(w, "v", 1 / 43200, ["series_id"]).withColumn("x", F.round("x", 9) + 0.0)


ORACLE["feat_gridded_windows"] = f"""WITH sig_events AS ({VIEW_SQL['sig_events']}), w AS (SELECT series_id, floor(t_s / 86400) * 86400 + 43200e0 AS t, CASE WHEN count(*) >= 2 THEN avg(x) END AS x FROM sig_events GROUP BY series_id, floor(t_s / 86400)),
sp AS (SELECT series_id, min(t) FILTER (x IS NOT NULL) AS a, max(t) FILTER (x IS NOT NULL) AS b FROM w GROUP BY series_id HAVING count(x) >= 2 AND count(x) >= 0.5 * count(*) AND max(t) FILTER (x IS NOT NULL) > min(t) FILTER (x IS NOT NULL)),
kn AS (SELECT series_id, t, x FROM w WHERE x IS NOT NULL AND series_id IN (SELECT series_id FROM sp)), nx AS (SELECT series_id, t, x, lead(t) OVER o AS t2, lead(x) OVER o AS x2 FROM kn WINDOW o AS (PARTITION BY series_id ORDER BY t)),
gr AS (SELECT series_id, a, k.range AS idx, a + k.range * 43200e0 AS t FROM sp, range(0, (SELECT ceil(max(b - a) / 43200)::BIGINT FROM sp)) k WHERE k.range < (b - a) / 43200)
SELECT g.series_id, g.idx, g.t, round(n.x + (n.x2 - n.x) * ((g.t - n.t) / (n.t2 - n.t)), 9) + 0e0 AS x FROM gr g JOIN nx n ON n.series_id = g.series_id AND g.t >= n.t AND g.t < n.t2"""
