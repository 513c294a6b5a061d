"""Queries on components and modes of many channels, on pixel spectra, patches and columns of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import components as co, frames as fr, series as op
from .registry import frame_emb, query, rounded, sig_hourly
from .signal import _FILL

CLIP = ["clip"]


def _doubles(df, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, t in df.dtypes if t == "double"})


def _cells(sums, keys):
    """The blocks of product sums as rows a <= b; for tables whose channels fit one block."""
    kinds = dict(sums.dtypes)

    def run(frame):
        m = co.assembled(frame, "now")
        i, j = np.triu_indices(len(m))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(i) for k in keys}, "a": i, "b": j, "n": int(frame["n"].max()), "product": m[i, j]})

    return sums.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "a long, b long, n long, product double"]))


_HOURS = _FILL + ", c AS (SELECT series_id, idx, dense_rank() OVER (PARTITION BY series_id ORDER BY channel) - 1 AS c, x - avg(x) OVER (PARTITION BY series_id, channel) AS x FROM filled WHERE x IS NOT NULL)"


@query(_HOURS + " SELECT p.series_id, p.c AS a, q.c AS b, count(*)::BIGINT AS n, round(sum(p.x * q.x), 4) + 0e0 AS product FROM c p JOIN c q ON p.series_id = q.series_id AND p.idx = q.idx AND p.c <= q.c GROUP BY ALL", "sig_hourly")
def sig_channel_products(spark, d):
    """Sums of products of every two channels of hourly activity, from batches of instants."""
    h = co.centred(op.filled(sig_hourly(spark, d), ["series_id", "channel"]), ["series_id"], "channel")
    return _cells(co.product_sums(h, ["series_id"], "idx", "channel"), ["series_id"]).withColumn("product", F.round("product", 4) + 0.0)


def _split(spark, d):
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"])
    return h.filter("channel <> 'click'"), h.filter("channel = 'click'").select("series_id", "idx", F.col("x").alias("r"))


@query(None)
def sig_components_removed(spark, d):
    """Hourly activity without the components that follow the clicks."""
    return _doubles(co.removed(*_split(spark, d), ["series_id"], "channel", 0.1)[0], 5)


@query(None)
def sig_components(spark, d):
    return _doubles(co.removed(*_split(spark, d), ["series_id"], "channel", 0.1)[1], 5)


def _pixels(spark, d):
    return co.centred(fr.pixel_vectors(frame_emb(spark, d)), CLIP, "channel")


_PIX = ", s AS (SELECT clip, y * 8 + px AS c, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v - avg(v) OVER (PARTITION BY clip, y, px) AS x FROM frame_emb)"


@query(_PIX + " SELECT p.clip, p.c AS a, q.c AS b, count(*)::BIGINT AS n, round(sum(p.x * q.x), 5) + 0e0 AS product FROM s p JOIN s q ON p.clip = q.clip AND p.idx = q.idx AND p.c <= q.c GROUP BY ALL", "frame_emb")
def vid_pixel_products(spark, d):
    """The pixel covariance of every clip, times its frames."""
    return _cells(co.product_sums(_pixels(spark, d), CLIP, "idx", "channel"), CLIP).withColumn("product", F.round("product", 5) + 0.0)


@query(None)
def vid_modes(spark, d):
    """The strongest modes of every clip, and their shares of the energy."""
    found = co.loadings(_pixels(spark, d), CLIP, "idx", "channel", k=4)
    return _doubles(found.groupBy("clip", "mode").agg(F.max("energy").alias("energy")))


@query(None)
def vid_mode_series(spark, d):
    """Every frame projected on the strongest modes."""
    p = _pixels(spark, d)
    return _doubles(co.scores(p, co.loadings(p, CLIP, "idx", "channel", k=3), CLIP, "idx", "channel"), 5)


@query(None)
def vid_dynamic_modes(spark, d):
    """Frequency, growth and energy of dynamic modes; a complex pair counts once."""
    return _doubles(co.dynamic_modes(_pixels(spark, d), CLIP, "idx", "channel", 25.0), 4).select("clip", "mode", "frequency", "growth", "energy")


@query(None)
def vid_dynamic_series(spark, d):
    p = _pixels(spark, d)
    return _doubles(co.mode_series(co.dynamic_modes(p, CLIP, "idx", "channel", 25.0), p, CLIP, "idx"), 4)


@query(None)
def vid_dynamic_modes_windowed(spark, d):
    """The two strongest dynamic modes of sliding windows, on the frames between the windows' centres."""
    s = fr.pixel_vectors(frame_emb(spark, d))
    w = op.exploded_windows(s, 16, 8, ["clip", "channel"]).select("clip", "w", "channel", F.col("pos").alias("idx"), "x")
    modes = co.dynamic_modes(co.centred(w, ["clip", "w"], "channel"), ["clip", "w"], "idx", "channel", 25.0, bounded=True)
    top = co.strongest(modes, ["clip", "w"])
    return _doubles(fr.frame_curve(top, s, ["n_modes", "top_frequency", "top_energy", "second_frequency", "second_energy"], F.col("w") * 8 + 8), 4)


_N = 16
_FLAT = """, s AS (SELECT clip, y, px, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, v FROM frame_emb), w AS (SELECT clip, y, px, i // 8 - o.o AS w, i - (i // 8 - o.o) * 8 AS pos, v FROM s, (SELECT range AS o FROM range(2)) o WHERE i // 8 - o.o >= 0),
c AS (SELECT *, count(*) OVER g AS n, v - (regr_slope(v, pos) OVER g * pos + regr_intercept(v, pos) OVER g) AS x FROM w WINDOW g AS (PARTITION BY clip, w, y, px)), h AS (SELECT *, x * (0.5e0 - 0.5e0 * cos(pos * 2 * pi() / 15)) AS z FROM c WHERE n = 16),
t AS (SELECT clip, w, y, px, k.range AS k, sum(z * cos(2 * pi() * k.range * pos / 16)) AS re, -sum(z * sin(2 * pi() * k.range * pos / 16)) AS im FROM h, range(1, 9) k GROUP BY ALL),
pw AS (SELECT clip, w, y, px, k, k * 25e0 / 16 AS f, re * re + im * im AS p, coalesce(re / nullif(sqrt(re * re + im * im), 0), 0) AS ux, coalesce(im / nullif(sqrt(re * re + im * im), 0), 0) AS uy FROM t),
ms AS (SELECT clip, w, k, avg(p) AS m, count(*) AS n, sum(ux) AS sx, sum(uy) AS sy, sum(ux * ux + uy * uy) AS own FROM pw GROUP BY ALL), sh AS (SELECT *, m / sum(m) OVER (PARTITION BY clip, w) AS q FROM ms),
a AS (SELECT clip, w, 1 + sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 3 AS sync, sum(q * (sx * sx + sy * sy - own) / (n * (n - 1))) AS phase_coherence FROM sh GROUP BY ALL),
e AS (SELECT clip, w, y, px, arg_max(f, (round(p, 9), -k)) AS f, -sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 3 AS h FROM (SELECT *, p / sum(p) OVER (PARTITION BY clip, w, y, px) AS q FROM pw) GROUP BY ALL),
b AS (SELECT clip, w, greatest(0, least(1, 1 - stddev_pop(f) / (25e0 / 16 * 7))) AS coherence, quantile_cont(f, 0.5) AS peak_median, avg(h) AS entropy FROM e GROUP BY ALL),
bp AS (SELECT clip, w, log10(1 + sum(CASE WHEN f >= 1 AND f < 5 THEN p ELSE 0 END)) AS slow, log10(1 + sum(CASE WHEN f >= 5 AND f < 13 THEN p ELSE 0 END)) AS fast FROM pw GROUP BY ALL)
SELECT clip, w, """ + ", ".join(f"round({c}, 5) + 0e0 AS {c}" for c in ("sync", "phase_coherence", "coherence", "peak_median", "entropy", "slow", "fast")) + " FROM a JOIN b USING (clip, w) JOIN bp USING (clip, w)"


@query(_FLAT, "frame_emb")
def vid_spectral_indices_windowed(spark, d):
    """Synchrony and coherence of all pixels' spectra in sliding windows, their phases' coherence over all pairs, and band powers."""
    pixel = ["y", "px"]
    w = op.exploded_windows(fr.pixel_series(frame_emb(spark, d)), _N, 8, fr.PIXEL)
    power = fr.pixel_power(w.select("clip", "w", *pixel, "pos", "x"), _N, 25.0, ["clip", "w", *pixel], "pos")
    return _doubles(fr.spectral_indices(power, _N, 25.0, ["clip", "w"], pixel, [("slow", 1.0, 5.0), ("fast", 5.0, 13.0)]), 5)


_PATCH = """, pf AS (SELECT clip, frame, y, px, v, y // 4 AS gy, px // 4 AS gx FROM frame_emb), ba AS (SELECT clip, frame, gy, gx, avg(v) AS mean, stddev_pop(v) AS sd FROM pf GROUP BY ALL),
en AS (SELECT clip, frame, gy, gx, -sum(q * log2(q)) AS entropy FROM (SELECT clip, frame, gy, gx, n / sum(n) OVER (PARTITION BY clip, frame, gy, gx) AS q FROM (SELECT clip, frame, gy, gx, least(greatest(floor((v + 0.5e0) / (1e0 / 8)), 0), 7) AS b, count(*) AS n FROM pf GROUP BY ALL)) GROUP BY ALL),
nb AS (SELECT *, coalesce(lag(v) OVER a, v) AS l, coalesce(lead(v) OVER a, v) AS r, coalesce(lag(v) OVER b, v) AS u, coalesce(lead(v) OVER b, v) AS w FROM pf WINDOW a AS (PARTITION BY clip, frame, y ORDER BY px), b AS (PARTITION BY clip, frame, px ORDER BY y)),
df AS (SELECT *, r - l AS dx, w - u AS dy FROM nb), sb AS (SELECT *, sqrt((coalesce(lag(dx) OVER b, dx) + 2 * dx + coalesce(lead(dx) OVER b, dx)) ** 2 + (coalesce(lag(dy) OVER a, dy) + 2 * dy + coalesce(lead(dy) OVER a, dy)) ** 2) AS g FROM df WINDOW a AS (PARTITION BY clip, frame, y ORDER BY px), b AS (PARTITION BY clip, frame, px ORDER BY y)),
gr AS (SELECT clip, frame, gy, gx, avg(g) AS gradient, avg(CASE WHEN g > 2 * m THEN 1e0 ELSE 0e0 END) AS edges FROM (SELECT *, avg(g) OVER (PARTITION BY clip, frame) AS m FROM sb) GROUP BY ALL),
sz AS (SELECT pf.*, s.s, y // s.s AS ys, px // s.s AS xs FROM pf, (SELECT unnest([1, 2, 4])::BIGINT AS s) s),
bx AS (SELECT clip, frame, gy, gx, -regr_slope(ln(n), ln(s)) AS dimension FROM (SELECT clip, frame, gy, gx, s, count(*) AS n FROM (SELECT DISTINCT clip, frame, gy, gx, s, ys, xs FROM sz WHERE v > 0) GROUP BY ALL) GROUP BY ALL),
la AS (SELECT clip, frame, gy, gx, avg(ln(l)) AS lacunarity FROM (SELECT clip, frame, gy, gx, s, 1 + var_pop(t) / nullif(avg(t) * avg(t), 0) AS l FROM (SELECT clip, frame, gy, gx, s, ys, xs, sum(v + 0.5e0) AS t FROM sz WHERE s > 1 GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)
SELECT clip, frame, gy, gx, """ + ", ".join(f"round({c}, 5) + 0e0 AS {c}" for c in fr.PATCH_MEASURES) + " FROM ba JOIN en USING (clip, frame, gy, gx) JOIN gr USING (clip, frame, gy, gx) LEFT JOIN bx USING (clip, frame, gy, gx) LEFT JOIN la USING (clip, frame, gy, gx)"


@query(_PATCH, "frame_emb")
def vid_patch_measures(spark, d):
    """Seven measures of every patch of every frame."""
    return _doubles(fr.patch_measures(frame_emb(spark, d), 4, 8, -0.5, 0.5), 5)


_COL = """, cs AS (SELECT clip, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, v FROM frame_emb WHERE px = 3), m AS (SELECT clip, i, avg(v) AS x FROM cs GROUP BY ALL),
w AS (SELECT clip, i // 8 - o.o AS w, i - (i // 8 - o.o) * 8 AS pos, x FROM m, (SELECT range AS o FROM range(2)) o WHERE i // 8 - o.o >= 0), c AS (SELECT *, count(*) OVER g AS n, (x - avg(x) OVER g) * (0.5e0 - 0.5e0 * cos(2 * pi() * pos / 16)) AS z FROM w WINDOW g AS (PARTITION BY clip, w)),
u AS (SELECT clip, w, k.range AS k, sum(z * cos(2 * pi() * k.range * pos / 16)) ** 2 + sum(z * sin(2 * pi() * k.range * pos / 16)) ** 2 AS p FROM c, range(1, 9) k WHERE n = 16 GROUP BY ALL), t AS (SELECT clip, w, k, p * CASE WHEN k = 8 THEN 1 ELSE 2 END / (25 * 16 * 3e0 / 8) AS p FROM u)
SELECT clip, w, any_value(w) * 8 + 8e0 AS centre, arg_max(k, (round(p, 12), -k)) * (25e0 / 16) AS frequency, round(max(p), 6) AS power FROM t GROUP BY clip, w"""


@query(_COL, "frame_emb")
def vid_timestack_windowed(spark, d):
    """The dominant frequency of one pixel column in sliding windows."""
    return rounded(fr.column_waves(frame_emb(spark, d), 3, 16, 8, 25.0), "power")
