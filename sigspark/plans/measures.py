"""Queries on single measures and on tables that put several side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as bd, coupling as cp, features as ft, frames as fr, spectral as sp
from .registry import ORACLE, frame_emb, pair_emb, query, rounded, sig_emb
from .spectrum import _COH

P = ["pair_id"]

_NEAR = """, d AS (SELECT series_id, idx, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c, 0.2e0 * stddev_pop(x) OVER (PARTITION BY series_id) AS r FROM sig_emb WHERE idx < 24 WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
n2 AS (SELECT t.series_id, t.idx, count(*) AS n FROM d t JOIN d u ON t.series_id = u.series_id AND abs(t.a - u.a) <= t.r AND abs(t.b - u.b) <= t.r GROUP BY ALL), n3 AS (SELECT t.series_id, t.idx, count(*) AS n FROM d t JOIN d u ON t.series_id = u.series_id AND abs(t.a - u.a) <= t.r AND abs(t.b - u.b) <= t.r AND abs(t.c - u.c) <= t.r GROUP BY ALL),
p2 AS (SELECT series_id, avg(ln(n)) - ln(count(*)) AS p FROM n2 GROUP BY series_id), p3 AS (SELECT series_id, avg(ln(n)) - ln(count(*)) AS q FROM n3 GROUP BY series_id) SELECT series_id, round(p - q, 6) + 0e0 AS apen FROM p2 JOIN p3 USING (series_id)"""


@query(_NEAR, "sig_emb")
def ent_approximate(spark, d):
    """Approximate entropy of the first 24 samples of every series."""
    return rounded(ft.approximate_entropy(sig_emb(spark, d).filter("idx < 24")), "apen")


_BANDS = [("low", 2.0, 8.0), ("mid", 8.0, 20.0), ("high", 20.0, 32.0)]


@query(None)
def feat_complexity_bands(spark, d):
    """The complexity summary with the power of every band and its share."""
    s = bd.complexity_summary(sig_emb(spark, d), 32, 16, 64.0, [8, 16, 32], ["series_id"], _BANDS)
    return rounded(s, *[c for c, t in s.dtypes if t == "double"])


_WIDE = ", ".join(f"max({c}) FILTER (band = '{b}') AS {b}_{e}" for b, _, _ in _BANDS for c, e in (("power", "abs"), ("relative", "rel")))


_TABLE = _COH + ", bands AS (FROM (VALUES ('low', 4e0, 12e0), ('high', 12e0, 24e0)) v(band, low, high)) SELECT pair_id, band, round(avg(c), 6) AS mean, round(arg_max(c, (round(c, 9), -k)), 6) AS peak, arg_max(f, (round(c, 9), -k)) AS peak_f FROM coh JOIN bands ON f BETWEEN low AND high GROUP BY pair_id, band"


@query(_TABLE, "pair_emb")
def spec_coherence_table(spark, d):
    """Every pair in every band, from one spectrum."""
    n = sp.segment_length(64, 64.0, 4.0, 20.0)
    bands = spark.createDataFrame([("low", 4.0, 12.0), ("high", 12.0, 24.0)], "band string, low double, high double")
    return rounded(sp.coherence_table(sp.coherence(pair_emb(spark, d), n, n // 2, 64.0, P), bands, P), "mean", "peak")


@query("SELECT pair_id, round(r, 6) + 0e0 AS r, round(top, 6) + 0e0 AS top, n FROM (SELECT pair_id, corr(x, y) AS r FROM pair_emb GROUP BY pair_id) JOIN (SELECT pair_id, CASE WHEN pair_id % 7 <> 3 THEN max(x) END AS top FROM pair_emb WHERE pair_id % 5 <> 2 GROUP BY pair_id) USING (pair_id) JOIN (SELECT pair_id, count(*)::BIGINT AS n FROM pair_emb WHERE x > 0.05 GROUP BY pair_id) USING (pair_id) WHERE r IS NOT NULL AND top IS NOT NULL", "pair_emb")
def sig_complete_merge(spark, d):
    """Three measures of the cells that have all of them."""
    p = pair_emb(spark, d)
    top = p.filter("pair_id % 5 <> 2").groupBy("pair_id").agg(F.max("x").alias("top")).withColumn("top", F.when(F.col("pair_id") % 7 != 3, F.col("top")))
    n = p.filter("x > 0.05").groupBy("pair_id").agg(F.count("*").alias("n"))
    return rounded(bd.complete_bundle([cp.correlation(p).select("pair_id", "r"), top, n], P), "r", "top")


@query("SELECT clip, frame, round(avg(v), 6) + 0e0 AS red, round(avg(v * v), 6) + 0e0 AS green, round(avg(abs(v)), 6) + 0e0 AS blue, round(avg(greatest(v, v * v, abs(v)) - least(v, v * v, abs(v))), 6) + 0e0 AS colourfulness FROM frame_emb GROUP BY clip, frame", "frame_emb")
def vid_colour_means(spark, d):
    f = frame_emb(spark, d).withColumns({"red": F.col("v"), "green": F.col("v") * F.col("v"), "blue": F.abs("v")})
    return rounded(fr.colour_means(f, ["red", "green", "blue"]), "red", "green", "blue", "colourfulness")


@query(None)
def vid_clip_complexity(spark, d):
    """Complexity of every signal that a clip's frames give."""
    signals = bd.quantified_clip(frame_emb(spark, d), 8, -0.5, 0.5).select("clip", "frame", "luminance", "contrast", "entropy", "frame_diff", "lacunarity")
    c = bd.clip_complexity(signals, 32, 16, 25.0, [4, 8, 16])
    return rounded(c, *[name for name, t in c.dtypes if t == "double"])


def _with_bands() -> str:
    return f"SELECT * FROM ({ORACLE['feat_complexity_summary']}) FULL JOIN (SELECT series_id, {_WIDE} FROM ({ORACLE['spec_bandpower']}) GROUP BY series_id) USING (series_id)"


ORACLE["feat_complexity_bands"] = _with_bands()
