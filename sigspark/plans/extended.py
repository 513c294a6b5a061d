"""Queries on scaling exponents across cells, on pixels and motion, and on heart rate coupled with an envelope."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cardiac as cd, coupling as cp, features as ft, frames as fr
from .composed_sql import coherence, rounded as sql_rounded
from .coupled import _PRO, SCALES, bins_sql
from .registry import ORACLE, VIEW_SQL, frame_emb, pair_emb, query, rounded, sig_events, sig_hourly
from .signal import _FILL

_ALPHAS = _PRO + ", al AS (SELECT pair_id, regr_slope(ln(sqrt(fxx)), ln(s)) AS a, regr_slope(ln(sqrt(fyy)), ln(s)) AS b, regr_slope(ln(sqrt(abs(nullif(fxy, 0)))), ln(s)) AS l FROM f GROUP BY pair_id)"


@query(_ALPHAS + ", cl AS (SELECT pair_id % 10 AS grp, corr(a, b) AS r, count(*)::BIGINT AS n FROM al WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL) SELECT grp, n, CASE WHEN n >= 3 THEN round(r, 6) + 0e0 END AS r, CASE WHEN n >= 3 THEN round(r * sqrt((n - 2) / (1 - r ** 2)), 5) + 0e0 END AS t FROM cl", "pair_emb")
def cpl_exponent_correlation(spark, d):
    """Do the scaling exponents of the two sides go together across cells?"""
    a = ft.dfa(cp.sides(pair_emb(spark, d)), SCALES, ["pair_id", "side"]).withColumn("grp", F.col("pair_id") % 10)
    return rounded(cp.exponent_correlation(a, "alpha", ["pair_id"], ["grp"]), "r").withColumn("t", F.round("t", 5) + 0.0)


@query(_ALPHAS + " SELECT pair_id, round(l, 5) + 0e0 AS lambda_xy FROM al", "pair_emb")
def cpl_dcca_exponent(spark, d):
    return cp.dcca_exponent(ft.dcca(pair_emb(spark, d), SCALES, ["pair_id"])).withColumn("lambda_xy", F.round("lambda_xy", 5) + 0.0)


_TRACES = ORACLE["cpl_complexity"].split("SELECT pair_id, round(corr(a, b)")[0].rstrip()


@query(None)
def cpl_complexity_mi(spark, d):
    """Mutual information of the two traces of windowed scaling exponents."""
    return rounded(cp.complexity_information(pair_emb(spark, d), 32, 8, [4, 8], 2), "mi_nats")


ORACLE["cpl_complexity_mi"] = (
    _TRACES + ", tr AS (SELECT pair_id, w AS idx, max(alpha) FILTER (side = 'x') AS x, max(alpha) FILTER (side = 'y') AS y FROM e GROUP BY ALL)" + bins_sql("bt", "tr", "pair_id", 2)
    + ", n AS (SELECT pair_id, x, y, count(*)::DOUBLE AS n FROM bt WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, x) AS nx, sum(n) OVER (PARTITION BY pair_id, y) AS ny, sum(n) OVER (PARTITION BY pair_id) AS total FROM n) SELECT pair_id, round(sum(n / total * ln(n * total / (nx * ny))), 6) + 0e0 AS mi_nats FROM m GROUP BY pair_id"
)


@query(None)
def vid_pixel_measures(spark, d):
    """Six complexity measures of every pixel."""
    return rounded(fr.pixel_complexity(frame_emb(spark, d), [4, 8, 16]), "katz", "petrosian", "higuchi", "dfa", "perm_entropy", "sample_entropy")


_PIXELS = f"SELECT clip * 64 + y * 8 + px AS series_id, clip AS grp, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v AS x FROM ({VIEW_SQL['frame_emb']})"


def _of_pixels(name: str, value: str, alias: str) -> str:
    sql = ORACLE[name].replace(VIEW_SQL["sig_emb"], _PIXELS).replace("[4, 8, 16, 32]", "[4, 8, 16]").replace("sum(d) * 63 /", "sum(d) * (SELECT max(z.idx) FROM sig_emb z WHERE z.series_id = s.series_id) /")
    return f"(SELECT series_id, {value} AS {alias} FROM ({sql}))"


_MEASURES = [("frac_katz", "fd", "katz"), ("frac_petrosian", "fd", "petrosian"), ("frac_higuchi", "fd", "higuchi"), ("frac_dfa", "alpha", "dfa"), ("ent_perm", "entropy", "perm_entropy"), ("ent_sample", "sampen", "sample_entropy")]
ORACLE["vid_pixel_measures"] = "SELECT series_id // 64 AS clip, series_id // 8 % 8 AS y, series_id % 8 AS px, " + ", ".join(a for _, _, a in _MEASURES) + " FROM " + " FULL JOIN ".join(_of_pixels(*m) + f" m{i}" + (" USING (series_id)" if i else "") for i, m in enumerate(_MEASURES))

_MOTION = (
    ", ps AS (SELECT clip, y, px, dense_rank() OVER (PARTITION BY clip ORDER BY frame) - 1 AS idx, v AS x FROM frame_emb), sh AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b), st AS (SELECT unnest({0})::BIGINT AS stride), "
    "sad AS (SELECT n.clip, stride, n.idx, n.y // 4 AS gy, n.px // 4 AS gx, dy, dx, avg(abs(n.x - t.x)) AS sad FROM ps n, sh, st, ps t WHERE t.clip = n.clip AND t.idx = n.idx - stride AND t.y = n.y - dy AND t.px = n.px - dx GROUP BY ALL HAVING count(*) = 16), "
    "bm AS (SELECT clip, stride, idx, gy, gx, arg_min(dy, (round(sad, 9), abs(dy) + abs(dx), dy, dx)) AS dy, arg_min(dx, (round(sad, 9), abs(dy) + abs(dx), dy, dx)) AS dx FROM sad GROUP BY ALL), "
    "mv AS (SELECT *, sqrt((dx * dx + dy * dy)::DOUBLE) AS m, lead(dx) OVER a - dx AS ux, lead(dy) OVER a - dy AS vx, lead(dx) OVER b - dx AS uy, lead(dy) OVER b - dy AS vy FROM bm WINDOW a AS (PARTITION BY clip, stride, idx, gy ORDER BY gx), b AS (PARTITION BY clip, stride, idx, gx ORDER BY gy)), "
    "dn AS (SELECT clip, stride, idx, count(*)::DOUBLE AS n FROM bm WHERE dx <> 0 OR dy <> 0 GROUP BY clip, stride, idx, (floor(atan2(dy, dx) / (pi() / 4) + 0.5)::BIGINT + 8) % 8), de AS (SELECT clip, stride, idx, -sum(n / total * log2(n / total)) / 3 AS e FROM (SELECT *, sum(n) OVER (PARTITION BY clip, stride, idx) AS total FROM dn) GROUP BY ALL), "
    "mo AS (SELECT clip, stride, idx, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.95), 6) AS p95, round(avg(dx), 6) + 0e0 AS u, round(avg(dy), 6) + 0e0 AS v, round(avg(coalesce(ux, 0) + coalesce(vy, 0)), 6) + 0e0 AS divergence, round(avg(coalesce(vx, 0) - coalesce(uy, 0)), 6) + 0e0 AS curl, round(coalesce(any_value(e), 0), 6) + 0e0 AS direction_entropy, round(avg((greatest(abs(dx), abs(dy)) = 1)::INT), 6) AS small, round(avg((greatest(abs(dx), abs(dy)) >= 2)::INT), 6) AS large FROM mv LEFT JOIN de USING (clip, stride, idx) GROUP BY clip, stride, idx)"
)


@query(_MOTION.format("[1, 3, 9]") + " SELECT * FROM mo", "frame_emb")
def vid_motion_strides(spark, d):
    """The motion summary at strides 1, 3 and 9, with the shares of small and of large steps."""
    m = fr.motion_at_strides(frame_emb(spark, d), 4, 2)
    return rounded(m, *[c for c, t in m.dtypes if t == "double"])


ORACLE["vid_motion"] = f"WITH frame_emb AS ({VIEW_SQL['frame_emb']})" + _MOTION.format("[1]") + " SELECT clip, idx, mean, p95, u, v, divergence, curl, direction_entropy FROM mo"

_HOURLY_RATE = """rate AS (SELECT series_id, t_s + gap / 2 AS t, 60 / nullif(gap, 0) AS x FROM (SELECT user_id % 8 AS series_id, t_s, lead(t_s) OVER (PARTITION BY user_id % 8 ORDER BY t_s) - t_s AS gap FROM (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t_s FROM events)) WHERE gap IS NOT NULL AND gap <> 0),
spans AS (SELECT series_id, min(t) AS a, max(t) AS b FROM rate GROUP BY series_id HAVING count(*) >= 3),
grid AS (SELECT series_id, k.range AS idx, k.range / (1 / 3600e0) AS t FROM spans, range(0, 2000) k WHERE k.range BETWEEN ceil(a * (1 / 3600e0)) AND greatest(ceil(a * (1 / 3600e0)), floor(b * (1 / 3600e0)))),
before AS (SELECT g.*, r.t AS i, r.x AS a FROM grid g ASOF LEFT JOIN rate r ON g.series_id = r.series_id AND g.t >= r.t),
around AS (SELECT b.*, r.t AS j, r.x AS b FROM before b ASOF LEFT JOIN rate r ON b.series_id = r.series_id AND b.t < r.t),
hr AS (SELECT series_id, idx, coalesce(CASE WHEN i = t THEN a ELSE a + (b - a) * ((t - i) / (j - i)) END, a, b) AS x FROM around)"""
_SEGMENTS = "(SELECT range AS w FROM range(40)) w"


def _beats(spark, d):
    return sig_events(spark, d).select((F.col("series_id") % 8).alias("series_id"), "t_s")


@query(None)
def feat_rate_spectrum(spark, d):
    """Low and high frequency power of the gridded event rate in windows, and their ratio; an hour stands for a quarter second."""
    found = cd.rate_spectrum(_beats(spark, d), 1 / 3600, 64, 32, [("lf", 0.04 / 14400, 0.15 / 14400), ("hf", 0.15 / 14400, 0.4 / 14400)], ["series_id"])
    return found.select("series_id", "w", *[(F.round(F.log10(c), 5) + 0.0).alias(c) for c in ("lf", "hf", "lf_hf")])


ORACLE["feat_rate_spectrum"] = f"""WITH {_HOURLY_RATE}, s AS (SELECT series_id, w.w, idx - w.w * 32 AS pos, x, count(*) OVER (PARTITION BY series_id, w.w) AS n FROM hr, {_SEGMENTS} WHERE idx >= w.w * 32 AND idx < w.w * 32 + 64),
h AS (SELECT series_id, w, pos, (x - avg(x) OVER (PARTITION BY series_id, w)) * (0.5e0 - 0.5e0 * cos(pos * 2 * pi() / 64)) AS x FROM s WHERE n = 64),
f AS (SELECT series_id, w, k.range AS k, sum(x * cos(k.range * pos * 2 * pi() / 64)) ** 2 + sum(x * sin(k.range * pos * 2 * pi() / 64)) ** 2 AS p FROM h, range(1, 32) k GROUP BY ALL),
b AS (SELECT series_id, w, sum(CASE WHEN k / 64e0 * 4 >= 0.04 AND k / 64e0 * 4 < 0.15 THEN 2 * p / (1 / 3600e0 * 24) END) AS lf, sum(CASE WHEN k / 64e0 * 4 >= 0.15 AND k / 64e0 * 4 < 0.4 THEN 2 * p / (1 / 3600e0 * 24) END) AS hf FROM f GROUP BY ALL)
SELECT series_id, w, round(log10(lf * (1 / 3600e0) / 64), 5) + 0e0 AS lf, round(log10(hf * (1 / 3600e0) / 64), 5) + 0e0 AS hf, round(log10(lf / hf), 5) + 0e0 AS lf_hf FROM b"""


@query(None)
def cpl_rate_envelope(spark, d):
    """Event rate against hourly click values: slow path on windowed means, fast path on the gridded rate, as metric rows."""
    from ..operators.series import filled

    envelope = filled(sig_hourly(spark, d).filter("channel = 'click'").select("series_id", "idx", "x"), ["series_id"])
    return rounded(cd.two_path_coupling(_beats(spark, d), envelope, 1 / 3600, 48, 24, (32, 16, 2 / 32 / 3600, 8 / 32 / 3600), ["series_id"], least=60), "value")


ORACLE["cpl_rate_envelope"] = f"""WITH sig_hourly AS ({VIEW_SQL['sig_hourly']}){_FILL}, {_HOURLY_RATE},
env AS (SELECT series_id, idx, x FROM filled WHERE channel = 'click' AND x IS NOT NULL), pr AS (SELECT hr.series_id, hr.idx, hr.x, env.x AS y FROM hr JOIN env ON hr.series_id = env.series_id AND hr.idx = env.idx),
ok AS (SELECT series_id FROM pr GROUP BY series_id HAVING count(*) >= 60 AND stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9), pg AS (SELECT * FROM pr WHERE series_id IN (SELECT series_id FROM ok)),
sw AS (SELECT series_id, w.w, avg(x) AS x, avg(y) AS y FROM pg, {_SEGMENTS} WHERE idx >= w.w * 24 AND idx < w.w * 24 + 48 GROUP BY ALL HAVING count(*) = 48),
slow AS (SELECT series_id, corr(x, y) AS value FROM sw GROUP BY series_id HAVING count(*) >= 3),
{coherence("coh", "pg", "series_id", 32, 16, 60, 32.0).replace("WHERE idx >= seg.seg * 16 AND idx < seg.seg * 16 + 32)", "WHERE idx >= seg.seg * 16 AND idx < seg.seg * 16 + 32 QUALIFY count(*) OVER (PARTITION BY series_id, seg.seg) = 32)")},
fast AS (SELECT series_id, avg(c) AS c, max(c) AS top FROM coh WHERE k BETWEEN 2 AND 8 GROUP BY series_id)
SELECT series_id, 'slow' AS path, 'r' AS metric, round(value, 6) + 0e0 AS value FROM slow UNION ALL SELECT series_id, 'fast', 'coherence', round(c, 6) FROM fast UNION ALL SELECT series_id, 'fast', 'peak_coherence', round(top, 6) FROM fast"""
