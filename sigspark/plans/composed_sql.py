"""SQL for queries that join several operators: built from the parts' SQL, or from the tables they share."""

from __future__ import annotations

from .coupled import _BIN, _XC
from .registry import ORACLE, VIEW_SQL
from .signal import _FILL
from .spectrum import _PSD

_PAIRS = f"pair_emb AS ({VIEW_SQL['pair_emb']})"
_SERIES = f"sig_emb AS ({VIEW_SQL['sig_emb']})"
TWO_PI = "2 * pi()"


def part(name: str, columns: str) -> str:
    return f"(SELECT {columns} FROM ({ORACLE[name]}))"


def side_by_side(keys: str, parts: list[str]) -> str:
    """The parts joined on ``keys``; what one lacks is null."""
    joined = parts[0] + " p0"
    for i, p in enumerate(parts[1:], 1):
        joined += f" FULL JOIN {p} p{i} USING ({keys})"
    return f"SELECT * FROM {joined}"


def windows(name: str, keys: str, width: int, step: int, n: int, values: str = "x, y", source: str = "pair_emb") -> str:
    return f"{name} AS (SELECT {keys}, w.w, idx - w.w * {step} AS pos, {values} FROM {source}, (SELECT range AS w FROM range({n})) w WHERE idx >= w.w * {step} AND idx < w.w * {step} + {width})"


def analytic(name: str, source: str, keys: str, n: int, low: int, high: int, pos: str) -> str:
    """ax, bx, ay, by: the analytic signals of x and y in the Fourier bins low to high - 1."""
    angle, back = f"{TWO_PI} * k.range * {pos} / {n}", f"{TWO_PI} * k * i.range / {n}"
    sums = ", ".join(f"sum({v} * cos({angle})) AS {v}r, -sum({v} * sin({angle})) AS {v}i" for v in "xy")
    inverse = ", ".join(f"sum({v}r * cos({back}) - {v}i * sin({back})) / {n // 2} AS a{v}, sum({v}r * sin({back}) + {v}i * cos({back})) / {n // 2} AS b{v}" for v in "xy")
    inverse = inverse.replace(" AS by", ' AS "by"')
    return f"{name}_b AS (SELECT {keys}, k.range AS k, {sums} FROM {source}, range({low}, {high}) k GROUP BY ALL), {name} AS (SELECT {keys}, i.range AS idx, {inverse} FROM {name}_b, range({n}) i GROUP BY ALL)"


def phase(source: str, keys: str) -> str:
    """plv, mean_phase, pli_sin, wpli, not rounded."""
    return (
        f"SELECT {keys}, sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2) AS plv, atan2(avg(sin(d)), avg(cos(d))) AS mean_phase, abs(avg(sin(d))) / (avg(abs(sin(d))) + 1e-12) AS pli_sin, abs(avg(im)) / (avg(abs(im)) + 1e-12) AS wpli "
        f'FROM (SELECT {keys}, bx * ay - ax * "by" AS im, atan2(bx * ay - ax * "by", ax * ay + bx * "by") AS d FROM {source}) GROUP BY {keys}'
    )


def phase_amplitude(name: str, source: str, keys: str) -> str:
    """mi, mvl, mvl_norm, preferred_phase of the columns phase and amp, as table ``name``."""
    return (
        f"{name}_q AS (SELECT {keys}, least(floor((phase + pi()) / ({TWO_PI} / 18)), 17) AS bin, avg(amp) AS m FROM {source} GROUP BY ALL), {name}_s AS (SELECT {keys}, m / sum(m) OVER (PARTITION BY {keys}) AS q FROM {name}_q), "
        f"{name}_m AS (SELECT {keys}, 1 + sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(18) AS mi FROM {name}_s GROUP BY {keys}), {name}_v AS (SELECT {keys}, avg(amp * cos(phase)) AS c, avg(amp * sin(phase)) AS s, avg(amp) AS a FROM {source} GROUP BY {keys}), "
        f"{name} AS (SELECT {keys}, mi, sqrt(c * c + s * s) AS mvl, sqrt(c * c + s * s) / a AS mvl_norm, atan2(s, c) AS preferred_phase FROM {name}_m JOIN {name}_v USING ({keys}))"
    )


def coherence(name: str, source: str, keys: str, n: int, step: int, segments: int, fs: float, pos: str = "idx") -> str:
    """k, f, c of x and y over Hann segments, as table ``name``."""
    angle = f"{TWO_PI} * k.range * p / {n}"
    hann = f"(0.5e0 - 0.5e0 * cos({TWO_PI} * p / {n}))"
    sums = ", ".join(f"sum({v} * cos({angle})) AS {v}r, -sum({v} * sin({angle})) AS {v}i" for v in "xy")
    return (
        f"{name}_s AS (SELECT {keys}, seg.seg, {pos} - seg.seg * {step} AS p, x, y FROM {source}, (SELECT range AS seg FROM range({segments})) seg WHERE {pos} >= seg.seg * {step} AND {pos} < seg.seg * {step} + {n}), "
        f"{name}_h AS (SELECT {keys}, seg, p, (x - avg(x) OVER g) * {hann} AS x, (y - avg(y) OVER g) * {hann} AS y FROM {name}_s WINDOW g AS (PARTITION BY {keys}, seg)), {name}_b AS (SELECT {keys}, seg, k.range AS k, {sums} FROM {name}_h, range({n // 2 + 1}) k GROUP BY ALL), "
        f"{name} AS (SELECT {keys}, k, k * {fs / n}e0 AS f, (avg(xr * yr + xi * yi) ** 2 + avg(xi * yr - xr * yi) ** 2) / nullif(avg(xr * xr + xi * xi) * avg(yr * yr + yi * yi), 0) AS c FROM {name}_b GROUP BY ALL)"
    )


def rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in columns.split(", "))


_FRACTALS = [part("frac_higuchi", "series_id, fd AS higuchi"), part("frac_katz", "series_id, fd AS katz"), part("frac_petrosian", "series_id, fd AS petrosian"), f"(SELECT series_id, alpha AS dfa FROM ({ORACLE['frac_dfa'].replace('[4, 8, 16, 32]', '[8, 16, 32]')}))", part("frac_hurst", "series_id, hurst")]
ORACLE["frac_all"] = side_by_side("series_id", _FRACTALS)

ORACLE["ent_lempel_ziv"] = f"""WITH RECURSIVE {_SERIES}, m AS (SELECT series_id, quantile_cont(x, 0.5) AS md FROM sig_emb GROUP BY series_id),
s AS (SELECT series_id, string_agg(CASE WHEN x > md THEN '1' ELSE '0' END, '' ORDER BY idx) AS s FROM sig_emb JOIN m USING (series_id) GROUP BY series_id),
lz AS (SELECT series_id, s, 0::BIGINT AS done, 0::BIGINT AS phrases FROM s UNION ALL
  SELECT series_id, s, done + coalesce(list_filter(range(1, length(s) - done + 1), lambda k: NOT contains(substr(s, 1, done + k - 1), substr(s, done + 1, k)))[1], length(s) - done + 1), phrases + 1 FROM lz WHERE done < length(s))
SELECT series_id, round(max(phrases) * log2(any_value(length(s))) / any_value(length(s)), 6) AS lzc FROM lz GROUP BY series_id"""

# Eigenvalues of a symmetric matrix of three rows in closed form.
ORACLE["ent_svd"] = f"""WITH {_SERIES}, t AS (SELECT series_id, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM sig_emb WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
g AS (SELECT series_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM t WHERE c IS NOT NULL GROUP BY series_id),
q AS (SELECT *, (aa + bb + cc) / 3 AS q FROM g), p AS (SELECT *, sqrt(((aa - q) ** 2 + (bb - q) ** 2 + (cc - q) ** 2 + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS p FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / (2 * p ** 3)))) / 3 AS phi FROM p),
e AS (SELECT series_id, unnest([q + 2 * p * cos(phi), q + 2 * p * cos(phi + 2 * pi() / 3), 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3))]) AS e FROM r),
s AS (SELECT series_id, sqrt(greatest(e, 0)) AS s FROM e), v AS (SELECT series_id, s / sum(s) OVER (PARTITION BY series_id) AS v FROM s)
SELECT series_id, round(-sum(CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END) / log2(3), 6) AS entropy FROM v GROUP BY series_id"""

ORACLE["ent_all"] = side_by_side("series_id", [part("ent_perm", "series_id, entropy AS perm_entropy"), part("ent_spectral", "series_id, entropy AS spectral_entropy"), part("ent_sample", "series_id, sampen AS sample_entropy"), part("ent_svd", "series_id, entropy AS svd_entropy"), part("ent_lempel_ziv", "series_id, lzc")])

_BANDS = [("low", 2, 5), ("mid", 5, 12), ("high", 12, 24)]
ORACLE["cpl_band_phase"] = f"WITH {_PAIRS}, " + ", ".join(analytic(f"an_{b}", "pair_emb", "pair_id", 64, lo, hi, "idx") for b, lo, hi in _BANDS) + " SELECT pair_id, band, " + rounded("plv, mean_phase, pli_sin, wpli") + " FROM (" + " UNION ALL ".join(f"SELECT *, '{b}' AS band FROM ({phase(f'an_{b}', 'pair_id')})" for b, _, _ in _BANDS) + ")"

_SLOW, _FAST = [(2, 4), (4, 6)], [(12, 18), (18, 24)]
ORACLE["cpl_comodulogram"] = (
    f"WITH {_PAIRS}, " + ", ".join(analytic(f"an_{lo}", "pair_emb", "pair_id", 64, lo, hi, "idx") for lo, hi in _SLOW + _FAST)
    + ", pa AS (" + " UNION ALL ".join(f'SELECT s.pair_id, {a[0]}::BIGINT AS phase_low, {b[0]}::BIGINT AS amp_low, atan2(s.bx, s.ax) AS phase, sqrt(f.ay ** 2 + f."by" ** 2) AS amp FROM an_{a[0]} s JOIN an_{b[0]} f ON s.pair_id = f.pair_id AND s.idx = f.idx' for a in _SLOW for b in _FAST)
    + "), " + phase_amplitude("pac", "pa", "pair_id, phase_low, amp_low") + " SELECT pair_id, phase_low, amp_low, " + rounded("mi, mvl, mvl_norm, preferred_phase") + " FROM pac"
)

ORACLE["cpl_phase_windowed"] = f"WITH {_PAIRS}, {windows('pw', 'pair_id', 32, 8, 5)}, {analytic('an', 'pw', 'pair_id, w', 32, 2, 6, 'pos')} SELECT pair_id, w, {rounded('plv, mean_phase, pli_sin, wpli')} FROM ({phase('an', 'pair_id, w')})"
ORACLE["cpl_coherence_windowed"] = f"""WITH {_PAIRS}, {windows("pw", "pair_id", 32, 16, 3)}, {coherence("coh", "pw", "pair_id, w", 8, 4, 7, 64.0, "pos")}
SELECT pair_id, w AS "window", round(avg(c), 6) AS mean, round(arg_max(c, (round(c, 9), -k)), 6) AS peak, arg_max(f, (round(c, 9), -k)) AS peak_f FROM coh WHERE f BETWEEN 8 AND 24 GROUP BY ALL"""
ORACLE["cpl_pac_windowed"] = (
    f"WITH {_PAIRS}, {windows('pw', 'pair_id', 32, 16, 3)}, {analytic('s', 'pw', 'pair_id, w', 32, 1, 4, 'pos')}, {analytic('f', 'pw', 'pair_id, w', 32, 6, 12, 'pos')}, "
    f'pa AS (SELECT s.pair_id, s.w, atan2(s.bx, s.ax) AS phase, sqrt(f.ay ** 2 + f."by" ** 2) AS amp FROM s JOIN f ON s.pair_id = f.pair_id AND s.w = f.w AND s.idx = f.idx), {phase_amplitude("pac", "pa", "pair_id, w")} SELECT pair_id, w, {rounded("mi, mvl, mvl_norm, preferred_phase")} FROM pac'
)

# The sides of pair k are the series 2k and 2k + 1.
_CURVES = ORACLE["ent_multiscale"].replace("0.2e0", "0.3e0").replace("round(-ln(n_long / n_short), 6) + 0e0", "-ln(n_long / n_short)")
ORACLE["cpl_mse_matching"] = f"SELECT pair_id, CASE WHEN NOT isnan(corr(a, b)) THEN round(corr(a, b), 6) + 0e0 END AS match FROM (SELECT series_id // 2 AS pair_id, scale, max(sampen) FILTER (series_id % 2 = 0) AS a, max(sampen) FILTER (series_id % 2 = 1) AS b FROM ({_CURVES}) WHERE series_id // 2 IN (SELECT a.vec_id // 2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) GROUP BY ALL) GROUP BY pair_id"
ORACLE["cpl_complexity"] = f"""WITH {_PAIRS}, {windows("pw", "pair_id", 32, 8, 5)}, l AS (SELECT pair_id, w, pos, 'x' AS side, x AS v FROM pw UNION ALL SELECT pair_id, w, pos, 'y', y FROM pw),
c AS (SELECT *, v - avg(v) OVER (PARTITION BY pair_id, w, side) AS c FROM l), p AS (SELECT pair_id, w, side, pos, sum(c) OVER (PARTITION BY pair_id, w, side ORDER BY pos) AS x FROM c),
b AS (SELECT pair_id, w, side, s.s, pos // s.s AS seg, (regr_syy(x, pos) - regr_sxy(x, pos) ** 2 / regr_sxx(x, pos)) / count(*) AS v FROM p, (SELECT unnest([4, 8])::BIGINT AS s) s GROUP BY ALL HAVING count(*) = s.s),
d AS (SELECT pair_id, w, side, s, sqrt(greatest(avg(v), 0)) AS f FROM b GROUP BY ALL), e AS (SELECT pair_id, w, side, regr_slope(ln(f), ln(s)) AS alpha FROM d WHERE f > 0 GROUP BY ALL)
SELECT pair_id, round(corr(a, b), 6) + 0e0 AS match FROM (SELECT pair_id, w, max(alpha) FILTER (side = 'x') AS a, max(alpha) FILTER (side = 'y') AS b FROM e GROUP BY ALL) GROUP BY pair_id"""
ORACLE["cpl_multiscale_cross_entropy"] = f"""WITH {_PAIRS}, z AS (SELECT pair_id, idx, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y FROM pair_emb WINDOW w AS (PARTITION BY pair_id)),
g AS (SELECT pair_id, s.s AS scale, idx // s.s AS idx, avg(x) AS x, avg(y) AS y FROM z, (SELECT unnest([1, 2, 4])::BIGINT AS s) s GROUP BY ALL HAVING count(*) = s.s),
t AS (SELECT pair_id, scale, idx, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c, y AS d, lead(y) OVER w AS e, lead(y, 2) OVER w AS f FROM g WINDOW w AS (PARTITION BY pair_id, scale ORDER BY idx)),
m AS (SELECT t.pair_id, t.scale, count(*) AS n_short, count(*) FILTER (abs(t.c - u.f) < 0.3) AS n_long FROM t JOIN t u ON t.pair_id = u.pair_id AND t.scale = u.scale AND abs(t.a - u.d) < 0.3 AND abs(t.b - u.e) < 0.3 WHERE t.c IS NOT NULL AND u.f IS NOT NULL GROUP BY ALL)
SELECT p.pair_id, p.scale, coalesce(n_short, 0)::BIGINT AS n_short, coalesce(n_long, 0)::BIGINT AS n_long, CASE WHEN n_long > 0 THEN round(-ln(n_long / n_short), 6) + 0e0 END AS sampen FROM (SELECT DISTINCT pair_id, scale FROM g) p LEFT JOIN m ON p.pair_id = m.pair_id AND p.scale = m.scale"""

_FP = (
    f"WITH {_PAIRS}" + _XC + _BIN + f", {coherence('coh', 'pair_emb', 'pair_id', 16, 8, 7, 64.0)}, {analytic('an', 'pair_emb', 'pair_id', 64, 4, 21, 'idx')}, ph AS ({phase('an', 'pair_id')}), "
    "n AS (SELECT pair_id, x, y, count(*)::DOUBLE AS n FROM bins GROUP BY ALL), nn AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, x) AS nx, sum(n) OVER (PARTITION BY pair_id, y) AS ny, sum(n) OVER (PARTITION BY pair_id) AS total FROM n), mi AS (SELECT pair_id, sum(n / total * ln(n * total / (nx * ny))) AS mi_nats FROM nn GROUP BY pair_id), "
    "tops AS (SELECT pair_id, w, arg_max(r, (round(abs(r), 9), -lag)) AS r FROM xc GROUP BY ALL), fp AS (SELECT pair_id, xcorr_peak, coherence, plv, pli_sin, mi_nats FROM (SELECT pair_id, avg(abs(r)) AS xcorr_peak FROM tops GROUP BY pair_id) JOIN (SELECT pair_id, avg(c) AS coherence FROM coh WHERE f BETWEEN 4 AND 20 GROUP BY pair_id) USING (pair_id) JOIN ph USING (pair_id) JOIN mi USING (pair_id))"
)
_MEASURES = ["xcorr_peak", "coherence", "plv", "pli_sin", "mi_nats"]
ORACLE["cpl_fingerprint"] = _FP + f" SELECT pair_id, {rounded(', '.join(_MEASURES))} FROM fp"
ORACLE["cpl_fingerprint_long"] = _FP + " " + " UNION ALL ".join(f"SELECT pair_id, '{m}' AS metric, round({m}, 6) + 0e0 AS value FROM fp" for m in _MEASURES)
ORACLE["cpl_sensitivity"] = _FP + ", means AS (SELECT pair_id % 10 AS \"case\", " + ", ".join(f"avg({m}) AS {m}" for m in _MEASURES) + " FROM fp GROUP BY ALL) SELECT \"case\", " + ", ".join(f"round({m} / nullif(max(abs({m})) OVER (), 0), 6) + 0e0 AS {m}" for m in _MEASURES) + " FROM means"

_ON_GRID = """, ends AS (SELECT channel, min(e) AS e FROM (SELECT channel, series_id, max(t_s) AS e FROM sig_events GROUP BY ALL) GROUP BY channel),
grid AS (SELECT s.channel, s.series_id, k.range * 86400e0 AS t FROM (SELECT DISTINCT channel, series_id FROM sig_events) s JOIN ends USING (channel), range(0, 400) k WHERE k.range <= floor(e / 86400)),
before AS (SELECT g.channel, g.series_id, g.t, e.t_s AS i, e.x AS a FROM grid g ASOF LEFT JOIN sig_events e ON g.channel = e.channel AND g.series_id = e.series_id AND g.t >= e.t_s),
around AS (SELECT b.*, e.t_s AS j, e.x AS b FROM before b ASOF LEFT JOIN sig_events e ON b.channel = e.channel AND b.series_id = e.series_id AND b.t < e.t_s),
v AS (SELECT channel, t, CASE WHEN i = t THEN a ELSE a + (b - a) * ((t - i) / (j - i)) END AS x FROM around)
SELECT channel, t, round(avg(x), 6) + 0e0 AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS sem, count(x)::BIGINT AS n FROM v GROUP BY channel, t HAVING count(x) >= 2"""
ORACLE["sig_common_grid"] = f"WITH sig_events AS ({VIEW_SQL['sig_events']}){_ON_GRID}"

_SPATIAL = [part("vid_edges", "*"), part("vid_radial_slope", "*"), part("vid_fft_shape", "*"), part("vid_box_counting", "*"), f"(SELECT clip, frame, lacunarity FROM ({ORACLE['vid_lacunarity'].replace('round(avg(ln(l)), 7)', 'round(avg(ln(l)), 6)').replace('v + 1)', 'v + 0.5e0)')}))", part("vid_patch_entropy", "clip, frame, mean AS patch_mean, sd AS patch_sd, p95 AS patch_p95, spread AS patch_spread"), part("vid_glcm", "clip, frame, contrast AS glcm_contrast, homogeneity AS glcm_homogeneity")]
ORACLE["vid_spatial_complexity"] = side_by_side("clip, frame", _SPATIAL)
ORACLE["vid_quantified"] = side_by_side("clip, frame", [part("vid_global", "*"), *_SPATIAL])


def t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, by its finite series in the cosine of atan(t / sqrt(df))."""
    c2, s = f"({df} / ({df} + ({t}) ** 2))", f"(abs({t}) / sqrt({df} + ({t}) ** 2))"
    even = f"{s} * list_sum(list_transform(range(0, ({df} / 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * {c2} ** k))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c2}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) / 2)::BIGINT), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * {c2} ** k)), 0))"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def fdr(source: str, by: str = "") -> str:
    """``source`` with p_fdr, Benjamini-Hochberg over p."""
    part_by = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, least(1, min(p * m / k) OVER ({part_by}ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM (SELECT *, row_number() OVER ({part_by}ORDER BY p) AS k, count(*) OVER ({part_by.strip()}) AS m FROM {source})"


def _unrounded(name: str, *expressions: str) -> str:
    sql = ORACLE[name]
    for e in expressions:
        digits = sql[sql.index(f"round({e}, ") + len(f"round({e}, ") :].split(")")[0]
        sql = sql.replace(f"round({e}, {digits})", f"({e})")
    return sql


_T = "avg(z) / (stddev_samp(z) / sqrt(count(z)))"
ORACLE["cpl_peak_significance"] = f"WITH t AS ({_unrounded('cpl_peak_statistic', _T, 'avg(z)')}), p AS (SELECT *, {t_p('t', 'df')} AS p FROM t) SELECT channel, n, round(mean, 6) + 0e0 AS mean_z, round(t, 6) + 0e0 AS t, round(p, 6) + 0e0 AS p, round(p_fdr, 6) + 0e0 AS p_fdr FROM ({fdr('p')})"
_T = "avg(diff) / (stddev_samp(diff) / sqrt(count(diff)))"
ORACLE["stat_paired_t_p"] = f"WITH t AS ({_unrounded('stat_paired_t', _T, 'avg(diff)')}), p AS (SELECT *, {t_p('t', 'df')} AS p FROM t) SELECT other, n, df, {rounded('mean, t, p, p_fdr')} FROM ({fdr('p')})"
ORACLE["cpl_corr_p"] = f"WITH {_PAIRS}, c AS (SELECT pair_id, corr(x, y) AS r, count(*)::BIGINT AS n FROM pair_emb GROUP BY pair_id), t AS (SELECT *, r * sqrt((n - 2) / (1 - r ** 2)) AS t FROM c), p AS (SELECT *, {t_p('t', '(n - 2)')} AS p FROM t) SELECT pair_id, n, {rounded('r, t, p, p_fdr')} FROM ({fdr('p')})"
# Five conditions leave four degrees of freedom.
_CHI2 = "(12e0 / (n * 30) * ss - 18e0 * n) / (1 - ties / (n * 120e0))"
ORACLE["stat_friedman_p"] = f"SELECT n, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p FROM ({_unrounded('stat_friedman', _CHI2).replace('round(value, -2) AS value', 'value')})"
ORACLE["stat_window_blocks"] = f"""WITH sig_hourly AS ({VIEW_SQL['sig_hourly']}){_FILL}, w AS (SELECT series_id, channel, w.w, avg(x) AS value FROM filled, (SELECT range AS w FROM range(29)) w WHERE idx >= w.w * 24 AND idx < w.w * 24 + 48 GROUP BY ALL),
bl AS (SELECT series_id, avg(value) FILTER (channel IN ('click', 'view')) AS first, avg(value) FILTER (channel NOT IN ('click', 'view')) AS second FROM w GROUP BY series_id), d AS (SELECT second - first AS diff FROM bl WHERE first IS NOT NULL AND second IS NOT NULL),
t AS (SELECT count(diff)::BIGINT AS n, avg(diff) AS mean, {_T} AS t, (count(diff) - 1)::DOUBLE AS df FROM d) SELECT n, df, {rounded('mean, t, p')} FROM (SELECT *, {t_p('t', 'df')} AS p FROM t)"""

_SHAPE = _PSD.lstrip(" ,")
ORACLE["feat_complexity_summary"] = side_by_side(
    "series_id",
    [
        part("ent_all", "*"), part("frac_all", "*"), part("feat_hjorth", "*"),
        f"(WITH {_SERIES}, {_SHAPE} SELECT series_id, round(sum(p), 6) AS power, round(sum(f * p) / sum(p), 6) AS centroid, round(sqrt(sum(f * f * p) / sum(p) - (sum(f * p) / sum(p)) ** 2), 6) AS bandwidth, round(regr_slope(CASE WHEN k > 0 THEN ln(p) END, CASE WHEN k > 0 THEN ln(f) END), 6) + 0e0 AS psd_slope FROM psd GROUP BY series_id)",
        f"(SELECT series_id, round(sum(sampen), 6) + 0e0 AS mse_area FROM ({ORACLE['ent_multiscale'].replace('round(-ln(n_long / n_short), 6) + 0e0', '-ln(n_long / n_short)')}) GROUP BY series_id)",
    ],
)

ORACLE["feat_windowed_complexity_pairs"] = f"SELECT series_id // 2 AS pair_id, series_id % 2 AS w, * EXCLUDE (series_id) FROM ({ORACLE['feat_complexity_summary']})"

_RATE = f"WITH sig_events AS ({VIEW_SQL['sig_events']}), g AS (SELECT series_id, t_s, lead(t_s) OVER (PARTITION BY series_id ORDER BY t_s) - t_s AS gap FROM sig_events), rate AS (SELECT series_id, t_s + gap / 2 AS t, 60 / nullif(gap, 0) AS x FROM g WHERE gap IS NOT NULL AND gap <> 0)"
ORACLE["feat_rate_on_grid"] = _RATE + """, spans AS (SELECT series_id, min(t) AS a, max(t) AS b FROM rate GROUP BY series_id HAVING count(*) >= 3),
grid AS (SELECT series_id, k.range AS idx, k.range / (1 / 3600e0) AS t FROM spans, range(0, 2000) k WHERE k.range BETWEEN ceil(a * (1 / 3600e0)) AND greatest(ceil(a * (1 / 3600e0)), floor(b * (1 / 3600e0)))),
before AS (SELECT g.*, r.t AS i, r.x AS a FROM grid g ASOF LEFT JOIN rate r ON g.series_id = r.series_id AND g.t >= r.t),
around AS (SELECT b.*, r.t AS j, r.x AS b FROM before b ASOF LEFT JOIN rate r ON b.series_id = r.series_id AND b.t < r.t)
SELECT series_id, idx, t, round(coalesce(CASE WHEN i = t THEN a ELSE a + (b - a) * ((t - i) / (j - i)) END, a, b), 6) + 0e0 AS x FROM around"""
