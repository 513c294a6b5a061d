"""Queries on fitted models: crossed effects, block effects, clustered logistic regression, ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossed as cr, models as md, series as op, statistics as st
from .registry import ORACLE, VIEW_SQL, query, rounded, sig_events, sig_hourly
from .signal import _FILL

_LEVELS = ["d0", "d1", "d2"]
_CONDITION = "'d' || (floor(t_s / 86400) % 3)::BIGINT"


def _conditions(spark, d):
    """Events as repeated measures: user x activity, the condition going round by the day."""
    return sig_events(spark, d).withColumn("condition", F.concat(F.lit("d"), (F.floor(F.col("t_s") / 86400) % 3).cast("long").cast("string")))


@query(
    f", v AS (SELECT series_id % 40 AS subject, channel, x, ({_CONDITION} = 'd1')::INT AS a, ({_CONDITION} = 'd2')::INT AS b FROM sig_events WHERE x IS NOT NULL) SELECT subject, channel, count(*)::BIGINT AS n, "
    + ", ".join(f"round(sum({e}), 4) + 0e0 AS {n}" for n, e in (("sy", "x"), ("yy", "x * x"), ("y_0", "a * x"), ("y_1", "b * x")))
    + ", sum(a)::BIGINT AS s_0, sum(b)::BIGINT AS s_1, sum(a * a)::BIGINT AS x_0_0, sum(a * b)::BIGINT AS x_0_1, sum(b * b)::BIGINT AS x_1_1 FROM v GROUP BY ALL",
    "sig_events",
)
def mdl_crossed_sums(spark, d):
    """All that a crossed model sees of its observations."""
    e = _conditions(spark, d).withColumn("subject", F.col("series_id") % 40).withColumns({f"l{i}": (F.col("condition") == level).cast("int") for i, level in enumerate(_LEVELS[1:])})
    sums = cr.crossed_sums(e, [], "subject", "channel", ["l0", "l1"], "x")
    whole = [c for c in sums.columns if c[:2] in ("s_", "x_")]
    return sums.withColumns({c: F.round(c, 4) + 0.0 for c in ("sy", "yy", "y_0", "y_1")} | {c: F.round(c).cast("long") for c in whole})


@query(None)
def mdl_crossed(spark, d):
    """Event value by day group, an intercept per user and per activity: terms, contrasts, omnibus and likelihood-ratio test."""
    e = _conditions(spark, d).withColumns({"subject": F.col("series_id") % 40, "model": F.lit("all")})
    m = cr.crossed_model(e, ["model"], "subject", "channel", "condition", _LEVELS, "x")
    return rounded(m, *[c for c, t in m.dtypes if t == "double"])


_BLOCKS = f"""WITH sig_hourly AS ({VIEW_SQL['sig_hourly']}){_FILL}, w AS (SELECT series_id, channel, w.w, avg(x) AS y, CASE WHEN channel IN ('click', 'view') THEN 0 ELSE 1 END AS b FROM filled, (SELECT range AS w FROM range(29)) w WHERE idx >= w.w * 24 AND idx < w.w * 24 + 48 GROUP BY ALL HAVING avg(x) IS NOT NULL),
c AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS yc, b - avg(b) OVER (PARTITION BY series_id) AS bc FROM w),
f AS (SELECT count(*)::BIGINT AS n_windows, count(DISTINCT series_id)::BIGINT AS n_subjects, sum(yc * bc) / sum(bc * bc) AS coefficient, sum(yc * yc) AS yy, sum(yc * bc) AS yb, sum(bc * bc) AS bb FROM c)"""


@query(None)
def mdl_window_block(spark, d):
    """Windows of hourly activity: value by block (rest or nature), an intercept per user bucket."""
    h = op.filled(sig_hourly(spark, d), ["series_id", "channel"])
    w = op.windowed(h, 48, 24, [F.avg("x").alias("value")], ["series_id", "channel"]).withColumn("block", F.when(F.col("channel").isin("click", "view"), "REST").otherwise("NATURE"))
    return rounded(cr.block_model(w, [], "series_id", "block", "REST", "NATURE"), "coefficient", "se", "z", "p").select("n_windows", "n_subjects", "coefficient")


# Every user bucket has the same share of both blocks, so its intercept drops out of the coefficient.
ORACLE["mdl_window_block"] = _BLOCKS + " SELECT n_windows, n_subjects, round(coefficient, 6) + 0e0 AS coefficient FROM f"


@query(None)
def mdl_gee_features(spark, d):
    """Two predictors at once, clustered by user, one model per activity."""
    e = sig_events(spark, d).withColumns({"label": (F.col("idx") % 2).cast("int"), "hour": F.floor(F.col("t_s") / 3600) % 24})
    m = md.gee(e, ["channel"], "series_id", ["x", "hour"], "label")
    return rounded(m, *[c for c, t in m.dtypes if t == "double"])


_ALL = ", r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, rank() OVER (ORDER BY p) AS k0, count(*) OVER () AS m FROM pv WHERE p IS NOT NULL AND NOT isnan(p))"
_P = "pv AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE round(abs(value), 2) / (1 + round(abs(value), 2)) END AS p FROM events)"


def _table_p(spark, d):
    """Numbers between 0 and 1 with many ties, and some missing: one family, as large as the table."""
    from .registry import table

    a = F.round(F.abs("value"), 2)
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 7, a / (1 + a)).alias("p"))


@query(f"WITH {_P}{_ALL}, q AS (SELECT event_id, least(1, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_fdr FROM r) SELECT pv.event_id, pv.p, round(p_fdr, 9) AS p_fdr FROM pv LEFT JOIN q USING (event_id)")
def stat_bh_fdr_whole(spark, d):
    """Benjamini-Hochberg over a whole table as one family, ranked by many tasks."""
    return st.bh_fdr(_table_p(spark, d)).withColumn("p_fdr", F.round("p_fdr", 9))


@query(f"WITH {_P}{_ALL}, q AS (SELECT event_id, least(1, max(p * (m - k0 + 1)) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING)) AS p_holm FROM r) SELECT pv.event_id, pv.p, round(p_holm, 9) AS p_holm FROM pv LEFT JOIN q USING (event_id)")
def stat_holm_whole(spark, d):
    return st.holm(_table_p(spark, d)).withColumn("p_holm", F.round("p_holm", 9))
