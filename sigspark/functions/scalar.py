"""Scalar expressions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is 0."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def corr(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson's r over the rows that have both; null where one side does not vary. An aggregate."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x).cast("double")), F.when(both, _c(y).cast("double"))
    r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def clean(x: ColumnLike) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(_c(x)), _c(x))


def fisher_z(r: ColumnLike) -> Column:
    return F.atanh(F.greatest(F.least(_c(r), F.lit(0.9999)), F.lit(-0.9999)))


def inverse_fisher_z(z: ColumnLike) -> Column:
    return F.tanh(_c(z))


def significance(p: ColumnLike) -> Column:
    p = _c(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "~").otherwise("ns")


def p_text(p: ColumnLike) -> Column:
    return F.when(_c(p) < 0.001, F.lit("p < 0.001")).otherwise(F.format_string("p = %.3f", _c(p)))


def wrapped(angle: ColumnLike) -> Column:
    """The same angle in (-pi, pi]."""
    return F.atan2(F.sin(_c(angle)), F.cos(_c(angle)))


def percent_change(new: ColumnLike, old: ColumnLike, limit: float = 500.0) -> Column:
    change = 100.0 * (_c(new) - _c(old)) / (F.abs(_c(old)) + 1e-10)
    return F.greatest(F.least(change, F.lit(limit)), F.lit(-limit))


def directionality(p_forward: ColumnLike, p_backward: ColumnLike) -> Column:
    floor = F.lit(1e-300)
    return F.coalesce(F.log10(F.greatest(_c(p_backward), floor)) - F.log10(F.greatest(_c(p_forward), floor)), F.lit(0.0))


def clock_seconds(text: ColumnLike) -> Column:
    """``ss``, ``mm:ss`` or ``hh:mm:ss`` as seconds; null where a part is no number."""
    parts = F.transform(F.split(F.trim(_c(text)), ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60.0 + p)


def clock_text(seconds: ColumnLike) -> Column:
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))


def subject_key(text: ColumnLike) -> Column:
    """``sub-02``, ``02`` and ``2`` name the same subject."""
    return F.lpad(F.regexp_extract(_c(text).cast("string"), r"([0-9]+)$", 1), 2, "0")


def uniform(*parts: ColumnLike) -> Column:
    """A pseudo-random integer below 2 to the 32 from these values: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
