"""Triggers, labels, segments and as-of joins on recordings: (keys, idx, ...) rows of regular samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .series import KEYS, ordered, whole


def zipped(frames: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Columns of several recordings side by side by row number; the shorter ones end in nulls."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, [*keys, "idx"], "full_outer")
    return out


def from_first_trigger(df: DataFrame, trigger: str, keys: list[str] = KEYS) -> DataFrame:
    """Drops what comes before the first nonzero trigger and counts from there."""
    first = F.min(F.when(F.col(trigger) != 0, F.col("idx"))).over(whole(keys))
    return df.withColumn("_first", first).filter("idx >= _first").withColumn("idx", F.col("idx") - F.col("_first")).drop("_first")


def last_of_runs(df: DataFrame, high: Column, keys: list[str] = KEYS) -> DataFrame:
    """The last row of every run of rows for which ``high`` holds; a run may touch the end."""
    marked = df.withColumn("_high", F.coalesce(high, F.lit(False)))
    return marked.withColumn("_next", F.coalesce(F.lead("_high").over(ordered(keys)), F.lit(False))).filter("_high AND NOT _next").drop("_high", "_next")


def runs(df: DataFrame, high: Column, keys: list[str] = KEYS) -> DataFrame:
    """first, last and length of every run: gaps and islands."""
    kept = df.filter(high).withColumn("_island", F.col("idx") - F.row_number().over(ordered(keys)))
    return kept.groupBy(*keys, "_island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("length")).drop("_island")


def patched(triggers: DataFrame, patches: DataFrame, fs: float, keys: list[str] = KEYS) -> DataFrame:
    """Adds a trigger some seconds after the last one, then removes the k-th from the end.

    ``patches``: keys, add_after_last_s (null: none), remove (array of places from the end, 1 for the last).
    """
    last = triggers.groupBy(*keys).agg(F.max("idx").alias("_last")).join(patches, keys)
    added = last.filter("add_after_last_s IS NOT NULL").select(*keys, (F.col("_last") + F.round(F.col("add_after_last_s") * fs).cast("long")).alias("idx"))
    every = triggers.select(*keys, "idx").unionByName(added).withColumn("_back", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("idx"))))
    gone = patches.select(*keys, F.explode("remove").alias("_back"))
    return every.join(gone, [*keys, "_back"], "left_anti").drop("_back")


def merged_triggers(triggers: DataFrame, gap: float, keys: list[str] = KEYS) -> DataFrame:
    """Drops a trigger that follows the last one kept by less than ``gap`` samples. What is kept depends on what was kept
    before, so each subject's short trigger list is folded in order."""
    lists = triggers.groupBy(*keys).agg(F.sort_array(F.collect_list("idx")).alias("_all"))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate("_all", none, lambda got, i: F.when((F.size(got) == 0) | (i - F.element_at(got, -1) >= gap), F.concat(got, F.array(i))).otherwise(got))
    return lists.select(*keys, F.explode(kept).alias("idx"))


def annotated(triggers: DataFrame, order: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Labels triggers: the last two per condition are its start and stop, in the order given; earlier ones are AUDIO_SYNC.

    ``order``: keys, conditions (array). Subjects with fewer than two triggers per condition are left out.
    """
    back = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("idx"))) - 1
    t = triggers.join(order, keys).withColumn("_back", back).withColumn("_n", F.count("*").over(whole(keys))).withColumn("_need", 2 * F.size("conditions")).filter("_n >= _need")
    place = F.col("_need") - 1 - F.col("_back")
    name = F.concat(F.element_at("conditions", (F.floor(place / 2) + 1).cast("int")), F.when(place % 2 == 0, "_start").otherwise("_stop"))
    return t.select(*keys, "idx", F.when(F.col("_back") >= F.col("_need"), "AUDIO_SYNC").otherwise(name).alias("label"))


def trimmed(df: DataFrame, labels: DataFrame, keys: list[str] = KEYS, label: str = "AUDIO_SYNC") -> DataFrame:
    """Samples from the last such label on."""
    last = labels.filter(F.col("label") == label).groupBy(*keys).agg(F.max("idx").alias("_at"))
    return df.join(last, keys).filter("idx >= _at").withColumn("idx", F.col("idx") - F.col("_at")).drop("_at")


def segments(labels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """condition, start, stop of every start that has a stop after it."""
    named = labels.filter(F.col("label").rlike("_(start|stop)$")).select(*keys, F.regexp_replace("label", "_(start|stop)$", "").alias("condition"), F.regexp_extract("label", "_(start|stop)$", 1).alias("_end"), "idx")
    both = named.groupBy(*keys, "condition").agg(F.min(F.when(F.col("_end") == "start", F.col("idx"))).alias("start"), F.max(F.when(F.col("_end") == "stop", F.col("idx"))).alias("stop"))
    return both.filter("start < stop")


def sliced(df: DataFrame, pieces: DataFrame, keys: list[str] = KEYS, closed: str = "left") -> DataFrame:
    """The samples of each segment, [start, stop) or with both ends: an equi-join on the series, then the range."""
    inside = (F.col("idx") >= F.col("start")) & ((F.col("idx") <= F.col("stop")) if closed == "both" else (F.col("idx") < F.col("stop")))
    return df.join(pieces, keys).filter(inside)


def nearest(left: DataFrame, right: DataFrame, tolerance: float, keys: list[str] = KEYS, t: str = "t_s", value: str = "value") -> DataFrame:
    """``left`` (keys, t, ...) with the value of the nearest ``right`` row (keys, t, value) within the tolerance.

    At equal distance the earlier row wins; of right rows at one time the last value by order counts. Both sides are sorted
    once per series together; there is no range join.
    """
    names = [c for c in left.columns if c not in keys and c != t]
    l = left.select(*keys, t, F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"), F.struct(*[F.col(c) for c in names]).alias("_rest"))  # noqa: E741
    r = right.select(*keys, t, F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(l.schema["_rest"].dataType).alias("_rest"))
    w = W.partitionBy(*keys).orderBy(t, "_side", "_v")
    seen = F.when(F.col("_side") == 0, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    # Backward: the last row at or before; forward: the first row after, or the last of those at the same time.
    both = l.unionByName(r).withColumns({"_p": F.last(seen, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_q": F.first(seen, True).over(w.rowsBetween(0, W.unboundedFollowing))}).filter("_side = 1")
    back, ahead = F.col(t) - F.col("_p.t"), F.col("_q.t") - F.col(t)
    pick = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.when(back <= tolerance, F.col("_p.v"))).otherwise(F.when(ahead <= tolerance, F.col("_q.v")))
    return both.select(*keys, t, *[F.col(f"_rest.{c}").alias(c) for c in names], pick.alias(value))


def not_after_left(left: DataFrame, right: DataFrame, keys: list[str] = KEYS, t: str = "t_s") -> DataFrame:
    """``right`` without rows later than the last of ``left``."""
    last = left.groupBy(*keys).agg(F.max(t).alias("_end"))
    return right.join(last, keys).filter(F.col(t) <= F.col("_end")).drop("_end")


def cut_at_rate(fine: DataFrame, pieces: DataFrame, fs_pieces: float, fs_fine: float, keys: list[str] = KEYS) -> DataFrame:
    """Cuts a recording of another rate at segments counted in the first rate; counts from each segment's start."""
    mapped = pieces.withColumns({c: F.floor(F.col(c) * (fs_fine / fs_pieces)).cast("long") for c in ("start", "stop")})
    return sliced(fine, mapped, keys).withColumn("idx", F.col("idx") - F.col("start")).drop("start", "stop")


def cut_from(df: DataFrame, offsets: DataFrame, fs: float, keys: list[str] = KEYS) -> DataFrame:
    """Drops what comes before each series' offset in seconds."""
    return df.join(offsets, keys).withColumn("_at", F.round(F.col("offset_s") * fs).cast("long")).filter("idx >= _at").withColumn("idx", F.col("idx") - F.col("_at")).drop("_at", "offset_s")


def overlap(a: DataFrame, b: DataFrame, keys: list[str] = KEYS, t: str = "t") -> DataFrame:
    """b's times inside the span that both have: the common grid of two series."""
    low = a.groupBy(*keys).agg(F.min(t).alias("_low"), F.max(t).alias("_high"))
    return b.join(low, keys).filter(F.col(t).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def paired(df: DataFrame, subject: str, condition: str, first: str, second: str, value: str = "value") -> DataFrame:
    """One row per subject that has both conditions: first, second, diff = second - first."""
    both = df.groupBy(subject).agg(F.avg(F.when(F.col(condition) == first, F.col(value))).alias("first"), F.avg(F.when(F.col(condition) == second, F.col(value))).alias("second"))
    return both.dropna().withColumn("diff", F.col("second") - F.col("first"))
