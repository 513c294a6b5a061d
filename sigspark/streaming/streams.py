"""Streaming forms: trigger runs, sliding-window features, and dropping repeats, all with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_features(stream: DataFrame, late: str, width: str, step: str, keys: list[str], aggregates: list[Column], t: str = "ts") -> DataFrame:
    """Aggregates per sliding event-time window; rows later than the watermark are dropped, closed windows leave the state."""
    g = stream.withWatermark(t, late).groupBy(*keys, F.window(t, width, step)).agg(*aggregates)
    return g.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def without_repeats(stream: DataFrame, late: str, columns: list[str], t: str = "ts") -> DataFrame:
    """The first row of each combination of columns within the watermark."""
    return stream.withWatermark(t, late).dropDuplicatesWithinWatermark(columns)


def trigger_runs(stream: DataFrame, threshold: float, key: str, idx: str = "idx", x: str = "x") -> DataFrame:
    """key, first, last of every run above the threshold, when the row after it arrives. State per key: the open run.

    Rows of a key have to arrive in order of idx; a gap in idx ends a run.
    """

    def run(key_value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (-1, -1)
        done = []
        for i, v in sorted((int(i), float(v)) for f in frames for i, v in zip(f[idx], f[x])):
            high = v > threshold
            if first >= 0 and (not high or i != last + 1):
                done.append((key_value[0], first, last))
                first = -1
            if high:
                first, last = (i if first < 0 else first), i
        state.update((first, last))
        yield pd.DataFrame(done, columns=[key, "first", "last"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, F.col(idx).cast("long").alias(idx), F.col(x).cast("double").alias(x)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, first long, last long", "first long, last long", "append", GroupStateTimeout.NoTimeout)
