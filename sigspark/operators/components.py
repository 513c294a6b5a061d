"""Principal components and modes of many channels (electrodes, pixels): sums of products, a small eigenproblem, joins.

Samples of one instant are gathered as one vector; Arrow batches add up outer products of blocks of ``BLOCK`` channels, and
blocks of the same place are added again per key. What meets in one task is a matrix of channels by channels, whatever the
number of samples. Scores, back-projections and mode series are joins with the table of loadings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import corr
from .series import whole

BLOCK = 256
#: Keys whose sums one task holds before it hands them on.
_HELD = 64


def vectors(df: DataFrame, keys: list[str], at: str, channel: str, x: str) -> DataFrame:
    """keys, at, _c (channels in order), _v (their values), of instants at which no channel is missing or null."""
    rows = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(x).cast("double").alias("x")))).alias("_s"))
    rows = rows.withColumn("_most", F.max(F.size("_s")).over(whole(keys))) if not keys else _with_most(rows, keys)
    return rows.filter(F.size("_s") == F.col("_most")).select(*keys, at, F.col("_s.c").alias("_c"), F.col("_s.x").alias("_v"))


def _with_most(rows: DataFrame, keys: list[str]) -> DataFrame:
    from .models import on_keys

    return on_keys(rows, rows.groupBy(*keys).agg(F.max(F.size("_s")).alias("_most")), keys)


def _partial_products(keys: list[str], block: int):
    names = [*keys, "i", "j", "what", "n", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for key, (n, sums) in held.items():
                for (i, j, what), cells in sums.items():
                    rows.append((*key, i, j, what, n, cells.tobytes()))
            held.clear()
            if rows:
                columns = list(zip(*rows))
                kinds = [*(schema.field(k).type for k in keys), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            schema = batch.schema
            values, ahead = batch.column("_v"), batch.column("_n") if "_n" in schema.names else None
            key_rows = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for r, key in enumerate(key_rows):
                places.setdefault(key, []).append(r)
            for key, rows in places.items():
                x = np.array([values[r].as_py() for r in rows])
                n, sums = held.setdefault(key, [0, {}])
                held[key][0] = n + len(rows)
                pairs = [("now", x, x)]
                if ahead is not None:
                    some = [k for k, r in enumerate(rows) if ahead[r].is_valid and len(ahead[r].as_py()) == x.shape[1]]
                    if some:
                        y = np.array([ahead[rows[k]].as_py() for k in some])
                        pairs += [("before", x[some], x[some]), ("next", y, x[some])]
                for what, a, b in pairs:
                    for i in range(0, x.shape[1], block):
                        for j in range(0, x.shape[1], block):
                            if what == "next" or j >= i:
                                cells = a[:, i : i + block].T @ b[:, j : j + block]
                                at = (i // block, j // block, what)
                                sums[at] = sums[at] + cells if at in sums else cells
                if len(held) > _HELD:
                    yield from flush()
        yield from flush()

    return run


def product_sums(df: DataFrame, keys: list[str], at: str, channel: str, x: str = "x", ahead: bool = False, block: int = BLOCK) -> DataFrame:
    """keys, i, j, what, n, cells: sums over instants of products of channel blocks i and j (float64 bytes). ``what``: now (v v'),
    and with ``ahead`` also before and next (v v' and the next instant's v times v', over instants that have a next one)."""
    v = vectors(df, keys, at, channel, x)
    kinds = {k: t for k, t in dict(df.dtypes).items()}
    rows = v.select(*keys, at, "_v")
    if ahead:
        later = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(at) - 1).alias("_at"), F.col("_v").alias("_n"))
        met = F.col(at) == F.col("_at")
        for i, k in enumerate(keys):
            met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        rows = rows.join(later, met, "left")
    rows = rows.select(*keys, "_v", *(["_n"] if ahead else []))
    key_schema = [f"`{k}` {kinds[k]}" for k in keys]
    partial = rows.mapInArrow(_partial_products(keys, block), ", ".join([*key_schema, "i int, j int, what string, n long, cells binary"]))

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        cells = sum(np.frombuffer(c, float) for c in frame["cells"])
        return frame.head(1).assign(n=frame["n"].sum(), cells=[cells.tobytes()])

    return partial.groupBy(*keys, "i", "j", "what").applyInPandas(added, partial.schema)


def channels_of(df: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """keys, place, channel: the channels of every key in order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(channel)) - 1
    return df.select(*keys, channel).distinct().withColumn("place", place.cast("long"))


def assembled(blocks: pd.DataFrame, what: str) -> np.ndarray:
    """The whole matrix of one key from its blocks."""
    mine = blocks[blocks["what"] == what]
    if not len(mine):
        return np.zeros((0, 0))
    first = {i: int(math.isqrt(len(c) // 8)) for i, j, c in zip(mine["i"], mine["j"], mine["cells"]) if i == j}
    starts = {i: sum(first[k] for k in range(i)) for i in first}
    size = sum(first.values())
    out = np.zeros((size, size))
    for i, j, c in zip(mine["i"], mine["j"], mine["cells"]):
        part = np.frombuffer(c, float).reshape(first[i], first[j])
        out[starts[i] : starts[i] + first[i], starts[j] : starts[j] + first[j]] = part
        if what != "next" and i != j:
            out[starts[j] : starts[j] + first[j], starts[i] : starts[i] + first[i]] = part.T
    return out


def centred(df: DataFrame, keys: list[str], channel: str, x: str = "x", scale: bool = False) -> DataFrame:
    """x without its mean per key and channel (``_mean``), and with ``scale`` over its deviation (``_sd``); a constant channel
    stays at 0."""
    w = whole([*keys, channel])
    out = df.withColumns({"_mean": F.avg(x).over(w), "_sd": F.coalesce(F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)), F.lit(1.0)) if scale else F.lit(1.0)})
    return out.withColumn(x, (F.col(x) - F.col("_mean")) / F.col("_sd"))


def loadings(df: DataFrame, keys: list[str], at: str, channel: str, x: str = "x", k: int | None = None) -> DataFrame:
    """keys, mode (from 1), value (the eigenvalue, a sum of squares), energy (its share), channel, weight: the ``k`` strongest
    principal directions (all, if None) of columns that ``centred`` has prepared. Signs: the largest weight is positive."""
    kinds = dict(df.dtypes)
    sums = product_sums(df, keys, at, channel, x)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        values, directions = np.linalg.eigh(assembled(frame, "now"))
        values, directions = np.maximum(values[::-1], 0), directions[:, ::-1]
        n = min(k or len(values), len(values))
        size, total = len(values), max(values.sum(), 1e-300)
        largest = directions[np.abs(directions).argmax(0), np.arange(size)]
        directions = directions * np.where(largest < 0, -1.0, 1.0)
        mode = np.repeat(np.arange(n), size)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * (n * size) for c in keys}, "mode": mode + 1, "value": values[mode], "energy": values[mode] / total, "place": np.tile(np.arange(size), n), "weight": directions.T[:n].ravel()})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "mode long, value double, energy double, place long, weight double"])
    solved = sums.filter("what = 'now'").groupBy(*keys).applyInPandas(solve, schema)
    return solved.join(channels_of(df, keys, channel), [*keys, "place"]).select(*keys, "mode", "value", "energy", channel, "weight")


def scores(df: DataFrame, table: DataFrame, keys: list[str], at: str, channel: str, x: str = "x") -> DataFrame:
    """keys, at, mode, score: every instant projected on every direction of ``table``."""
    both = df.select(*keys, at, channel, x).join(table.select(*keys, channel, "mode", "weight"), [*keys, channel])
    return both.groupBy(*keys, at, "mode").agg(F.sum(F.col(x) * F.col("weight")).alias("score"))


def removed(df: DataFrame, reference: DataFrame, keys: list[str], channel: str, threshold: float = 0.3, at: str = "idx", x: str = "x", r: str = "r") -> tuple[DataFrame, DataFrame]:
    """(cleaned, components). Components of standardised channels whose scores correlate with the reference (keys, at, r) by
    more than ``threshold`` are taken out, and the rest is projected back to the channels' own units.

    cleaned: the columns of ``df`` with x replaced. components: keys, mode, energy, correlation, removed. Instants that lack a
    channel take no part in the components and keep their values less what their own channels carry. A constant channel or
    reference correlates with nothing; an empty table gives empty ones.
    """
    z = centred(df, keys, channel, x, scale=True)
    table = loadings(z, keys, at, channel, x)
    points = scores(z, table, keys, at, channel, x)
    met = points.join(reference.select(*keys, at, F.col(r).alias("_r")), [*keys, at]).groupBy(*keys, "mode").agg(corr("score", "_r").alias("correlation"))
    components = table.groupBy(*keys, "mode").agg(F.max("energy").alias("energy")).join(met, [*keys, "mode"], "left")
    components = components.withColumn("removed", F.coalesce(F.abs("correlation") > threshold, F.lit(False)))
    bad = table.join(components.filter("removed").select(*keys, "mode"), [*keys, "mode"])
    carried = points.join(bad.select(*keys, "mode", channel, "weight"), [*keys, "mode"]).groupBy(*keys, at, channel).agg(F.sum(F.col("score") * F.col("weight")).alias("_carried"))
    cleaned = z.join(carried, [*keys, at, channel], "left").withColumn(x, (F.col(x) - F.coalesce("_carried", F.lit(0.0))) * F.col("_sd") + F.col("_mean"))
    return cleaned.select(*[F.col(f"`{c}`") for c in df.columns]), components


_DYNAMIC = "mode long, frequency double, growth double, energy double, size double, phase double, log_rate double, turn double"


def _modes_of(before: np.ndarray, later: np.ndarray, first: np.ndarray, instants: int, fs: float, k: int) -> list[dict]:
    """The rows of one key's dynamic modes, from its sums of products and its first instant."""
    if not len(before) or instants <= 2:
        return []
    power, u = np.linalg.eigh(before)
    keep = [i for i in np.argsort(-power)[: 2 * k] if power[i] > 1e-10 * max(power.max(), 1e-300) and power[i] > 1e-20]
    if not keep:
        return []
    u, power = u[:, keep], power[keep]
    rate, directions = np.linalg.eig(u.T @ later @ u / power)
    modes = u @ directions
    start = np.linalg.lstsq(modes, np.asarray(first, complex), rcond=None)[0]
    turns = np.log(rate + 1e-30)
    mean = np.array([np.mean(np.exp(np.minimum(t.real * np.arange(instants), 700))) for t in turns])
    sizes = np.linalg.norm(modes, axis=0) * np.abs(start) * mean
    best: dict[float, int] = {}
    for i in range(len(rate)):
        name = round(abs(turns[i].imag) * fs / (2 * math.pi), 4)
        if name not in best or sizes[i] > sizes[best[name]] * (1 + 1e-9):
            best[name] = i
    order = sorted(best.values(), key=lambda i: -sizes[i])[:k]
    return [{"mode": m, "frequency": abs(turns[i].imag) * fs / (2 * math.pi), "growth": turns[i].real * fs, "energy": sizes[i] / (sizes[order[0]] + 1e-12), "size": abs(start[i]), "phase": float(np.angle(start[i])), "log_rate": turns[i].real, "turn": turns[i].imag} for m, i in enumerate(order, 1)]


def dynamic_modes(df: DataFrame, keys: list[str], at: str, channel: str, fs: float, k: int = 4, x: str = "x", bounded: bool = False) -> DataFrame:
    """keys, mode, frequency (Hz), growth (per second), energy (over the strongest), and size, phase, log_rate and turn of its
    series ``size * exp(log_rate t) * cos(phase + turn t)``: dynamic mode decomposition of rank 2 k of ``centred`` columns.

    Modes of equal frequency (four decimals), so both of a complex pair, count once: the stronger stays. Keys with fewer than
    three instants, or without variance, give no rows. ``bounded``: a key is a short window, so its samples are gathered in one
    row; a matrix of channels by channels for each of its instants, as long keys hand on, would be many times their size.
    """
    kinds = dict(df.dtypes)
    columns = [*keys, *(p.split()[0] for p in _DYNAMIC.split(", "))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), _DYNAMIC])
    if bounded:
        return _windows_gathered(df, keys, at, channel, x).mapInPandas(_modes_of_windows(keys, columns, fs, k), schema)
    sums = product_sums(df, keys, at, channel, x, ahead=True)
    first = vectors(df, keys, at, channel, x).groupBy(*keys).agg(F.min_by("_v", at).alias("_first"))
    both = sums.join(first, keys) if keys else sums.crossJoin(first)  # one row

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        instants = int(frame.loc[frame["what"] == "now", "n"].max())
        rows = _modes_of(assembled(frame, "before"), assembled(frame, "next"), frame["_first"].iloc[0], instants, fs, k)
        return pd.DataFrame([{**{c: frame[c].iloc[0] for c in keys}, **row} for row in rows], columns=columns)

    return both.groupBy(*keys).applyInPandas(solve, schema)


def _windows_gathered(df: DataFrame, keys: list[str], at: str, channel: str, x: str) -> DataFrame:
    """keys and three arrays of the same order: instants, channels, values; without missing values."""
    rows = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).select(*keys, F.col(at).cast("long").alias("_at"), F.col(channel).alias("_c"), F.col(x).cast("double").alias("_x"))
    return rows.groupBy(*keys).agg(F.collect_list("_at").alias("_at"), F.collect_list("_c").alias("_c"), F.collect_list("_x").alias("_x"))


def _modes_of_windows(keys: list[str], columns: list[str], fs: float, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r, (at, channel, x) in enumerate(zip(frame["_at"], frame["_c"], frame["_x"])):
                order = np.lexsort((channel, at))
                instant, begin, size = np.unique(np.asarray(at)[order], return_index=True, return_counts=True)
                whole_ = size == size.max()  # no channel is missing
                v = np.asarray(x)[order][begin[whole_][:, None] + np.arange(size.max())]
                instant = instant[whole_]
                now = np.flatnonzero(np.diff(instant) == 1)
                a, b = v[now], v[now + 1]
                own = {c: frame[c].iloc[r] for c in keys}
                rows += [{**own, **mode} for mode in _modes_of(a.T @ a if len(now) else np.zeros((0, 0)), b.T @ a, v[0], len(v), fs, k)]
            yield pd.DataFrame(rows, columns=columns)

    return run


def mode_series(modes: DataFrame, instants: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, mode, at, x: the series of every dynamic mode at the instants (counted from 0) of its key."""
    t = F.col(at).cast("double")
    value = F.col("size") * F.exp(F.col("log_rate") * t) * F.cos(F.col("phase") + F.col("turn") * t)
    return instants.select(*keys, at).distinct().join(modes, keys).select(*keys, "mode", at, value.alias("x"))


def strongest(modes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_modes, and frequency and energy of the two strongest modes side by side: windowed decomposition as columns."""
    def of(n: int, c: str) -> Column:
        return F.max(F.when(F.col("mode") == n, F.col(c)))

    return modes.groupBy(*keys).agg(F.count("*").alias("n_modes"), of(1, "frequency").alias("top_frequency"), of(1, "energy").alias("top_energy"), of(2, "frequency").alias("second_frequency"), of(2, "energy").alias("second_energy"))
