"""Operators on frame tables (clip, frame, y, px, v): every pixel is a row, every descriptor an aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import ratio
from . import features as ft, spectral as sp
from .models import on_keys
from .series import detrended, interpolated_columns, passes_quality, whole
from .spectral import dft

FRAME = ["clip", "frame"]
PIXEL = ["clip", "y", "px"]
#: Four neighbour directions of the co-occurrence matrix: 0, 45, 90 and 135 degrees.
OFFSETS = ((0, 1), (-1, 1), (-1, 0), (-1, -1))


def thinned(frames: DataFrame, stride: int, block: int) -> DataFrame:
    """Every ``stride``-th frame, block means of ``block`` x ``block`` pixels."""
    small = frames.filter(F.col("frame") % stride == 0)
    return small.groupBy(*FRAME, F.floor(F.col("y") / block).cast("long").alias("y"), F.floor(F.col("px") / block).cast("long").alias("px")).agg(F.avg("v").alias("v"))


def histogram_entropy(df: DataFrame, keys: list[str], value: Column, bins: int, low: float, high: float) -> DataFrame:
    """Bits of the distribution over equal bins."""
    b = F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    n = df.groupBy(*keys, b.alias("_b")).agg(F.count("*").alias("_n"))
    q = n.withColumn("_q", F.col("_n") / F.sum("_n").over(whole(keys)))
    return q.groupBy(*keys).agg((-F.sum(F.col("_q") * F.log2("_q")) + 0.0).alias("entropy"))


def global_signals(frames: DataFrame, bins: int = 16, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """luminance, contrast, entropy and frame difference of every frame."""
    before = F.lag("v").over(W.partitionBy("clip", "y", "px").orderBy("frame"))
    g = frames.withColumn("_d", F.abs(F.col("v") - before)).groupBy(*FRAME).agg(F.avg("v").alias("luminance"), F.stddev_pop("v").alias("contrast"), F.avg("_d").alias("frame_diff"))
    return g.join(histogram_entropy(frames, FRAME, F.col("v"), bins, low, high), FRAME)


def colour_means(frames: DataFrame, channels: list[str]) -> DataFrame:
    """clip, frame and the mean of every colour channel, and of what lies farthest from grey: the mean over pixels of the largest
    less the smallest channel."""
    spread = F.greatest(*map(F.col, channels)) - F.least(*map(F.col, channels))
    return frames.groupBy(*FRAME).agg(*[F.avg(c).alias(c) for c in channels], F.avg(spread).alias("colourfulness"))


def _neighbours(frames: DataFrame) -> DataFrame:
    """Adds the pixel to the left, right, above and below; edges repeat."""
    across, down = W.partitionBy(*FRAME, "y").orderBy("px"), W.partitionBy(*FRAME, "px").orderBy("y")
    v = F.col("v")
    return frames.withColumns({"_l": F.coalesce(F.lag("v").over(across), v), "_r": F.coalesce(F.lead("v").over(across), v), "_u": F.coalesce(F.lag("v").over(down), v), "_w": F.coalesce(F.lead("v").over(down), v)})


def gradient(frames: DataFrame) -> DataFrame:
    """gx, gy and their size ``g`` by the Sobel stencil: a difference along one axis, smoothed 1 2 1 along the other."""
    n = _neighbours(frames).withColumns({"_dx": F.col("_r") - F.col("_l"), "_dy": F.col("_w") - F.col("_u")})
    across, down = W.partitionBy(*FRAME, "y").orderBy("px"), W.partitionBy(*FRAME, "px").orderBy("y")

    def smooth(c: str, w) -> Column:
        return F.coalesce(F.lag(c).over(w), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))

    g = n.withColumns({"gx": smooth("_dx", down), "gy": smooth("_dy", across)})
    return g.select(*FRAME, "y", "px", "v", "gx", "gy", F.hypot("gx", "gy").alias("g"))


def edge_density(frames: DataFrame, quantile: float = 0.6) -> DataFrame:
    """The gradient at the quantile, the share of pixels above it, and the share above twice the mean gradient."""
    g = gradient(frames)
    cut = g.groupBy(*FRAME).agg(F.percentile("g", quantile).alias("cut"), F.avg("g").alias("_m"))
    return g.join(cut, FRAME).groupBy(*FRAME).agg(F.max("cut").alias("cut"), F.avg((F.col("g") > F.col("cut")).cast("double")).alias("mask"), F.avg((F.col("g") > 2 * F.col("_m")).cast("double")).alias("edges"))


def spectrum_2d(frames: DataFrame, n: int) -> DataFrame:
    """clip, frame, ky, kx, p: the two-dimensional power spectrum by two passes of sums, kx and ky centred on 0."""
    rows = dft(frames, n, range(n), [*FRAME, "y"], "px", ("v",)).withColumnRenamed("k", "kx")
    a = F.col("ky") * F.col("y") * (2 * math.pi / n)
    c = rows.withColumn("ky", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    s = c.groupBy(*FRAME, "kx", "ky").agg(F.sum(F.col("re_v") * F.cos(a) + F.col("im_v") * F.sin(a)).alias("_re"), F.sum(F.col("im_v") * F.cos(a) - F.col("re_v") * F.sin(a)).alias("_im"))

    def centred(k: str) -> Column:
        return F.when(F.col(k) >= n // 2, F.col(k) - n).otherwise(F.col(k))

    return s.select(*FRAME, centred("ky").alias("ky"), centred("kx").alias("kx"), (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("p"))


def radial_slope(spectrum: DataFrame) -> DataFrame:
    """Slope of log power over log radius, radii as whole numbers above 0."""
    r = spectrum.withColumn("_r", F.floor(F.hypot(F.col("kx").cast("double"), F.col("ky").cast("double"))).cast("long")).filter("_r > 0")
    m = r.groupBy(*FRAME, "_r").agg(F.avg("p").alias("_p")).filter("_p > 0")
    return m.groupBy(*FRAME).agg(F.regr_slope(F.ln("_p"), F.ln("_r")).alias("slope"))


def spectral_shape(spectrum: DataFrame) -> DataFrame:
    """Peak wave number, anisotropy (0 even, 1 one direction) and orientation of the power."""
    s = spectrum.filter("kx <> 0 OR ky <> 0").withColumn("_a", 2 * F.atan2(F.col("ky").cast("double"), F.col("kx").cast("double")))
    k = F.hypot(F.col("kx").cast("double"), F.col("ky").cast("double"))
    g = s.groupBy(*FRAME).agg(F.sum("p").alias("_p"), F.sum(F.col("p") * F.cos("_a")).alias("_c"), F.sum(F.col("p") * F.sin("_a")).alias("_s"), F.max_by(k, F.struct(F.round("p", 9), -k)).alias("peak_k"))
    return g.select(*FRAME, "peak_k", ratio(F.hypot("_c", "_s"), "_p").alias("anisotropy"), (F.atan2("_s", "_c") / 2).alias("orientation"))


def box_counting(frames: DataFrame, sizes: list[int], inside: Column) -> DataFrame:
    """Box-counting dimension of the pixels for which ``inside`` holds."""
    boxes = frames.filter(inside).withColumn("s", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    n = boxes.select(*FRAME, "s", F.floor(F.col("y") / F.col("s")).alias("_y"), F.floor(F.col("px") / F.col("s")).alias("_x")).distinct().groupBy(*FRAME, "s").agg(F.count("*").alias("_n"))
    return n.groupBy(*FRAME).agg((-F.regr_slope(F.ln("_n"), F.ln("s"))).alias("dimension"))


def dark_dimension(frames: DataFrame, below: float = 128.0) -> DataFrame:
    """clip, frame, dimension: box counting of the pixels darker than ``below`` with all boxes from 1 to half the shorter side.
    Every picture has a row; without a dark pixel, or with one size of box, dimension is null. Null pixels are not dark."""
    side = frames.groupBy(*FRAME).agg((F.least(F.max("y"), F.max("px")) + 1).alias("_p"))
    sizes = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("_p") / 2))))
    dark = frames.filter(F.col("v") < below).join(side, FRAME).select(*FRAME, "y", "px", sizes.alias("_s"))
    boxes = dark.select(*FRAME, "_s", F.floor(F.col("y") / F.col("_s")).alias("_y"), F.floor(F.col("px") / F.col("_s")).alias("_x")).distinct()
    n = boxes.groupBy(*FRAME, "_s").agg(F.count("*").alias("_n"))
    found = n.groupBy(*FRAME).agg((-F.regr_slope(F.ln("_n"), F.ln("_s"))).alias("dimension"))
    return side.select(*FRAME).join(found, FRAME, "left")


def lacunarity(frames: DataFrame, sizes: list[int]) -> DataFrame:
    """Mean log over sizes of 1 + variance / mean squared of box sums."""
    b = frames.withColumn("s", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    sums = b.groupBy(*FRAME, "s", F.floor(F.col("y") / F.col("s")).alias("_y"), F.floor(F.col("px") / F.col("s")).alias("_x")).agg(F.sum("v").alias("_m"))
    per = sums.groupBy(*FRAME, "s").agg((1 + ratio(F.var_pop("_m"), F.avg("_m") * F.avg("_m"))).alias("_l"))
    return per.groupBy(*FRAME).agg(F.avg(F.ln("_l")).alias("lacunarity"))


def patch_entropy(frames: DataFrame, size: int, bins: int, low: float, high: float) -> DataFrame:
    """Entropy of each patch: clip, frame, gy, gx, entropy."""
    p = frames.withColumns({"gy": F.floor(F.col("y") / size).cast("long"), "gx": F.floor(F.col("px") / size).cast("long")})
    return histogram_entropy(p, [*FRAME, "gy", "gx"], F.col("v"), bins, low, high)


def field_summary(field: DataFrame, value: str) -> DataFrame:
    """Mean, deviation, 95th percentile and spread of a map over its patches."""
    return field.groupBy(*FRAME).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, 0.95).alias("p95"), (F.max(value) - F.min(value)).alias("spread"))


def glcm(frames: DataFrame, levels: int, low: float, high: float) -> DataFrame:
    """Contrast and homogeneity of grey levels of neighbouring pixels, over four directions."""
    q = F.least(F.greatest(F.floor((F.col("v") - low) / ((high - low) / levels)), F.lit(0)), F.lit(levels - 1)).cast("long")
    pixels = frames.select(*FRAME, "y", "px", q.alias("_q"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("dy"), F.lit(b).cast("long").alias("dx")) for a, b in OFFSETS])).alias("_o")
    left = pixels.select(*FRAME, "y", "px", F.col("_q").alias("_i"), steps).select(*FRAME, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("px") + F.col("_o.dx")).alias("px"), "_i")
    d = (F.col("_i") - F.col("_q")).cast("double")
    return left.join(pixels, [*FRAME, "y", "px"]).groupBy(*FRAME).agg(F.avg(d * d).alias("contrast"), F.avg(1.0 / (1.0 + d * d)).alias("homogeneity"))


def pixel_series(frames: DataFrame) -> DataFrame:
    """Frames renumbered from 0 inside each clip: clip, y, px as a series over idx. Frames are numbered, not their pixels."""
    place = F.row_number().over(W.partitionBy("clip").orderBy("frame")) - 1
    numbers = frames.select(*FRAME).distinct().select(*FRAME, place.cast("long").alias("idx"))
    return on_keys(frames, numbers, FRAME).select("clip", "y", "px", "idx", F.col("v").alias("x"))


def column_signal(frames: DataFrame, column: int) -> DataFrame:
    """The mean of one pixel column over time: clip, idx, x."""
    s = pixel_series(frames.filter(F.col("px") == column))
    return s.groupBy("clip", "idx").agg(F.avg("x").alias("x"))


def synchrony(peaks: DataFrame, keys: list[str], f: str) -> DataFrame:
    """Spread of the pixels' peak frequencies, and an index that is 1 when all agree."""
    g = peaks.groupBy(*keys).agg(F.avg(f).alias("mean_f"), F.stddev_pop(f).alias("sd_f"))
    return g.withColumn("sync", 1.0 / (1.0 + ratio("sd_f", "mean_f")))


#: Numbers that a block of frames holds, frames that one task searches for motion at a time, and rows of one result batch.
_BLOCK_CELLS, _MOTION_FRAMES, _OUT = 1 << 18, 64, 1 << 17


def _gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and five arrays of the same order: idx, y, px, the value (0 where it is null), and whether it is null."""
    kept = rows.select(*by, *[F.col(c).cast("long").alias(f"_{c}") for c in ("idx", "y", "px")], F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("_x"), F.col("x").isNull().alias("_none"))
    return kept.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in ("_idx", "_y", "_px", "_x", "_none")])


def _arrays(batch: pa.RecordBatch, row: int, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def _dense(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """Of each block its frames and, frame by pixel, the values, whether there is a pixel, and whether it has a value."""
    y, px = (np.concatenate([a[n], b[n]]) for n in (1, 2))
    code = (y - y.min()) * (px.max() - px.min() + 1) + px - px.min()
    wide = int(code.max()) + 1
    if wide > 4 * len(code):  # few pixels far apart
        kinds, code = np.unique(code, return_inverse=True)
        wide = len(kinds)
    out = []
    for v, at in ((a, code[: len(a[0])]), (b, code[len(a[0]) :])):
        kinds, row = np.unique(v[0], return_inverse=True)
        values, has, some = (np.zeros((len(kinds), wide)) for _ in range(3))
        values[row, at], has[row, at], some[row, at] = v[3], 1.0, ~v[4].astype(bool)
        out.append((kinds, values, has, some))
    return out


def _gram_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("_idx", "_y", "_px", "_x", "_none")
    for batch in batches:
        for r in range(batch.num_rows):
            (i, x, x_has, x_some), (j, y, y_has, y_some) = _dense(_arrays(batch, r, names), _arrays(batch, r, tuple(f"{n}2" for n in names)))
            step, same = max(1, _OUT // len(j)), x_has.all() and y_has.all()
            for part in (slice(first, first + step) for first in range(0, len(i), step)):
                wanted = i[part, None] <= j
                a, b = np.nonzero(wanted if same else wanted & (x_has[part] @ y_has.T > 0))
                none = None if x_some.all() and y_some.all() else (x_some[part] @ y_some.T == 0)[a, b]
                clip = batch.column("clip").take(pa.array(np.full(len(a), r)))
                yield pa.RecordBatch.from_arrays([clip, pa.array(i[part][a]), pa.array(j[b]), pa.array((x[part] @ y.T)[a, b], mask=none)], ["clip", "i", "j", "g"])


def snapshots_gram(frames: DataFrame) -> DataFrame:
    """clip, i, j, g: products of centred frames (i <= j); its small eigenproblem gives the modes. The result has a row for every
    two frames of a clip. Frames stand in blocks of ``_BLOCK_CELLS`` numbers, and a pair of blocks is a key of its own: what is
    shuffled is every block once per other block of its clip, and a task holds two blocks, whatever the number of frames."""
    means = frames.groupBy(*PIXEL).agg(F.avg("v").alias("_mean"))
    s = on_keys(pixel_series(frames), means, PIXEL).withColumn("x", F.col("x") - F.col("_mean"))
    per = frames.groupBy("clip").agg(F.count("*").alias("_all"), (F.count_distinct("frame") + F.max(F.col("frame").isNull().cast("long"))).alias("_frames"))
    size = F.greatest(F.lit(1), F.floor(_BLOCK_CELLS * F.col("_frames") / F.col("_all"))).cast("long")
    sizes = per.select("clip", size.alias("_size"), F.floor((F.col("_frames") - 1) / size).cast("long").alias("_last"))
    blocks = _gathered(on_keys(s, sizes, ["clip"]).withColumn("_block", F.floor(F.col("idx") / F.col("_size")).cast("long")), ["clip", "_block", "_last"])
    names = ["_idx", "_y", "_px", "_x", "_none"]
    left = blocks.select("clip", F.col("_block").alias("_i"), F.explode(F.sequence("_block", "_last")).alias("_j"), *names)
    right = blocks.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_i"), F.col("_block").alias("_j"), *[F.col(n).alias(f"{n}2") for n in names])
    pairs = on_keys(left, right, ["clip", "_i", "_j"]).select("clip", *names, *[f"{n}2" for n in names])
    return pairs.mapInArrow(_gram_of_blocks, f"clip {dict(frames.dtypes)['clip']}, i long, j long, g double")


def _best_shifts(idx: np.ndarray, y: np.ndarray, px: np.ndarray, x: np.ndarray, none: np.ndarray, own: range, block: int, reach: int, strides: tuple[int, ...]) -> Iterator[tuple]:
    """stride and arrays idx, by, bx, dy, dx of the frames ``own`` among those given: pictures as one dense array."""
    times, t = np.unique(idx, return_inverse=True)
    top, left = y.min() // block, px.min() // block
    high, wide = (int(v.max() // block - a + 1) * block for v, a in ((y, top), (px, left)))
    value, has, some = np.zeros((len(times), high, wide)), np.zeros((len(times), high, wide), bool), np.zeros((len(times), high, wide), bool)
    at = t, y - top * block, px - left * block
    value[at], has[at], some[at] = x, True, ~none.astype(bool)

    def blocks(v: np.ndarray) -> np.ndarray:
        return v.reshape(len(v), high // block, block, wide // block, block).sum((2, 4))

    shifts = sorted(((a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)), key=lambda d: (abs(d[0]) + abs(d[1]), *d))
    for stride in strides:
        now = np.flatnonzero((times >= own.start) & (times < own.stop) & np.isin(times - stride, times))
        then = np.searchsorted(times, times[now] - stride)
        shape = len(now), high // block, wide // block
        best, which, any_ = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)
        for n, (dy, dx) in enumerate(shifts):
            to, of = ((slice(max(0, d), size + min(0, d)) for d, size in ((s * dy, high), (s * dx, wide))) for s in (1, -1))
            (ty, tx), (fy, fx) = to, of
            if ty.start >= ty.stop or tx.start >= tx.stop:
                continue
            pairs, known, apart = np.zeros((len(now), high, wide), bool), np.zeros((len(now), high, wide), bool), np.zeros((len(now), high, wide))
            pairs[:, ty, tx] = has[now][:, ty, tx] & has[then][:, fy, fx]
            known[:, ty, tx] = some[now][:, ty, tx] & some[then][:, fy, fx]
            apart[:, ty, tx] = np.abs(value[now][:, ty, tx] - value[then][:, fy, fx])
            n_known = blocks(known)
            sad = np.round(blocks(np.where(known, apart, 0.0)) / np.maximum(n_known, 1), 9)
            # In order: nothing known, numbers, NaN. Of equal ones the first stays, and shifts come in their order.
            rank = np.where(n_known == 0, -1.0, np.where(np.isnan(sad), np.finfo(float).max, sad))
            better = (blocks(pairs) == block * block) & (~any_ | (rank < best))
            best[better], which[better] = rank[better], n
            any_ |= better
        f, by, bx = np.nonzero(any_)
        moved = np.array(shifts)[which[f, by, bx]].reshape(-1, 2)
        yield stride, times[now][f], by + top, bx + left, moved[:, 0], moved[:, 1]


def _motion(frames: DataFrame, block: int, reach: int, strides: tuple[int, ...], stretch: int = _MOTION_FRAMES) -> DataFrame:
    """clip, stride, idx, by, bx, dy, dx. A stretch of a clip's frames and the frames that its strides reach back to, are gathered
    in one row, and all strides and displacements are tried on it: pixels are shuffled once, not once for each of these."""
    kind, back = dict(frames.dtypes)["clip"], max(strides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                idx, y, px, x, none = _arrays(batch, r, ("_idx", "_y", "_px", "_x", "_none"))
                first = batch.column("_chunk")[r].as_py() * stretch
                for stride, *found in _best_shifts(idx, y, px, x, none, range(first, first + stretch), block, reach, strides):
                    n = len(found[0])
                    clip = batch.column("clip").take(pa.array(np.full(n, r)))
                    yield pa.RecordBatch.from_arrays([clip, pa.array(np.full(n, stride, np.int64)), *(pa.array(c.astype(np.int64)) for c in found)], ["clip", "stride", "idx", "by", "bx", "dy", "dx"])

    s = pixel_series(frames)
    chunks = F.sequence(F.floor(F.col("idx") / stretch).cast("long"), F.floor((F.col("idx") + back) / stretch).cast("long"))
    placed = s.withColumn("_chunk", F.explode(chunks))
    return _gathered(placed, ["clip", "_chunk"]).mapInArrow(run, f"clip {kind}, stride long, idx long, by long, bx long, dy long, dx long")


def block_motion(frames: DataFrame, block: int, reach: int, stride: int = 1) -> DataFrame:
    """clip, idx, by, bx, dy, dx: the displacement of least absolute difference from the frame ``stride`` before.

    Equal sums go to the smaller displacement. Only blocks with all their pixels, all of which point to a pixel, are compared.
    """
    return _motion(frames, block, reach, (stride,)).drop("stride")


def motion_summary(motion: DataFrame, keys: tuple[str, ...] = ("clip", "idx"), directions: int = 8, more: tuple[Column, ...] = ()) -> DataFrame:
    """Size (mean, 95th percentile), mean direction, divergence and curl of the displacement field of every frame, and the
    entropy of the directions of the blocks that move, 0 to 1; then the aggregates ``more``. A frame's blocks are dealt out once."""

    def ahead(c: str, line: str, place: str) -> Column:
        w = W.partitionBy(*keys).orderBy(line, place)
        return F.when(F.lead(line).over(w) == F.col(line), F.lead(c).over(w)) - F.col(c)

    turn = F.pmod(F.floor(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")) / (2 * math.pi / directions) + 0.5), F.lit(directions))
    m = motion.withColumns({"_m": F.hypot(F.col("dx").cast("double"), F.col("dy").cast("double")), "_d": F.when((F.col("dx") != 0) | (F.col("dy") != 0), turn), "_ux": ahead("dx", "by", "bx"), "_vx": ahead("dy", "by", "bx"), "_uy": ahead("dx", "bx", "by"), "_vy": ahead("dy", "bx", "by")})
    shares = [ratio(F.count_if(F.col("_d") == d), F.count("_d")) for d in range(directions)]
    entropy = -reduce(lambda a, b: a + b, [F.when(q > 0, q * F.log2(q)).otherwise(0.0) for q in shares]) / math.log2(directions) + 0.0
    return m.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.percentile("_m", 0.95).alias("p95"), F.avg("dx").alias("u"), F.avg("dy").alias("v"), F.avg(F.coalesce("_ux", F.lit(0)) + F.coalesce("_vy", F.lit(0))).alias("divergence"), F.avg(F.coalesce("_vx", F.lit(0)) - F.coalesce("_uy", F.lit(0))).alias("curl"), entropy.alias("direction_entropy"), *more)


def motion_at_strides(frames: DataFrame, block: int, reach: int, strides: tuple[int, ...] = (1, 3, 9)) -> DataFrame:
    """The summary at several strides, and the shares of blocks that move at all and that move by at least ``reach``."""
    size = F.greatest(F.abs("dx"), F.abs("dy"))
    shares = F.avg(((size > 0) & (size < reach)).cast("int")).alias("small"), F.avg((size >= reach).cast("int")).alias("large")
    return motion_summary(_motion(frames, block, reach, strides), ("clip", "stride", "idx"), more=shares)


def pixel_complexity(frames: DataFrame, scales: list[int], least: int = 32, eps: float = 1e-9) -> DataFrame:
    """clip, y, px and six measures of every pixel's series: three fractal dimensions, permutation and sample entropy, DFA."""
    s = passes_quality(pixel_series(frames), PIXEL, least, eps)
    parts = [
        ft.katz(s, PIXEL).withColumnRenamed("fd", "katz"), ft.petrosian(s, PIXEL).withColumnRenamed("fd", "petrosian"), ft.higuchi(s, keys=PIXEL).withColumnRenamed("fd", "higuchi"), ft.dfa(s, scales, PIXEL).withColumnRenamed("alpha", "dfa"),
        ft.permutation_entropy(s, keys=PIXEL).withColumnRenamed("entropy", "perm_entropy"), ft.sample_entropy(s, keys=PIXEL).select(*PIXEL, F.col("sampen").alias("sample_entropy")),
    ]
    return reduce(lambda a, b: a.join(b, PIXEL, "full_outer"), parts)


def pixel_spectra(frames: DataFrame, n: int, step: int, fs: float, low: float, high: float) -> DataFrame:
    """clip, y, px: peak frequency, spectral entropy and the band's share of every pixel's mean spectrum over all its
    windows of ``n`` frames; without the constant part."""
    psd = sp.welch(pixel_series(frames), n, step, fs, PIXEL).filter("k > 0")
    q = psd.withColumn("_q", ratio("p", F.sum("p").over(W.partitionBy(*PIXEL))))
    entropy = -F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.log2("_q")).otherwise(0.0)) / math.log2(n // 2)
    return q.groupBy(*PIXEL).agg(F.max_by("f", F.struct(F.round("p", 9), -F.col("k"))).alias("peak_f"), entropy.alias("entropy"), F.sum(F.when(F.col("f").between(low, high), F.col("_q")).otherwise(0.0)).alias("band"))


def pixel_power(series: DataFrame, n: int, fs: float, keys: list[str], pos: str = "idx", linear: bool = True) -> DataFrame:
    """keys, k, f, p, ux, uy: power at every frequency but 0 of each pixel's ``n`` samples, detrended and under a Hann window
    that ends in zeros, and the unit vector of its phase (zero where there is no power)."""
    flat = detrended(series, keys, "x", pos, "x", linear)
    hann = 0.5 - 0.5 * F.cos(F.col(pos) * (2 * math.pi / (n - 1)))
    d = dft(flat.withColumn("x", F.col("x") * hann), n, range(1, n // 2 + 1), keys, pos)
    size = F.hypot("re_x", "im_x")
    unit = {u: F.coalesce(ratio(c, size), F.lit(0.0)) for u, c in (("ux", "re_x"), ("uy", "im_x"))}
    return d.select(*keys, "k", (F.col("k") * (fs / n)).alias("f"), (size * size).alias("p"), *[c.alias(u) for u, c in unit.items()])


def spectral_indices(power: DataFrame, n: int, fs: float, by: list[str], pixel: list[str], bands: list[tuple[str, float, float]] = ()) -> DataFrame:
    """by, sync (1 less the entropy of the mean spectrum, 0 to 1), coherence (1 less the spread of the pixels' peak frequencies
    over the range), peak_median, entropy (mean over pixels), phase_coherence and a power per band (log10 of 1 and the sum).

    phase_coherence is the mean over all pairs of pixels of the cosine of their phase difference, weighted by the mean spectrum: the
    squared length of the summed unit vectors gives all pairs at once, so the work is linear in pixels. One pixel has none.
    """
    mean = power.groupBy(*by, "k").agg(F.avg("p").alias("_m"), F.count("*").cast("double").alias("_n"), F.sum("ux").alias("_x"), F.sum("uy").alias("_y"), F.sum(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")).alias("_own"))
    pairs = ratio(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") - F.col("_own"), F.col("_n") * (F.col("_n") - 1))
    share = mean.withColumns({"_q": ratio("_m", F.sum("_m").over(whole(by))), "_pairs": pairs})
    whole_spectrum = share.groupBy(*by).agg((1 + F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.log2("_q")).otherwise(0.0)) / math.log2(max(n // 2, 2))).alias("sync"), F.sum(F.col("_q") * F.col("_pairs")).alias("phase_coherence"))
    q = power.withColumn("_q", ratio("p", F.sum("p").over(whole([*by, *pixel]))))
    each = q.groupBy(*by, *pixel).agg(F.max_by("f", F.struct(F.round("p", 9), -F.col("k"))).alias("_f"), (-F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.log2("_q")).otherwise(0.0)) / math.log2(max(n // 2, 2))).alias("_h"))
    span = max(fs / n * (n // 2) - fs / n, 1e-9) if n // 2 > 1 else 1.0
    spread = F.when(F.count("_f") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop("_f") / span)))
    over = each.groupBy(*by).agg(spread.alias("coherence"), F.percentile("_f", 0.5).alias("peak_median"), F.avg("_h").alias("entropy"))
    out = whole_spectrum.join(over, by)
    if bands:
        sums = [F.log10(1 + F.sum(F.when((F.col("f") >= low) & (F.col("f") < high), F.col("p")).otherwise(0.0))).alias(name) for name, low, high in bands]
        out = out.join(power.groupBy(*by).agg(*sums), by)
    return out


def pixel_vectors(frames: DataFrame) -> DataFrame:
    """clip, idx, channel, x: pixels as channels numbered row by row, for ``components``."""
    s = pixel_series(frames)
    return s.select("clip", "idx", (F.col("y") * 65536 + F.col("px")).alias("channel"), "x")


def frame_curve(values: DataFrame, frames: DataFrame, columns: list[str], centre: Column) -> DataFrame:
    """clip, idx and ``columns`` on every frame of a clip, between the centres of the windows of ``values``; held at the ends."""
    grid = frames.select("clip", "idx").distinct().select("clip", F.col("idx").cast("double").alias("t"))
    at = values.select("clip", centre.cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in columns])
    return interpolated_columns(at, grid, ["clip"], columns).select("clip", F.col("t").cast("long").alias("idx"), *columns)


def column_waves(frames: DataFrame, column: int, n: int, step: int, fs: float) -> DataFrame:
    """clip, w, centre, frequency, power: the dominant frequency of one pixel column's mean in sliding windows."""
    from .series import exploded_windows

    w = exploded_windows(column_signal(frames, column), n, step, ["clip"]).select("clip", "w", F.col("pos").alias("idx"), "x")
    top = sp.peak_frequency(sp.welch(w, n, n, fs, ["clip", "w"]).filter("k > 0"), 0.0, fs, ["clip", "w"])
    return top.select("clip", "w", (F.col("w") * step + n / 2).alias("centre"), F.col("peak_f").alias("frequency"), F.col("peak_p").alias("power"))


#: Measures of a patch of a frame.
PATCH_MEASURES = ("mean", "sd", "entropy", "gradient", "edges", "dimension", "lacunarity")


def patch_measures(frames: DataFrame, size: int, bins: int, low: float, high: float) -> DataFrame:
    """clip, frame, gy, gx and seven measures of every patch of ``size`` x ``size`` pixels: mean, deviation, entropy of grey
    values, mean gradient, share of steep pixels (above twice the frame's mean gradient), box-counting dimension of the pixels
    above the middle of the range, and lacunarity. A patch with no pixel above has no dimension, one whose sums are all 0 no lacunarity."""
    patch = {"gy": F.floor(F.col("y") / size).cast("long"), "gx": F.floor(F.col("px") / size).cast("long")}
    by = [*FRAME, "gy", "gx"]
    f = frames.withColumns(patch)
    g = gradient(frames).withColumn("_m", F.avg("g").over(W.partitionBy(*FRAME))).withColumns(patch)
    steep = g.groupBy(*by).agg(F.avg("g").alias("gradient"), F.avg((F.col("g") > 2 * F.col("_m")).cast("double")).alias("edges"))
    boxes = [s for s in (1, 2, 4, 8) if s <= size]
    sized = f.withColumn("s", F.explode(F.array(*[F.lit(s).cast("long") for s in boxes]))).withColumns({"_y": F.floor(F.col("y") / F.col("s")), "_x": F.floor(F.col("px") / F.col("s"))})
    full = sized.filter(F.col("v") > (low + high) / 2).select(*by, "s", "_y", "_x").distinct().groupBy(*by, "s").agg(F.count("*").alias("_n"))
    dimension = full.groupBy(*by).agg((-F.regr_slope(F.ln("_n"), F.ln("s"))).alias("dimension"))
    sums = sized.filter("s > 1").groupBy(*by, "s", "_y", "_x").agg(F.sum(F.col("v") - low).alias("_v")).groupBy(*by, "s").agg((1 + ratio(F.var_pop("_v"), F.avg("_v") * F.avg("_v"))).alias("_l"))
    gaps = sums.groupBy(*by).agg(F.avg(F.ln("_l")).alias("lacunarity"))
    base = f.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    parts = [base, histogram_entropy(f, by, F.col("v"), bins, low, high), steep, dimension, gaps]
    return reduce(lambda a, b: a.join(b, by, "left"), parts).select(*by, *PATCH_MEASURES)
