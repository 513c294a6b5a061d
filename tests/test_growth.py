"""What larger tables ask for: no time, memory or disk that grows with the square of a group, and the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import bundles as bd, cardiac as cd, components as co, frames as fr, kernels as kn, neighbours as nn, series as op, statistics as st, surrogates as su
from sigspark.plans.all import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(frame, part="executedPlan"):
    return getattr(frame._jdf.queryExecution(), part)().toString().lower()


def gridded(t, fs):
    """The rate of one series on the grid, by whole arrays."""
    t = np.unique(t)
    at, rate = t[:-1] + np.diff(t) / 2, 60 / np.diff(t)
    grid = np.arange(np.ceil(at[0] * fs), max(np.ceil(at[0] * fs), np.floor(at[-1] * fs)) + 1)
    return grid, np.interp(grid / fs, at, rate)


@pytest.mark.parametrize("fs", [1.0, 0.1, 7.0, 1 / 3600])
def test_rate_on_grid_equals_whole_arrays(spark, fs):
    rng = np.random.default_rng(5)
    series = {0: np.cumsum(rng.exponential(0.3 / fs, 400)), 1: np.repeat(np.sort(rng.integers(0, 90, 60)), 3) / fs, 2: np.arange(12) * 0.5 / fs, 3: np.r_[np.arange(5) * 0.01, 50 + np.arange(5)] / fs, 4: np.arange(3) / fs}
    peaks = pd.DataFrame([(k, float(v)) for k, t in series.items() for v in rng.permutation(t)], columns=["k", "t_s"])
    found = bd.rate_on_grid(spark.createDataFrame(peaks), fs, ["k"]).toPandas().sort_values(["k", "idx"])
    assert set(found["k"]) == {0, 1, 2, 3}  # three peaks are too few
    for k in range(4):
        grid, x = gridded(series[k], fs)
        mine = found[found["k"] == k]
        assert mine["idx"].tolist() == grid.astype(int).tolist()
        assert np.allclose(mine["x"], x, rtol=1e-9)


def test_windows_over_peaks_stay_inside_a_stretch_of_the_grid(spark):
    """Two sorts of rows order a whole series: knots and places of the grid. Raw peaks are ordered by stretch."""
    peaks = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("t_s"))
    plan = plan_of(bd.rate_on_grid(peaks, 0.5, ["k"]), "optimizedPlan")
    assert all("_c#" in w.split("windowspecdefinition(")[1] for w in plan.split("window [") if "lead(_t#" in w)


def open_frames(frame):
    """Window frames that end unbounded but begin at the row: each is read anew for every row."""
    return plan_of(frame, "optimizedPlan").count("currentrow$(), unboundedfollowing$()")


def test_no_frame_is_read_anew_for_every_row(spark):
    peaks = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("idx"), F.col("id").cast("double").alias("t_s"), F.lit(1.0).alias("x"))
    samples = peaks.select("k", F.col("t_s").alias("t"), "x")
    assert open_frames(bd.rate_on_grid(peaks, 0.5, ["k"])) == 0
    assert open_frames(op.filled(peaks, ["k"])) == open_frames(op.interpolated(samples, samples.select("k", "t"), ["k"])) == 0


def test_gaps_and_ties_by_running_values(spark):
    rows = pd.DataFrame({"k": 1, "idx": range(9), "x": [None, None, 2.0, None, None, 5.0, 7.0, None, None]})
    found = op.filled(spark.createDataFrame(rows.astype({"x": float}).replace({np.nan: None}), "k long, idx long, x double"), ["k"]).orderBy("idx").toPandas()
    assert found["x"].tolist() == [2, 2, 2, 3, 4, 5, 7, 7, 7]
    samples = spark.createDataFrame([(1, 1.0, 10.0), (1, 2.0, None), (1, 3.0, 30.0)], "k long, t double, x double")
    grid = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 3, 4)], "k long, t double")
    both = [op.interpolated(samples, grid, ["k"], hold=hold).orderBy("t").toPandas()["x"].tolist() for hold in (True, False)]
    assert both[0] == [10, 10, 20, 30, 30] and np.isnan(both[1][0]) and both[1][1:4] == [10, 20, 30] and np.isnan(both[1][4])


def test_events_are_read_once_for_the_guard_and_the_paths(spark):
    peaks = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") + F.col("id") % 3 / 10).alias("t_s"))
    envelope = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("idx"), F.sin("id").alias("x"))
    pairs = cd.matched_to_rate(peaks, envelope, 1.0, ["k"])
    assert pairs.count() > 100 and "lead(" not in plan_of(pairs, "optimizedPlan")


def test_the_slow_path_does_not_compute_the_fast_one(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cd, "cut_lineage", lambda df: written.append(df.columns) or df)
    pairs = spark.range(300).select(F.lit(1).alias("s"), F.col("id").alias("idx"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    found = cd.two_path_measures(pairs, 1.0, 48, 24, 2, 3, 64, ["s"], 0.06, (0.05, 0.3))
    assert len(written) == 2  # pairs and windowed means
    assert "python" not in plan_of(found.filter("path = 'slow'"), "optimizedPlan")
    assert sorted(found.select("metric").toPandas()["metric"]) == ["frequency", "mi", "plv", "preferred_lag_s", "wpli", "xcorr_lag", "xcorr_peak"]


@pytest.mark.parametrize("name", ["feat_rate_spectrum"])
def test_queries_have_no_open_frames(spark, name):
    assert open_frames(QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("gaps", [False, True])
def test_windows_gathered_in_a_row_give_the_same_dynamic_modes(spark, gaps):
    rng = np.random.default_rng(3)
    t = np.arange(40)
    waves = np.outer(np.cos(0.5 * t), rng.normal(size=6)) + np.outer(np.sin(0.5 * t), rng.normal(size=6)) + 0.4 * np.outer(np.cos(1.3 * t) * 0.98**t, rng.normal(size=6)) + 0.01 * rng.normal(size=(40, 6))
    rows = pd.DataFrame([(w, int(i), int(c), float(waves[w * 10 + i, c])) for w in range(3) for i in range(20) for c in range(6) if not (gaps and (i, c) in ((7, 2), (0, 1)))], columns=["w", "idx", "c", "x"])
    df = co.centred(spark.createDataFrame(rows), ["w"], "c")
    found = [co.dynamic_modes(df, ["w"], "idx", "c", 25.0, bounded=b).orderBy("w", "mode").toPandas() for b in (False, True)]
    assert len(found[0]) > 6 and list(found[0].columns) == list(found[1].columns)
    same = ["w", "mode", "frequency", "growth", "energy", "size", "log_rate"]  # either of a complex pair may stand for both
    assert np.allclose(found[0][same].to_numpy(float), found[1][same].to_numpy(float), rtol=1e-5, atol=1e-6)


def test_short_and_constant_windows_have_no_dynamic_modes(spark):
    rows = [(1, i, c, 1.0) for i in range(5) for c in range(3)] + [(2, i, c, float(i * c)) for i in range(2) for c in range(3)]
    df = co.centred(spark.createDataFrame(rows, "w long, idx long, c long, x double"), ["w"], "c")
    assert co.dynamic_modes(df, ["w"], "idx", "c", 25.0, bounded=True).count() == 0


def test_windowed_modes_hand_on_no_matrix_of_each_instant(spark):
    plan = plan_of(QUERIES["vid_dynamic_modes_windowed"](spark, SF), "optimizedPlan")
    assert "cells#" not in plan  # sums of products: 64 by 64 numbers for an instant of 64
    assert plan.count("mapinpandas") == 1  # five columns of the curve, decomposed once


def test_pixels_are_numbered_by_frame(spark):
    rows = [(c, f, y, 0, 1.0) for c, frames in ((1, (7, 3, 9)), (2, (5,)), (None, (2, 1))) for f in frames for y in range(2)]
    s = fr.pixel_series(spark.createDataFrame(rows, "clip long, frame long, y long, px long, v double"))
    assert sorted((-1 if r.clip is None else r.clip, r.y, r.idx) for r in s.collect()) == sorted((c, y, i) for c, n in ((1, 3), (2, 1), (-1, 2)) for y in range(2) for i in range(n))


def pictures(spark, rng, clips, size, drop=0.0):
    """Frames of small pictures, some pixels missing and some null."""
    rows = [(c, 3 * f + 1, y, x, None if drop and rng.random() < drop else float(np.float32(rng.integers(0, 4) / 4 + 0.1 * c))) for c, n in clips.items() for f in range(n) for y in range(size) for x in range(size) if not drop or rng.random() > drop]
    return spark.createDataFrame(rows, "clip long, frame long, y long, px long, v double"), pd.DataFrame(rows, columns=["clip", "frame", "y", "px", "v"])


@pytest.mark.parametrize("cells, drop", [(1 << 18, 0.0), (64, 0.0), (64, 0.3)])
def test_gram_does_not_depend_on_the_blocks(spark, monkeypatch, cells, drop):
    monkeypatch.setattr(fr, "_BLOCK_CELLS", cells)
    frames, rows = pictures(spark, np.random.default_rng(8), {0: 21, 5: 1, 9: 7}, 4, drop)
    rows["i"] = rows.groupby("clip")["frame"].rank("dense").astype(int) - 1
    rows["v"] -= rows.groupby(["clip", "y", "px"])["v"].transform("mean")
    both = rows.merge(rows, on=["clip", "y", "px"]).query("i_x <= i_y")
    both["g"] = both["v_x"] * both["v_y"]
    expected = both.groupby(["clip", "i_x", "i_y"])["g"].agg(lambda v: v.sum(min_count=1))
    found = fr.snapshots_gram(frames).toPandas().set_index(["clip", "i", "j"])["g"].sort_index()
    assert list(found.index) == list(expected.index)
    assert np.allclose(found, expected, atol=1e-12, equal_nan=True)


def test_gram_makes_no_row_for_every_pixel_of_two_frames(spark):
    """Rows that are exploded are blocks; products of two frames are made where they are added up."""
    frames, _ = pictures(spark, np.random.default_rng(8), {0: 5}, 4)
    plan = plan_of(fr.snapshots_gram(frames), "optimizedPlan")
    assert "explode(_v#" not in plan and plan.count("mapinarrow") == 1


@pytest.mark.parametrize("drop", [0.0, 0.03])
def test_motion_equals_a_search_of_every_block(spark, drop):
    """Ties, missing pixels and nulls, over the borders of stretches of frames."""
    frames, rows = pictures(spark, np.random.default_rng(2), {2: 14, 3: 2}, 6, drop)
    rows["i"] = rows.groupby("clip")["frame"].rank("dense").astype(int) - 1
    at = {(r.clip, r.i, r.y, r.px): r.v for r in rows.itertuples()}
    expected = set()
    for clip, n in ((2, 14), (3, 2)):
        for stride in (1, 3, 9):
            for i in range(stride, n):
                for by in range(3):
                    for bx in range(3):
                        tried = []
                        for dy in range(-2, 3):
                            for dx in range(-2, 3):
                                met = [(at[a], at[b]) for y in (2 * by, 2 * by + 1) for x in (2 * bx, 2 * bx + 1) if (a := (clip, i, y, x)) in at and (b := (clip, i - stride, y - dy, x - dx)) in at]
                                if len(met) == 4:
                                    d = [abs(p - q) for p, q in met if p == p and q == q]
                                    tried.append((round(sum(d) / len(d), 9) if d else -1.0, abs(dy) + abs(dx), dy, dx))
                        if tried:
                            expected.add((clip, stride, i, by, bx, *min(tried)[2:]))
    found = fr._motion(frames, 2, 2, (1, 3, 9), 4)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    one = fr.block_motion(frames, 2, 2, 3)
    assert {tuple(r) for r in one.collect()} == {(c, *rest) for c, s, *rest in expected if s == 3}


def test_motion_copies_no_pixel_for_a_displacement(spark):
    frames, _ = pictures(spark, np.random.default_rng(2), {2: 4}, 4)
    plan = plan_of(fr.motion_at_strides(frames, 2, 2), "optimizedPlan")
    assert plan.count("generate explode(") == plan.count("mapinarrow run") == 1  # stretches of frames
    assert "explode(array(" not in plan and "explode([" not in plan


def test_families_are_ranked_by_many_tasks_and_without_open_frames(spark):
    rng = np.random.default_rng(4)
    p = np.r_[rng.integers(0, 30, 200) / 30, np.nan, np.nan]
    df = spark.createDataFrame([(int(i % 2), i, None if v != v else float(v)) for i, v in enumerate(p)], "fam long, id long, p double")
    found = [st.bh_fdr(df, "p", ["fam"], spread=spread) for spread in (False, True)]
    assert open_frames(found[0]) == 0
    got = [f.orderBy("id").toPandas()["p_fdr"].to_numpy(float) for f in found]
    assert np.allclose(got[0], got[1], rtol=1e-12, equal_nan=True)
    for fam in (0, 1):
        own = p[fam:200:2]
        by = np.argsort(own)
        q = np.minimum.accumulate((own[by] * len(own) / np.arange(1, len(own) + 1))[::-1])[::-1]
        assert np.allclose(got[0][fam:200:2][by], np.minimum(q, 1))
    plan = plan_of(QUERIES["stat_bh_fdr"](spark, SF), "optimizedPlan")
    assert all("_c#" in w.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0] for w in plan.split("window [")[1:])


@pytest.mark.parametrize("k", [1, 3])
def test_all_distances_at_once_equal_the_growing_stretch(k):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 32)), rng.normal(size=(30, 32))
    x[5:10], y[5:15] = rng.integers(0, 4, (5, 32)), rng.integers(0, 3, (10, 32))  # ties
    y[20] = 1.0
    assert np.allclose(nn._many(x, y, k), [nn.mutual_information(a, b, k)["mi_knn"] for a, b in zip(x, y)], rtol=1e-12, atol=1e-12)


def test_effective_information_equals_rows_of_surrogates(spark):
    rng = np.random.default_rng(7)
    rows = [(p, i, None if (p, i) == (1, 4) or p == 3 else float(rng.normal()), float(rng.normal())) for p, n in ((0, 32), (1, 32), (2, 3), (3, 8), (4, 150)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair_id long, idx long, x double, y double")
    found = nn.effective_information(df, 9, ["pair_id"])
    assert plan_of(found, "optimizedPlan").count("generate") == 0
    values = kn.per_group(kn.phase_surrogates(df, 9, ["pair_id"]), ["pair_id", "surrogate"], ["x", "y"], lambda a, b: nn.mutual_information(a, b, 3), "mi_knn double")
    old = su.surrogate_test(values.select("pair_id", "surrogate", F.round("mi_knn", 9).alias("value")), ["pair_id"])
    a, b = (f.orderBy("pair_id").toPandas() for f in (found, old))
    for c in ("pair_id", "observed", "null_mean", "null_std", "p", "z"):
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
