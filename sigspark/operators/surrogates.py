"""Surrogates and permutations as a column: every draw comes from a hash of its keys, so reruns and engines agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import ratio, uniform
from .series import whole


def time_shifted(pairs: DataFrame, n_surrogates: int, keys: list[str], target: str = "y") -> DataFrame:
    """keys, surrogate, idx, x, y: the target moved around the circle by a drawn shift, at least a twentieth of its length.

    Surrogate 0 is the original. The rows of one series are brought together once and read at shifted places.
    """
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("_v"))
    each = rows.select(*keys, "_v", F.size("_v").cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_surrogates).cast("long"))).alias("surrogate"))
    least = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / 20).cast("long"))
    shift = F.when(F.col("surrogate") == 0, 0).otherwise(least + uniform(*keys, "surrogate") % F.greatest(F.lit(1).cast("long"), F.col("_n") - 2 * least + 1))
    moved = each.withColumn("_shift", shift).select(*keys, "surrogate", "_n", "_shift", "_v", F.posexplode("_v").alias("_i", "_r"))
    other = F.col("_v")[F.pmod(F.col("_i") - F.col("_shift"), F.col("_n")).cast("int")]
    if target == "y":
        return moved.select(*keys, "surrogate", F.col("_r.idx").alias("idx"), F.col("_r.x").alias("x"), other["y"].alias("y"))
    return moved.select(*keys, "surrogate", F.col("_r.idx").alias("idx"), other["x"].alias("x"), F.col("_r.y").alias("y"))


def surrogate_test(values: DataFrame, keys: list[str], value: str = "value", higher: bool = True) -> DataFrame:
    """observed, null_mean, null_std, quantiles, z and the add-one p from (keys, surrogate, value); surrogate 0 is observed."""
    v = values.withColumns({"_o": F.max(F.when(F.col("surrogate") == 0, F.col(value))).over(whole(keys)), "_null": F.when(F.col("surrogate") > 0, F.col(value))})
    beyond = F.col("_null") >= F.col("_o") if higher else F.col("_null") <= F.col("_o")
    q = F.percentile("_null", F.array(*map(F.lit, (0.025, 0.95, 0.975))))
    g = v.groupBy(*keys).agg(F.max("_o").alias("observed"), F.avg("_null").alias("null_mean"), F.stddev_pop("_null").alias("null_std"), q.alias("_q"), ((F.count_if(beyond) + 1) / (F.count("_null") + 1)).alias("p"))
    return g.select(*keys, "observed", "null_mean", "null_std", F.col("_q")[0].alias("p2_5"), F.col("_q")[1].alias("p95"), F.col("_q")[2].alias("p97_5"), "p", ratio(F.col("observed") - F.col("null_mean"), "null_std").alias("z"))


def _clusters(t: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Runs of neighbouring times whose t goes beyond the threshold on one side: first, last, mass."""
    high = t.filter(F.abs("t") > threshold).withColumn("_sign", F.signum("t"))
    island = high.withColumn("_island", F.col("idx") - F.row_number().over(W.partitionBy(*by, "_sign").orderBy("idx")))
    return island.groupBy(*by, "_sign", "_island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum("t").alias("mass"))


def _tested(t: DataFrame, n: int, keys: list[str], threshold: float) -> DataFrame:
    c = _clusters(t, [*keys, "perm"], threshold)
    top = c.filter("perm > 0").groupBy(*keys, "perm").agg(F.max(F.abs("mass")).alias("_top"))
    seen = c.filter("perm = 0").select(*keys, "first", "last", "mass")
    if not keys:
        seen, top = seen.withColumn("_one", F.lit(1)), top.withColumn("_one", F.lit(1))
    by = keys or ["_one"]
    beyond = F.count_if(F.round("_top", 9) >= F.round(F.abs("mass"), 9))
    return seen.join(top, by, "left").groupBy(*keys, "first", "last", "mass").agg(((beyond + 1) / (n + 1.0)).alias("p"))


def permutations(df: DataFrame, n: int) -> DataFrame:
    """Every row once per permutation; number 0 is the data as they are."""
    return df.withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))


def _permuted_sums(values: DataFrame, weights: str, n: int, keys: list[str], fixed: dict[str, Column], of: dict[str, Column]) -> DataFrame:
    """keys, idx, perm, the sums ``fixed``, and for each name in ``of`` the sum of its column times the permutation's entry in
    the array ``weights``. Rows are never copied: every Arrow batch adds up its own rows, and those sums are shuffled."""
    by = [*keys, "idx"]
    kinds = dict(values.dtypes)
    rows = values.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in by)).select(*by, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{name}") for name, c in {**fixed, **of}.items()], weights)

    plain, weighted = list(fixed), list(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, max(1, (1 << 20) // (n + 1))):
                part = batch.slice(first, max(1, (1 << 20) // (n + 1)))
                code = part.select(by).to_pandas().groupby(by, sort=False).ngroup().to_numpy()
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                w = part.column(weights).flatten().to_numpy().reshape(part.num_rows, n + 1)[order]
                out = [part.column(k).take(pa.array(order[begin])) for k in by]
                out += [pa.array(np.add.reduceat(part.column(f"_{name}").to_numpy()[order], begin)) for name in plain]
                for name in weighted:
                    sums = np.add.reduceat(part.column(f"_{name}").to_numpy()[order][:, None] * w, begin, axis=0)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n + 1, dtype=np.int32)), pa.array(sums.ravel())))
                yield pa.RecordBatch.from_arrays(out, [*by, *plain, *weighted])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), *(f"{name} double" for name in fixed), *(f"{name} array<double>" for name in of)])
    first = next(iter(of))
    parts = rows.mapInArrow(run, schema)
    each = parts.select(*by, *fixed, *of, F.posexplode(first).alias("perm", "_v"))
    each = each.select(*by, F.col("perm").cast("long").alias("perm"), *fixed, *[F.get(F.col(name), F.col("perm")).alias(name) for name in of])
    return each.groupBy(*by, "perm").agg(*[F.sum(name).alias(name) for name in (*fixed, *of)])


def cluster_test_paired(diffs: DataFrame, n: int, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Clusters of a paired difference over time (subject, idx, diff): sign flips per subject, largest cluster mass. Signs are
    drawn once per subject; squares do not change under them, so sums of signed differences give every t."""
    keys = keys or []
    sign = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")), lambda p: F.when((p > 0) & (uniform("subject", p) >= (1 << 31)), -1.0).otherwise(1.0))
    signed = diffs.join(diffs.select("subject").distinct().withColumn("_sign", sign), "subject")
    d = F.col("diff")
    g = _permuted_sums(signed, "_sign", n, keys, {"n": F.when(d.isNotNull(), 1.0), "q": d * d}, {"m": d})
    mean = ratio("m", "n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("q") - F.col("m") * mean, F.col("n") - 1)))
    return _tested(g.withColumn("t", ratio(mean, deviation / F.sqrt("n"))), n, keys, threshold)


def cluster_test_two_sample(values: DataFrame, n: int, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Clusters of the difference of two groups (subject, grp 0 or 1, idx, x): labels shuffled over subjects, Welch's t. Only
    subjects are copied per permutation; rows meet the array of their subject's labels."""
    keys = keys or []
    people = permutations(values.select(*keys, "subject", "grp").distinct(), n)
    order = F.row_number().over(W.partitionBy(*keys, "perm").orderBy(uniform("subject", "perm"), "subject"))
    size = F.count_if(F.col("grp") == 0).over(W.partitionBy(*keys, "perm"))
    people = people.withColumn("_g", F.when(F.col("perm") == 0, F.col("grp")).otherwise((order > size).cast("int")))
    labels = people.groupBy(*keys, "subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "_g"))), lambda p: p["_g"].cast("double")).alias("_labels"))
    x = F.col("x").cast("double")
    one = F.when(x.isNotNull(), 1.0)
    g = _permuted_sums(values.drop("grp").join(labels, [*keys, "subject"]), "_labels", n, keys, {"n": one, "s": x, "q": x * x}, {"s1": x, "q1": x * x, "n1": one})
    g = g.withColumns({"n0": F.col("n") - F.col("n1"), "s0": F.col("s") - F.col("s1"), "q0": F.col("q") - F.col("q1")})

    def spread(k: int) -> Column:
        n_k, s, q = F.col(f"n{k}"), F.col(f"s{k}"), F.col(f"q{k}")
        return ratio(F.greatest(F.lit(0.0), ratio(q - ratio(s * s, n_k), n_k - 1)), n_k)

    return _tested(g.withColumn("t", ratio(ratio("s0", "n0") - ratio("s1", "n1"), F.sqrt(spread(0) + spread(1)))), n, keys, threshold)


def tested_metric(pairs: DataFrame, metric_fn: Callable[[DataFrame, list[str]], DataFrame], n: int, keys: list[str], method: str = "shift", target: str = "y", higher: bool = True) -> DataFrame:
    """The surrogate test of any metric: observed, null_mean, null_std, quantiles, p, z per ``keys``.

    ``metric_fn(rows, by)`` is a plan: from idx, x, y rows to one row per ``by`` (the keys and surrogate) with a column ``value``. It
    runs over the data and all surrogates at once. ``method``: shift (round the circle) or phase (random phases of y).
    """
    if method not in ("shift", "phase") or method == "phase" and target != "y":
        raise ValueError(f"method {method} with target {target}")
    from .kernels import phase_surrogates

    moved = time_shifted(pairs, n, keys, target) if method == "shift" else phase_surrogates(pairs, n, keys)
    return surrogate_test(metric_fn(moved, [*keys, "surrogate"]).select(*keys, "surrogate", F.round("value", 9).alias("value")), keys, higher=higher)
