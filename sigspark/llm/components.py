"""Connected components of an edge table: links contracted inside partitions, then alternating large and small stars.

A checkpoint per round. Partitions follow the number of links that are left, not the session's number of partitions: a
round of a few thousand links would else cost as many tasks and files as one of millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, in_parts, join_hot

#: Links that a task holds at once.
_HELD = 1 << 18


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new[jumped]]
        if (new == label).all():
            return label
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as links of each node to the smallest one that it reaches over ``_HELD`` successive links."""
    held: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        u, v = (table.column(c).to_numpy() for c in ("u", "v"))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = least_reached(len(nodes), place[: len(u)], place[len(u) :])
        others = np.flatnonzero(least != np.arange(len(nodes)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[others]), pa.array(nodes[least[others]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            yield star()
    if held:
        yield star()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v, both long): root is the component's smallest node.

    Self-links and repeated links do no harm; an empty table gives no rows. Every round sends a link's ends towards the
    smallest node they know of, so chains shrink by half or better. Only a count and a checksum reach the driver.
    """
    edges = cut_lineage(edges.filter("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        parts = in_parts(state[0])
        near = cut_lineage(edges.coalesce(parts).mapInArrow(_contracted, "u long, v long"))
        both = near.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m")).coalesce(parts)
        large = join_hot(both.filter("v > u"), "u", least, "c").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(parts)
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).coalesce(parts)
        small = join_hot(large, "u", least, "c").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.*").filter("u <> v").distinct().coalesce(parts))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().coalesce(in_parts(state[0])))
