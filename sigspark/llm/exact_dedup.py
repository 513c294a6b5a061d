"""Exact deduplication by two-pass Bloom filtering.

Pass one sets four bits per document hash in a filter with two bit planes: bits set once, and bits set again. Every task
fills its own filter, the filters merge block by block, and a hash that occurs twice has all its bits in the second
plane. Pass two probes that plane. Only rows that may be repeated are shuffled and grouped by SHA-256; the others pass
straight through. The filter's size follows the row count up to ``max_bits``, so what is broadcast is at most
``max_bits / 8`` bytes. Above that size the filter is fuller and more rows take the shuffle; the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, join_hot

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
_BLOCK_WORDS = 4096
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of each hash and its four bits there."""
    one, mask = np.uint64(1), np.zeros(len(hashes), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= one << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return (hashes & np.uint64(words - 1)).astype(np.int64), mask


def _filled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            hashes, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            at, mask = _places(hashes, words)
            np.bitwise_or.at(again, at, np.where(n > 1, mask, once[at] & mask))
            np.bitwise_or.at(once, at, mask)
        blocks = [b for b in range(0, words, _BLOCK_WORDS) if once[b : b + _BLOCK_WORDS].any()]
        for some in (blocks[i : i + 64] for i in range(0, len(blocks), 64)):
            planes = [zlib.compress(once[b : b + _BLOCK_WORDS].tobytes() + again[b : b + _BLOCK_WORDS].tobytes(), 1) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array([b // _BLOCK_WORDS for b in some], pa.int32()), pa.array(planes, pa.binary())], ["block", "planes"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter block per key, however many tasks filled it; memory is the blocks of this partition."""
    kept: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, planes in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = np.frombuffer(zlib.decompress(planes.as_py()), np.uint64).reshape(2, -1)
            if block in kept:
                old = kept[block]
                old[1] |= new[1] | (old[0] & new[0])
                old[0] |= new[0]
            else:
                kept[block] = new.copy()
    for block, planes in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(planes[1].tobytes(), 1)], pa.binary())], ["block", "planes"])


def _probe(hashes: DataFrame, bits: int):
    """A column function: may this hash occur twice among ``hashes`` (one long column)?"""
    words = bits // 64
    blocks = hashes.mapInArrow(_filled(words), "block int, planes binary").repartition("block").mapInArrow(_merged, "block int, planes binary")
    again = np.zeros(words, np.uint64)
    for block, planes in blocks.collect():  # at most max_bits / 8 bytes
        part = np.frombuffer(zlib.decompress(bytes(planes)), np.uint64)
        again[block * _BLOCK_WORDS : block * _BLOCK_WORDS + len(part)] = part
    shared = hashes.sparkSession.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        at, mask = _places(h.to_numpy(np.int64).view(np.uint64), words)
        return pd.Series((shared.value[at] & mask) == mask)

    return may_repeat


def mark_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all, if None) of ``docs`` with keep_id, group_size, kept and text_sha256.

    Equal texts form a group; the row with the largest id stays, a null id being the smallest. Of rows that repeat the
    same id and text exactly one stays: they are told apart by a hash of their other columns, and rows alike in all
    columns collapse to one with a count, which is dealt out again at the end. A null text is empty, and all empty texts
    are equal. Nothing is normalised, whole texts are hashed. An empty table gives no rows. Input columns named like an
    added one are replaced.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    kinds = dict(docs.dtypes)
    told_apart = [F.col(f"`{c}`") for c in columns if c != text and "map<" not in kinds[c]]
    bits = min(max_bits, 1 << max(18, (BITS_PER_ROW * docs.count() - 1).bit_length()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(id_column).alias("_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"), (F.xxhash64(*told_apart) if told_apart else F.lit(0).cast("long")).alias("_rest"))
    rows = rows.withColumn("_hash", F.xxhash64("text_sha256"))
    if text not in columns:  # what is left is small: the texts are hashed once
        rows = cut_lineage(rows)
    rows = rows.withColumn("_again", _probe(rows.select("_hash"), bits)("_hash"))
    single = rows.filter(~F.col("_again")).select("_doc.*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    alike = rows.filter("_again").groupBy("text_sha256", "_id", "_rest").agg(F.first("_doc").alias("_doc"), F.count("*").alias("_n"))
    best = alike.groupBy(F.col("text_sha256").alias("_sha")).agg(F.max(F.struct("_id", "_rest")).alias("_best"), F.sum("_n").alias("group_size"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")
    stays = F.struct("_id", "_rest").eqNullSafe(F.col("_best")) & (F.col("_copy") == 1)
    grouped = join_hot(alike, "text_sha256", best, "_sha").select("*", each).select("_doc.*", F.col("_best._id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")
    return single.unionByName(grouped)


def drop_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col(text).alias("_text"), F.col(id_column).alias("_id"))
    return mark_duplicates(inner, "_text", "_id").filter("kept").select("_whole.*")
