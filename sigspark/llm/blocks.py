"""Blocks of documents, and questions that blocks put to a table partitioned by hash.

Numpy steps that need all bytes of a few hundred documents work on blocks: rows of one compressed text each, written once
to the shared folder, so a block keeps its number whichever executor reads it. A block asks about many 64-bit keys at
once: sorted distinct keys, split by ranges of the hash space, six bytes a key. The answers come back in the same order,
so keys never travel twice, and a key that every document has is asked about once per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import shared_dir, steps, word_bounds

BLOCK_BYTES = 2_000_000

ASKED = "kind int, bucket int, block long, keys binary, more binary"
ANSWERED = "block long, kind int, bucket int, answer binary"


def squeezed(data: bytes, level: int = 5) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def restored(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in steps(batch.column(1), size):
            ids = batch.column(0).slice(first, end - first)
            words = len(word_bounds(data, at)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(at).tolist()], pa.list_(pa.int64())), pa.array([words], pa.int64()), pa.array([squeezed(data.tobytes(), 9)], pa.binary())],
                ["block", "ids", "sizes", "words", "data"],
            )


def into_blocks(docs: DataFrame, text: str, id_column: str, size: int = BLOCK_BYTES, parts: int = 0) -> DataFrame:
    """block, ids, sizes, words, data: a table in the shared folder. A null text is empty; a long one is a block alone.

    With ``parts`` it is bucketed by block into so many: answers that are partitioned likewise meet their blocks without a
    second copy of the blocks in a shuffle. The session's catalog then keeps an entry ``blocks_...`` for it."""
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(partial(_blocks, size=size), "block long, ids array<long>, sizes array<long>, words long, data binary").write.option("compression", "none")
    if parts:
        name = f"blocks_{uuid.uuid4().hex}"
        made.bucketBy(parts, "block").option("path", at).format("parquet").saveAsTable(name)
        return spark.table(name)
    made.parquet(at)
    return spark.read.parquet(at)


def opened(table: pa.Table | pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a block."""
    sizes = np.array(table["sizes"][row].as_py(), np.int64)
    return np.frombuffer(restored(table["data"][row].as_py()), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of six bytes, or of eight where six do not do."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = 6 if not len(gaps) or (gaps[1:] >> np.uint64(48)).max(initial=0) == 0 else 8
    head = keys[:1].astype("<u8").tobytes()
    return bytes([width]) + head + np.ascontiguousarray(gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) <= 1:
        return np.zeros(0, np.uint64)
    gaps = np.zeros(((len(data) - 9) // data[0] + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8, 1)
    gaps[1:, : data[0]] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def bucket_runs(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of sorted keys that go to one bucket; a bucket is a range of the hash space."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)]))


def bucket_count(blocks: int) -> int:
    """So many that a bucket holds about the keys of four blocks, however many blocks there are. A block then sends at most
    a row per key."""
    return max(1, blocks // 4)


Question = tuple[int, np.ndarray, Callable[[int, int], bytes]]


def questions(of_block: Callable[[pa.RecordBatch, int], Iterable[Question]], buckets: int):
    """A mapInArrow function. ``of_block`` yields (kind, sorted distinct keys, what else goes with keys[a:b])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for kind, keys, more in of_block(batch, row):
                    yield asked(batch["block"][row].as_py(), kind, keys, more, buckets)

    return run


def asked(block: int, kind: int, keys: np.ndarray, more: Callable[[int, int], bytes], buckets: int) -> pa.RecordBatch:
    runs = bucket_runs(keys, buckets)
    columns = [pa.array([kind] * len(runs), pa.int32()), pa.array([r[0] for r in runs], pa.int32()), pa.array([block] * len(runs), pa.int64())]
    columns += [pa.array([f(a, b) for _, a, b in runs], pa.binary()) for f in (lambda a, b: packed(keys[a:b]), more)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "block", "keys", "more"])


def answers(table: pa.Table, replies: list[bytes]) -> pa.Table:
    return pa.table([table["block"], table["kind"], table["bucket"], pa.array(replies, pa.binary())], names=["block", "kind", "bucket", "answer"])


def joined_answers(table: pa.Table, kind: int) -> list[bytes]:
    """A block's answers of one kind, in the order of its keys."""
    rows = [(b, a.as_py()) for k, b, a in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["answer"]) if k == kind]
    return [a for _, a in sorted(rows, key=lambda r: r[0])]
