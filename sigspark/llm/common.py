"""What the text operators share: table access, the shared folder, and numpy views of Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, as every contract of this subpackage has it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 2 << 20
#: Rows of a few numbers that make a partition of their own.
GATHERED = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, (1 << 61) - 1, 256, dtype=np.uint64)
_PRIME = (1 << 61) - 1
_BASE = 0x9E3779B97F4A7C15 % _PRIME
_BASE_INVERSE = pow(_BASE, -1, _PRIME)
_P, _LOW = np.uint64(_PRIME), np.uint64((1 << 31) - 1)
_CACHED = 1 << 14
_N29, _N30, _N31, _N32, _N61 = map(np.uint64, (29, 30, 31, 32, 61))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one in the session a local run takes a temporary folder, and a
    cluster gets an error: its executors would write to disks of their own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not named and not current.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named or current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: later steps read it, whichever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint of ``df`` in partitions of about ``GATHERED`` rows, and the number of rows. A small table then makes few
    tasks and few shuffle files, however many partitions it came from."""
    df = cut_lineage(df)
    rows = df.count()
    return df.coalesce(in_parts(rows)), rows


def trimmed() -> None:
    """Gives a worker's freed memory back to the system, where the C library can: numpy leaves holes that it keeps."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_parts(rows: int) -> int:
    return max(1, -(-rows // GATHERED))


def join_hot(left: DataFrame, left_key: str, right: DataFrame, right_key: str, how: str = "inner") -> DataFrame:
    """A join of hot keys with one row per key. The hash as a second key keeps Spark from reusing the partitions of an
    aggregation on the right, so both sides have an exchange of their own and skewed partitions of the left are split."""
    right = right.withColumn("_join_hash", F.xxhash64(right_key))
    return left.join(right, (F.xxhash64(left_key) == F.col("_join_hash")) & (F.col(left_key) == F.col(right_key)), how).drop("_join_hash")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets from 0) of runs of documents of about ``limit`` bytes."""
    data, at = utf8(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each document (one entry more than documents)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """64-bit words modulo the prime 2^61 - 1."""
    x = (x & _P) + (x >> _N61)
    return np.minimum(x, x - _P)  # below zero wraps around and is the larger one


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from 31-bit halves: no sum below exceeds 64 bits. Short steps stay in the cache."""
    out = np.empty(len(a), np.uint64)
    one = not np.ndim(b)
    for k in range(0, len(a), _CACHED):
        x, y, to = a[k : k + _CACHED], b if one else b[k : k + _CACHED], out[k : k + _CACHED]
        x_high, x_low, y_high, y_low = x >> _N31, x & _LOW, y >> _N31, y & _LOW
        middle = x_high * y_low
        middle += x_low * y_high
        x_low *= y_low
        x_low += (middle & np.uint64((1 << 30) - 1)) << _N31
        middle >>= _N30
        x_low += middle
        x_high *= y_high
        x_high += x_high
        x_low += x_high
        np.bitwise_and(x_low, _P, out=to)
        x_low >>= _N61
        to += x_low
        np.minimum(to, to - _P, out=to)  # below zero wraps around and is the larger one
    return out


class Rolling:
    """Polynomial hashes, modulo the prime 2^61 - 1, of any range of a sequence from its prefix sums.

    The modulus is a prime because powers of two make texts of the Thue-Morse kind collide.
    """

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls._up) < n:
            size = len(cls._up)
            cls._up = np.concatenate([cls._up, _product(cls._up, np.uint64(pow(_BASE, size, _PRIME)))])
            cls._down = np.concatenate([cls._down, _product(cls._down, np.uint64(pow(_BASE_INVERSE, size, _PRIME)))])
        return cls._up[:n], cls._down[:n]

    def __init__(self, codes: np.ndarray, of: np.ndarray | None = None):
        """``of`` gives the number of each code where ``codes`` are numbers into it."""
        up, self.down = self._powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        total = np.uint64(0)
        for k in range(0, len(codes), _CACHED):
            some = codes[k : k + _CACHED]
            terms = _product(_folded(some) if of is None else of[some], up[k : k + len(some)])
            # Sums of 29 high and of 32 low bits are exact; 2^61 is one.
            low, high = np.cumsum(terms & np.uint64((1 << 32) - 1)), np.cumsum(terms >> _N32)
            low += total
            low += (high & np.uint64((1 << 29) - 1)) << _N32
            low += high >> _N29
            self.sums[k + 1 : k + 1 + len(some)] = _folded(low)
            total = self.sums[k + len(some)]

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Rolling:
        return cls(data, _BYTE_CODE)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        gap = self.sums[ends] - self.sums[starts]
        return mixed(_product(np.minimum(gap, gap + _P), self.down[starts]) + (ends - starts).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """The hash of every ``n`` successive items."""
        size = max(0, len(self.sums) - n)
        out = np.empty(size, np.uint64)
        for k in range(0, size, _CACHED):
            end = min(size, k + _CACHED)
            gap = self.sums[k + n : end + n] - self.sums[k:end]
            out[k:end] = mixed(_product(np.minimum(gap, gap + _P), self.down[k:end]) + np.uint64(n))
        return out


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive entries of ``first``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
