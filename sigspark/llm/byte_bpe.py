"""Byte-level BPE by a two-tier lookup.

A text is split by the pattern into pre-tokens. All pre-tokens of a step are hashed at once, and a minimal perfect hash over
the vocabulary gives the only entry that each may be; an exact comparison of the bytes settles it. What is no entry as a
whole goes to the second tier: adjacent parts, linked by their byte places, are merged from a heap by rank and place.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import mixed, steps, utf8

_SLACK = 1.6
_CACHED = 200_000
#: Texts of one numpy step, in bytes.
_STEP = 1 << 20
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class PerfectHash:
    """Numbers ``n`` distinct 64-bit keys from 0 to n - 1. Every level places the keys that are alone in their slot and hands
    the others on; a key's number is the rank of its slot among all that are taken."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.n, self.levels, first = len(keys), [], 0
        left = keys.astype(np.uint64)
        while len(left):
            slots = int(_SLACK * len(left)) + 1
            at = self._slot(left, len(self.levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            self.levels.append((alone, first + np.cumsum(alone) - 1))
            first += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(slots)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of other keys any number, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = self._slot(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


class Words:
    """Byte strings of a buffer, eight bytes at a time."""

    def __init__(self, data: bytes):
        self.padded = data + bytes(16)
        self.at = np.ndarray((len(data) + 8,), "<u8", self.padded, 0, (1,))

    def word(self, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of the strings (longer than 8 k), zeros beyond their ends."""
        return self.at[starts + 8 * k] & _LOW_BYTES[np.minimum(sizes - 8 * k, 8)]

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h, left, k = mixed(sizes.astype(np.uint64)), np.arange(len(starts)), 0
        while len(left):
            h[left] = mixed(h[left] ^ self.word(starts[left], sizes[left], k))
            k += 1
            left = left[sizes[left] > 8 * k]
        return h


class Vocabulary:
    """Entries by rank, where an entry's rank is its id and every single byte is an entry."""

    _made: dict[tuple, Vocabulary] = {}

    def __init__(self, entries: list[bytes], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = {e: k for k, e in enumerate(entries)}
        if len(self.ranks) != len(entries) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("entries must be distinct and hold every byte")
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        joined = b"".join(entries)
        self.bytes, self.words = np.frombuffer(joined, np.uint8), Words(joined)
        self.longest = int(self.sizes.max())
        self.index = PerfectHash(keys := self.words.hashes(self.starts, self.sizes))
        self.ids = np.empty(len(entries), np.int64)
        self.ids[self.index(keys)] = np.arange(len(entries))
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines ``base64 rank``; once a process."""
        if (path, pattern) not in cls._made:
            with open(path, "rb") as f:
                known = {int(r): base64.b64decode(e) for e, r in map(bytes.split, f)}
            if sorted(known) != list(range(len(known))):
                raise ValueError(f"{path}: ranks must run from 0 without gaps")
            cls._made[path, pattern] = cls([known[k] for k in range(len(known))], pattern)
        return cls._made[path, pattern]

    def whole(self, data: Words, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first tier: ids of those strings that are entries, -1 for the others."""
        out = np.full(len(starts), -1, np.int64)
        left = np.flatnonzero(sizes <= self.longest)
        number = self.index(data.hashes(starts[left], sizes[left]))
        left, ids = left[number >= 0], self.ids[number[number >= 0]]
        same = self.sizes[ids] == sizes[left]
        k = 0
        while same.any():  # byte by byte, eight at a time
            check = np.flatnonzero(same & (sizes[left] > 8 * k))
            if not len(check):
                break
            here, there = left[check], ids[check]
            same[check] = data.word(starts[here], sizes[here], k) == self.words.word(self.starts[there], self.sizes[there], k)
            k += 1
        out[left[same]] = ids[same]
        return out

    def merged(self, piece: bytes) -> bytes:
        """The second tier: ids of a piece as little-endian 32-bit numbers. Of equal ranks the leftmost merges first."""
        n, ranks, longest = len(piece), self.ranks, self.longest
        after, before = list(range(1, n + 1)), list(range(-1, n))  # a part is named by its first byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:  # one of the two has merged since
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                if (far := after[end]) - i <= longest and (r := ranks.get(piece[i:far])) is not None:
                    heapq.heappush(heap, (r, i, far))
            if (p := before[i]) >= 0 and end - p <= longest and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        found = np.array(out, "<u4").tobytes()
        if len(self.cache) < _CACHED and n <= 64:
            self.cache[piece] = found
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one entry more than texts)."""
        pieces, n_pieces = [], []
        for t in texts:
            found = self.pattern.findall(t)
            pieces += found
            n_pieces.append(len(found))
        joined = "".join(texts)
        data = joined.encode()
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(pieces) and ends[-1] != len(joined):
            raise ValueError("the pattern must match every character")
        if len(data) != len(joined):  # places of characters to places of bytes
            raw = np.frombuffer(data, np.uint8)
            ends = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(data))[ends]
        starts = np.concatenate(([0], ends))[:-1]
        ids = self.whole(Words(data), starts, ends - starts)
        missed = np.flatnonzero(ids < 0)
        known, merge = self.cache.get, self.merged
        merged = [known(p := data[a:b]) or merge(p) for a, b in zip(starts[missed].tolist(), ends[missed].tolist())]
        size = np.ones(len(ids) + 1, np.int64)
        size[missed] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        at = np.concatenate(([0], np.cumsum(size[:-1])))
        out, single = np.empty(at[-1], np.uint32), np.zeros(at[-1], bool)
        single[at[:-1][ids >= 0]] = True
        out[single] = ids[ids >= 0]
        out[~single] = np.frombuffer(b"".join(merged), "<u4")
        return out, at[np.concatenate(([0], np.cumsum(n_pieces))).astype(np.int64)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The entries' bytes, end to end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def text_list(column: pa.Array) -> list[str]:
    """Null counts as empty, and bytes that are no UTF-8 as U+FFFD."""
    data, at = utf8(column)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def blob_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column over ``data`` with the byte places ``at``."""
    kind, wide = (pa.binary(), np.int32) if at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(wide)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids: one row per document, ids as little-endian 32-bit numbers.

    A null or empty text has no ids. Whole texts are encoded, whatever their length; strings of special tokens are ordinary
    text. Rows that repeat an id are documents of their own, and a null id stays null. Bytes that are no UTF-8 count as
    U+FFFD. Of merges with equal ranks the leftmost goes first. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.of(ranks_path, pattern)
        for batch in batches:
            for first, end, _, _ in steps(batch.column(1), _STEP):
                ids, at = known.encode(text_list(batch.column(1).slice(first, end - first)))
                blobs = blob_array(ids.astype("<u4", copy=False), 4 * at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(at), pa.int64()), blobs], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with ``out``: the bytes that the ids of each row stand for. Null or no ids give no bytes; an id outside the
    vocabulary is an error."""
    kept = [c for c in tokens.columns if c != out]
    rows = tokens.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.of(ranks_path, pattern)
        for batch in batches:
            for first, end, data, at in steps(batch.column(1), 2 * _STEP):
                numbers = data.view("<u4").astype(np.int64)
                places = np.concatenate(([0], np.cumsum(known.sizes[numbers])))[at // 4]
                blobs = blob_array(known.decode(numbers), places)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), blobs], ["row", "decoded"])

    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row}, decoded binary").select("row.*", F.col("decoded").alias(out))
