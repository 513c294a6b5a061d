"""Alignment of two tokenizers' tokens, with corpus-wide counts of token pairs by external spill counting.

Token ends that both tokenizers share cut a text into groups; the two tokens that end there are a link. Every block of
documents writes its pair-document records once to the shared folder: the distinct pairs with their counts as zstd runs,
radix-partitioned by a hash of the B token, and which document holds which pair. Runs of one partition are merged k ways
from a heap, ``FAN`` at a time, level by level, so that a pair of every document is one entry per run and no task ever holds
more than ``FAN`` compressed runs of one partition. Runs are in the order of B, then A: the last merge knows every
B token's highest count as soon as its pairs have passed. Totals then stream back along the same tree, to each run in its
own order, and at last to the blocks, which add them up per document.

A partition's run has at most an entry per pair of vocabulary entries, however large the corpus is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import restored, squeezed
from .byte_bpe import Vocabulary, text_list
from .common import mixed, per_document, shared_dir, steps

BLOCK_BYTES = 2_000_000
#: Radix partitions of the pairs, by B token, and runs that one merge takes.
RADIXES = 64
FAN = 16
#: Pairs of one chunk of a run: what a merge holds of it at once.
CHUNK = 1 << 14
#: Below it letters have been letters since Unicode 5, and the split is the same in every library.
_SETTLED = "ɐ"
_SEPARATORS = np.frombuffer(b",|;", np.uint8)


class Entries:
    """Byte strings by number, end to end."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class TokenPair:
    """Tokenizer A (byte-level BPE, a JSON file) and tokenizer B (a sentencepiece model)."""

    _made: dict[tuple, TokenPair] = {}

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"] for t in model["added_tokens"]}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
        known = {i: bytes(map(byte_of.__getitem__, t)) for t, i in model["model"]["vocab"].items() if t not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        if sorted(known) != list(range(len(known))) or any(model["model"]["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
            raise ValueError(f"{a_path}: ids must run from 0, bytes first, then merges in order")
        self.a_path, self.a = a_path, Vocabulary([known[k] for k in range(len(known))], pattern)
        self.a_entries = Entries([known[k] for k in range(len(known))])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_entries = Entries([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if not self.b_entries.sizes.all():
            raise ValueError(f"{b_path}: a piece is empty")
        self.decimals = Entries([b"%d," % k for k in range(max(len(known), len(pieces)))])
        self._library = None

    @classmethod
    def of(cls, *paths: str) -> TokenPair:
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def library(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.a_path)
            self._library.encode_special_tokens = True
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and where each text's begin. Texts with letters that libraries may split otherwise go to the tokenizer's own."""
        settled = [t.isascii() or max(t) < _SETTLED for t in texts]
        ids, at = self.a.encode([t for t, s in zip(texts, settled) if s])
        if all(settled):
            return ids.astype(np.int64), at
        mine = iter(np.split(ids.astype(np.int64), at[1:-1]))
        parts = [next(mine) if s else self.library(t) for t, s in zip(texts, settled)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(list(map(len, parts)))))

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = self.b.encode(texts, num_threads=1)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        return np.fromiter((i for p in parts for i in p), np.int64, at[-1]), at


class Aligned:
    """Some texts' tokens, groups and links. Texts without tokens have none of them."""

    def __init__(self, pair: TokenPair, texts: list[str]):
        n = len(texts)
        some = [k for k, t in enumerate(texts) if t]
        spaced = [b" " + texts[k].encode() for k in some]
        sides = []
        for entries, (ids, at) in ((pair.a_entries, pair.encode_a([" " + texts[k] for k in some])), (pair.b_entries, pair.encode_b([texts[k] for k in some]))):
            raw = entries.joined(ids).tobytes()
            ends = np.concatenate(([0], np.cumsum(entries.sizes[ids])))[at].tolist()
            sides.append((entries, ids, np.diff(at), np.array([raw[x:y] == s for x, y, s in zip(ends, ends[1:], spaced)], bool)))
        good = sides[0][3] & sides[1][3]
        document = np.array(some, np.int64)[good]
        size = np.array([len(s) for s, g in zip(spaced, good) if g], np.int64)
        doc_ends = np.cumsum(size)
        self.counts, tokens = [], []
        for entries, ids, per_text, _ in sides:
            kept = ids[np.repeat(good, per_text)]
            tokens.append((kept, np.cumsum(entries.sizes[kept])))
            self.counts.append(np.zeros(n, np.int64))
            self.counts[-1][document] = per_text[good]
        (a, a_ends), (b, b_ends) = tokens
        total = int(doc_ends[-1]) if len(doc_ends) else 0
        a_mark, b_mark = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        a_mark[a_ends], b_mark[b_ends] = True, True
        a_last, b_last = b_mark[a_ends], a_mark[b_ends]
        self.a, self.b = a[a_last], b[b_last]  # one link per shared end
        self.of = document[np.searchsorted(doc_ends, a_ends[a_last])]
        self.n_groups = np.bincount(self.of, minlength=n).astype(np.int64)
        self.groups = self._written(pair, n, document, per_text_all=(sides[0][2][good], sides[1][2][good]), sides=((a, a_last), (b, b_last)))

    @staticmethod
    def _written(pair: TokenPair, n: int, document: np.ndarray, per_text_all, sides) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` per text: A tokens of a group, then its B tokens, all texts at once."""
        (a, a_last), (b, b_last) = sides
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_before, b_before = np.concatenate(([0], np.cumsum(np.bincount(a_group)))), np.concatenate(([0], np.cumsum(np.bincount(b_group))))
        ids, kind = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_before[b_group + 1]
        ids[at_a], ids[at_b] = a, b
        kind[at_a], kind[at_b] = a_last, 2 * b_last
        text = pair.decimals.joined(ids)
        ends = np.cumsum(pair.decimals.sizes[ids])
        text[ends - 1] = _SEPARATORS[kind]
        raw, out = text.tobytes(), [b""] * n
        places = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text_all[0] + per_text_all[1])))].tolist()
        for k, x, y in zip(document.tolist(), places, places[1:]):
            out[k] = raw[x : y - 1]
        return out


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: equal high bytes stand together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def spilled(chunks: Iterable[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A run: chunks of ascending keys and their values, each compressed by itself."""
    out = []
    for keys, values in chunks:
        for k in range(0, len(keys), CHUNK):
            some = keys[k : k + CHUNK]
            body = squeezed(_planes(np.diff(some, prepend=np.uint64(0))) + _planes(values[k : k + CHUNK]), 3)
            out += [struct.pack("<II", len(body), len(some)), body]
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(run):
        size, n = struct.unpack_from("<II", run, at)
        body = restored(run[at + 8 : at + 8 + size])
        yield np.cumsum(_numbers(body[: 8 * n]), dtype=np.uint64), _numbers(body[8 * n :])
        at += 8 + size


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k-way merge: distinct ascending keys with the sums of their values. The heap holds the last key of each run's
    chunk; up to the least of them all runs are known, and are added up at once."""
    readers = [read_run(r) for r in runs]
    held, heap = {}, []

    def refill(k: int) -> None:
        chunk = next(readers[k], None)
        if chunk is None:
            held.pop(k, None)
        else:
            held[k] = chunk
            heapq.heappush(heap, (int(chunk[0][-1]), k))

    for k in range(len(runs)):
        refill(k)
    while heap:
        bound, parts, done = heap[0][0], [], []
        while heap and heap[0][0] == bound:
            done.append(heapq.heappop(heap)[1])
        for k, (keys, values) in list(held.items()):
            n = int(np.searchsorted(keys, np.uint64(bound), "right"))
            parts.append((keys[:n], values[:n]))
            held[k] = (keys[n:], values[n:])
        keys, values = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield keys[first], np.add.reduceat(values, first)
        for k in done:
            refill(k)


def with_best(chunks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values twice as large, and one more where no pair of the same B token has a larger one. A B token's pairs stand
    together, so only the last token's wait for the next chunk."""
    none = np.zeros(0, np.uint64)
    held = (none, none)

    def marked(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token = keys >> np.uint64(24)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        top = np.repeat(np.maximum.reduceat(values, first), np.diff(np.r_[first, len(keys)]))
        return keys, values * np.uint64(2) + (values == top).astype(np.uint64)

    for chunk in chunks:
        keys, values = (np.concatenate(c) for c in zip(held, chunk))
        cut = int(np.searchsorted(keys >> np.uint64(24), keys[-1] >> np.uint64(24)))
        held = keys[cut:], values[cut:]
        if cut:
            yield marked(keys[:cut], values[:cut])
    if len(held[0]):
        yield marked(*held)


def pair_keys(a: np.ndarray, b: np.ndarray, radixes: int) -> np.ndarray:
    """Radix, B, A from the high bits down."""
    b = b.astype(np.uint64)
    return (mixed(b) % np.uint64(radixes)) << np.uint64(48) | b << np.uint64(24) | a.astype(np.uint64)


_BLOCK = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, runs array<struct<radix:int,run:binary>>, records binary"


def _blocks(a_path: str, b_path: str, pattern: str, radixes: int, digest: bool):
    def of_texts(pair: TokenPair, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        found = Aligned(pair, texts)
        pairs, which, times = np.unique(pair_keys(found.a, found.b, radixes), return_inverse=True, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(radixes + 1, dtype=np.uint64) << np.uint64(48))
        runs = [{"radix": r, "run": spilled([(pairs[x:y], times[x:y])])} for r, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        records, n = np.unique(found.of * max(1, len(pairs)) + which, return_counts=True)
        per_doc = np.bincount(records // max(1, len(pairs)), minlength=len(texts))
        place = np.diff(records % max(1, len(pairs)), prepend=0).astype(np.int64).view(np.uint64)
        packed = struct.pack("<II", len(texts), len(records)) + squeezed(_planes(per_doc) + _planes(place) + _planes(n), 3)
        groups = [(hashlib.sha256(g).hexdigest() if g else "") if digest else g.decode() for g in found.groups]
        columns = [pa.array([x], pa.list_(pa.int64())) for x in (ids.to_pylist(), *(c.tolist() for c in (*found.counts, found.n_groups)))]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), *columns, pa.array([groups], pa.list_(pa.string())), pa.array([runs], pa.list_(pa.struct([("radix", pa.int32()), ("run", pa.binary())]))), pa.array([packed], pa.binary())],
            ["block", "ids", "n_a", "n_b", "n_groups", "groups", "runs", "records"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenPair.of(a_path, b_path, pattern)
        for batch in batches:
            for first, end, _, _ in steps(batch.column(1), BLOCK_BYTES):
                yield of_texts(pair, batch.column(0).slice(first, end - first), text_list(batch.column(1).slice(first, end - first)))

    return run


_RUN = "radix int, node long, run binary"


def _merge(best: bool):
    def run(table: pa.Table) -> pa.Table:
        chunks = merged([r.as_py() for r in table["run"]])
        out = spilled(with_best(chunks) if best else chunks)
        return pa.table([table["radix"][:1], table["parent"][:1], pa.array([out], pa.binary())], names=["radix", "node", "run"])

    return run


def _send_back(children: pa.Table, parent: pa.Table) -> pa.Table:
    """To every child the parent's values at its own keys. Both are read chunk by chunk."""
    replies = []
    for run in children["run"]:
        above, have = read_run(parent["run"][0].as_py()), (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        out = []
        for keys, _ in read_run(run.as_py()):
            parts = [have]
            while not len(have[0]) or have[0][-1] < keys[-1]:
                have = next(above)
                parts.append(have)
            wide, values = (np.concatenate(c) for c in zip(*parts))
            out.append((keys, values[np.searchsorted(wide, keys)]))
        replies.append(spilled(out))
    return pa.table([children["radix"], children["node"], pa.array(replies, pa.binary())], names=["radix", "node", "run"])


def _summed(blocks: pa.Table, replies: pa.Table) -> pa.Table:
    """A block's documents with what the totals of their pairs add up to."""
    order = np.argsort(replies["radix"].to_numpy())
    values = [v for k in order for _, v in read_run(replies["run"][int(k)].as_py())]
    totals = np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)
    packed = blocks["records"][0].as_py()
    docs, n = struct.unpack_from("<II", packed)
    body = restored(packed[8:])
    per_doc, place, times = (_numbers(body[8 * x : 8 * y]).view(np.int64) for x, y in ((0, docs), (docs, docs + n), (docs + n, docs + 2 * n)))
    found = totals[np.cumsum(place)]
    first = np.concatenate(([0], np.cumsum(per_doc)))
    of = {c: pa.array(blocks[c][0].as_py(), pa.int64()) for c in ("ids", "n_a", "n_b", "n_groups")}
    sums = [pa.array(per_document(v, first), pa.int64()) for v in (times, (found & 1) * times, (found >> 1) * times)]
    return pa.table([*of.values(), *sums, pa.array(blocks["groups"][0].as_py(), pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def _written(df: DataFrame, name: str) -> DataFrame:
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(at)
    return df.sparkSession.read.parquet(at)


def count_pairs(runs: DataFrame, n_runs: int, fan: int = FAN) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """(levels, totals). ``runs``: radix, node, run. Each level of runs goes with the number of nodes above it; totals has one
    run per radix, whose values are 2 * count, plus 1 for a B token's highest."""
    levels, level, nodes = [], runs, n_runs
    while True:
        nodes = -(-nodes // fan)
        levels.append((level, nodes))
        above = level.withColumn("parent", F.pmod("node", F.lit(nodes))).groupBy("radix", "parent").applyInArrow(_merge(nodes <= 1), _RUN)
        level = _written(above, "pair-runs")
        if nodes <= 1:
            return levels, level


def pair_table(totals: DataFrame) -> DataFrame:
    """a_id, b_id, links, best: how many links of the corpus hold the two, and whether no other A token has more with b_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                for keys, values in read_run(blob.as_py()):
                    low = np.uint64((1 << 24) - 1)
                    columns = [(keys & low).astype(np.int64), (keys >> np.uint64(24) & low).astype(np.int64), (values >> np.uint64(1)).astype(np.int64), (values & np.uint64(1)).astype(bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a_id", "b_id", "links", "best"])

    return totals.select("run").mapInArrow(run, "a_id long, b_id long, links long, best boolean")


def blocks_of(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str, id_column: str, radixes: int, digest: bool) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, level-0 runs, number of blocks), written to the shared folder: texts are tokenized once."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = _written(rows.mapInArrow(_blocks(a_path, b_path, pattern, radixes, digest), _BLOCK), "pair-blocks")
    runs = blocks.select(F.col("block").alias("node"), F.explode("runs").alias("_r")).select("_r.radix", "node", "_r.run")
    return blocks, runs, blocks.count()


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", id_column: str = "doc_id", digest: bool = False, radixes: int = RADIXES, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (or groups_sha256): one row per document.

    A encodes a space and the text, B the text, to which it adds the space itself. ``groups`` has the ids of each group as
    ``a1,a2|b1;a3|b2,b3``. n_best counts the links whose pair no other A token beats at their B token, ties included, over
    all documents; count_sum adds up their pairs' counts. Null and empty texts, and texts of which one tokenizer's bytes are
    not a space and the text, have no tokens: zeros and an empty string. Strings of special tokens are ordinary text. Rows
    that repeat an id are documents of their own, and their links count; a null id stays null. An empty table gives no rows.
    Other columns are not read.
    """
    blocks, runs, n_blocks = blocks_of(docs, a_path, b_path, pattern, text, id_column, radixes, digest)
    levels, known = count_pairs(runs, n_blocks, fan)
    for level, nodes in reversed(levels):
        children = level.withColumn("parent", F.pmod("node", F.lit(nodes)))
        above = known.select(F.col("radix").alias("radix"), F.col("node").alias("parent"), "run")
        known = children.groupBy("radix", "parent").cogroup(above.groupBy("radix", "parent")).applyInArrow(_send_back, _RUN)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    replies = known.select("radix", F.col("node").alias("block"), "run")
    out = blocks.drop("runs").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_summed, schema)
    return out.withColumnRenamed("groups", "groups_sha256") if digest else out
