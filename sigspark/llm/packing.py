"""Lexical retrieval packing: documents that share rare words fill a training window together.

Documents are routed by content: a weighted minhash of the BM25 weights of all terms of the whole document gives a few
terms that documents share the likelier the more they have in common, and documents are sorted by them over the cluster.
Runs of that order are the shards. Inside a shard an inverted index holds BM25 weights of whole documents, with document
frequencies and the mean length taken over the whole corpus. The first unused document seeds a window, all its terms are
looked up, and the best unused neighbours are appended, the last one cut to fit; what is left of it stays unused. Token
ids are the terms, so the statistics are bounded by the vocabulary.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import mixed, shared_dir, steps, trimmed

WINDOW = 2048
END_ID = 1
DOCS_PER_SHARD = 2048
#: Shards that one task packs, one after the other, and the terms that route a document.
_SHARDS_PER_TASK = 8
_ROUTE_TERMS = 4
K1, B = 1.2, 0.75
#: Words and pieces that a worker keeps: fewer, and words that a corpus repeats now and then are merged again each time.
_CACHED, _CACHED_PIECES = 700_000, 300_000
#: Bytes of text whose words are looked up together, each distinct one once. Larger steps take memory and no less time.
_STEP = 1 << 20

#: Bytes of lower-cased UTF-8: 1 is white space, 2 is what only the tokenizer splits (beyond Latin-1, or separators that ``\\s`` lacks).
_SORT = np.zeros(256, np.uint8)
_SORT[[0x20, *range(0x09, 0x0E)]] = 1
_SORT[[*range(0x1C, 0x20), *range(0xC4, 0x100)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Cache:
    """Made on first use; beyond its size, every time.

    Words and what is made of them stand in flat arrays behind an open hash table, some 55 bytes a word: as objects in a
    dictionary they took some 136. Of two words with one hash only the first is kept.
    """

    def __init__(self, make, most: int):
        self.make, self.most, self.n = make, most, 0
        self.slots = memoryview(np.zeros(1 << (2 * most).bit_length(), np.uint32))  # entries from 1, 0 where free
        self.hashes = memoryview(np.empty(most, np.int64))
        self.key_ends, self.value_ends = (memoryview(np.zeros(most + 1, np.int64)) for _ in range(2))
        self.keys, self.values = bytearray(), bytearray()

    def __len__(self) -> int:
        return self.n

    def _slot(self, hashed: int) -> int:
        """Where a hash stands, or the free slot for it."""
        last = len(self.slots) - 1
        at = hashed & last
        while (entry := self.slots[at]) and self.hashes[entry - 1] != hashed:
            at = (at + 1) & last
        return at

    def _at(self, slot: int, key: str) -> bytes | None:
        entry = self.slots[slot] - 1
        if entry < 0 or self.keys[self.key_ends[entry] : self.key_ends[entry + 1]] != key.encode():
            return None
        return bytes(self.values[self.value_ends[entry] : self.value_ends[entry + 1]])

    def get(self, key: str) -> bytes | None:
        return self._at(self._slot(hash(key)), key)

    def __getitem__(self, key: str) -> bytes:
        slot = self._slot(hash(key))
        found = self._at(slot, key)
        if found is None:
            found = self.make(key)
            if self.n < self.most and not self.slots[slot]:
                self.keys += key.encode()
                self.values += found
                self.hashes[self.n] = hash(key)
                self.n += 1
                self.slots[slot], self.key_ends[self.n], self.value_ends[self.n] = self.n, len(self.keys), len(self.values)
        return found

    def many(self, keys: pa.Array) -> pa.Array:
        """What is made of each of many different words."""
        asked = keys.to_numpy(zero_copy_only=False).tolist()
        entries = self._entries(keys, np.fromiter(map(hash, asked), np.int64, len(asked)))
        kept, missing = np.flatnonzero(entries >= 0), np.flatnonzero(entries < 0)
        place = np.empty(len(asked), np.int64)
        place[np.concatenate((kept, missing))] = np.arange(len(asked))
        found = self._stored(self.values, self.value_ends, pa.large_binary(), entries[kept])
        return pa.concat_arrays([found, pa.array([self[asked[k]] for k in missing.tolist()], pa.large_binary())]).take(pa.array(place))

    def _entries(self, keys: pa.Array, hashed: np.ndarray) -> np.ndarray:
        slots, hashes = np.asarray(self.slots), np.asarray(self.hashes)
        out, left, at = np.full(len(hashed), -1), np.arange(len(hashed)), hashed & (len(slots) - 1)
        while len(left):
            entry = slots[at].astype(np.int64) - 1
            left, at, entry = (x[entry >= 0] for x in (left, at, entry))
            same = hashes[entry] == hashed[left]
            out[left[same]] = entry[same]
            left, at = left[~same], (at[~same] + 1) & (len(slots) - 1)
        hit = np.flatnonzero(out >= 0)
        equal = pc.equal(keys.take(pa.array(hit)), self._stored(self.keys, self.key_ends, keys.type, out[hit]))
        out[hit[~equal.to_numpy(zero_copy_only=False).astype(bool)]] = -1
        return out

    def _stored(self, data: bytearray, ends: memoryview, kind: pa.DataType, entries: np.ndarray) -> pa.Array:
        # A copy: while an array of it lives, a bytearray can't grow.
        return pa.Array.from_buffers(kind, self.n, [None, pa.py_buffer(ends), pa.py_buffer(data)]).take(pa.array(entries))


class _Words:
    """Token ids of whole texts as bytes, from caches of lower-cased words and of their pieces.

    For a tokenizer that lower-cases, drops white space and never joins across it, a text in Latin-1 is the sequence of
    its words; any other text goes to the tokenizer as it is, and so does one that holds an added token.
    """

    #: The tokenizer's own split, which it applies to lower-cased words.
    _PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _made: dict[str, _Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        table = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.byte_text = [table[b] for b in range(256)]
        self.code = "H" if self.kind is np.uint16 else "I"
        self.words, self.pieces = _Cache(self._word, _CACHED), _Cache(self._piece, _CACHED_PIECES)
        self.model = self.tokenizer.model
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = self._splits_words()

    @classmethod
    def of(cls, path: str) -> _Words:
        if path not in cls._made:
            trimmed()
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def forget(cls) -> None:
        if cls._made:
            cls._made.clear()
            gc.collect()  # words and caches know each other
            trimmed()

    def _splits_words(self) -> bool:
        return all(b"".join(map(self._word, t.lower().split())) == self._plain(t) for t in ("It's A tést-1234,  of\tWords. Öß®²µ's", "I'LL can't 3,5%%% (x)"))

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalpha() else "".join([self.byte_text[b] for b in piece.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, lower: str) -> bytes:
        # Letters are one piece, and so are punctuation marks after them: no contraction ends in a mark.
        if lower.isalpha():
            return self.pieces.get(lower) or self.pieces.make(lower)  # kept as a word, not as a piece too
        letters = lower.rstrip(_MARKS)
        if letters.isalpha():
            return self._letters(letters) + self.pieces[lower[len(letters) :]]
        return b"".join([self.pieces[p] for p in self._PIECES.findall(lower)])

    def _letters(self, piece: str) -> bytes:
        # Kept with their words already; only words with marks would ask again.
        found = self.words.get(piece)
        return self.pieces[piece] if found is None else found

    def ids(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.together(data, np.array([0, len(data)]))[0]

    def together(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between successive entries of ``at``, one after the other, each with the end id, and where each
        ends. Equal words are looked up once."""
        lower, space, plain = self._sorted_out(data, at)
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        edges = at[(at > 0) & (at < len(data))]  # texts that touch
        begins[edges] = ~space[edges]
        ends[edges - 1] = ~space[edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        sizes = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends + 1 - starts, out=sizes[1:])
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(lower[~space])]).dictionary_encode()
        found = self.words.many(coded.dictionary)
        end_id, n = self.kind(END_ID).tobytes(), len(at) - 1
        # Behind the words of each text stands the end id, or all ids of a text that the tokenizer splits.
        behind = np.full(n, len(found))
        behind[plain] += 1 + np.arange(len(plain))
        more = pa.array([end_id, *(self._plain(data[at[d] : at[d + 1]].tobytes().decode()) + end_id for d in plain.tolist())], pa.large_binary())
        place = np.searchsorted(starts, at[1:])
        codes = np.insert(coded.indices.to_numpy(), place, behind)
        _, offsets, joined = pa.concat_arrays([found, more]).take(pa.array(codes)).buffers()
        width = np.dtype(self.kind).itemsize
        last = np.frombuffer(offsets, np.int64)[place + np.arange(1, n + 1)] // width
        return np.frombuffer(joined, self.kind, int(last[-1]) if n else 0), last

    def _sorted_out(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, which of them are no part of a word, and the texts to leave to the tokenizer."""
        if not self.by_word:
            return data, np.ones(len(data), bool), np.arange(len(at) - 1)
        lower = _LOWER[data]
        after = np.flatnonzero(lower == 0xC3) + 1  # U+00C0 to U+00FF: capitals but the multiplication sign come first
        second = lower[after]
        lower[after[(second <= 0x9E) & (second != 0x97)]] += 32
        sort = _SORT[lower]
        space = sort == 1
        wide = np.flatnonzero(lower == 0xC2)
        wide = wide[(lower[wide + 1] == 0x85) | (lower[wide + 1] == 0xA0)]
        space[wide] = space[wide + 1] = True
        odd, whole = [np.flatnonzero(sort == 2)], lower.tobytes()
        for token in self.added:
            k = whole.find(token)
            while k >= 0:
                odd.append(np.array([k]))
                k = whole.find(token, k + 1)
        plain = np.unique(np.searchsorted(at, np.concatenate(odd), "right") - 1)
        for d in plain.tolist():
            space[at[d] : at[d + 1]] = True
        return lower, space, plain


_TOKENS = "doc_id long, n long, crcs array<long>, rest binary, width int, terms binary, times binary"


def _counted(ids: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The distinct ids of each of the texts that end at ``ends``, and how often each occurs: in a byte, or four where one does
    not do."""
    wide = ids.dtype.itemsize > 2 or len(ends) > 1 << 16
    kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    starts = np.concatenate(([0], ends[:-1]))
    keys = np.repeat(np.arange(len(ends), dtype=kind) << kind(shift), ends - starts)
    keys |= ids
    keys.sort()
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    kinds, counts = keys[first].astype(ids.dtype).astype(ids.dtype.newbyteorder("<"), copy=False), np.diff(first, append=len(keys))
    small = counts.astype(np.uint8)
    at = np.searchsorted(first, np.append(starts, len(keys)))
    many = np.maximum.reduceat(counts, at[:-1]) > 255
    spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return [kinds[low:high].tobytes() for low, high in spans], [(counts[low:high].astype("<u4") if m else small[low:high]).tobytes() for (low, high), m in zip(spans, many.tolist())]


def _tokenized(path: str, window: int):
    """A row per document: the checksums of its whole windows, the ids after them, and the distinct terms of all of it with
    how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words.of(path)
        width = np.dtype(words.kind).itemsize
        for batch in batches:
            for first, end, data, at in steps(batch.column(1), _STEP):
                ids, ends = words.together(data, at)
                terms, times = _counted(ids, ends)
                starts = np.concatenate(([0], ends[:-1]))
                n, whole = ends - starts, ends - (ends - starts) % window
                crcs = [[zlib.crc32(ids[k : k + window].astype("<u4").tobytes()) for k in range(low, high, window)] for low, high in zip(starts.tolist(), whole.tolist())]
                rests = [ids[low:high].astype(f"<u{width}").tobytes() for low, high in zip(whole.tolist(), ends.tolist())]
                columns = [batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary()), pa.array([width] * len(n), pa.int32()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "crcs", "rest", "width", "terms", "times"])

    return run


def _later(run, keep_words: bool):
    """A step after tokenizing. Workers live on from stage to stage: unless they keep their words, they free them here."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _Words.forget()
        yield from run(batches)

    return run if keep_words else freed


def _profiles(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each document's distinct terms and how often each occurs."""
    for width, terms, times in zip(*(table[c].to_pylist() for c in ("width", "terms", "times"))):
        kinds = np.frombuffer(terms, f"<u{width}")
        yield kinds, np.frombuffer(times, np.uint8 if len(times) == len(kinds) else "<u4").astype(np.int64)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        terms = np.concatenate([t for t, _ in _profiles(batch)]) if batch.num_rows else np.zeros(0, np.int64)
        found = np.bincount(terms)
        if len(found) > len(total):
            total = np.append(total, np.zeros(len(found) - len(total), np.int64))
        total[: len(found)] += found
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(total[terms])], ["term", "df"])


def bm25(terms: np.ndarray, times: np.ndarray, idf: np.ndarray, mean: float, length: np.ndarray | None = None) -> np.ndarray:
    """The weight of each term of one document, or of documents of the lengths given at each term."""
    return idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * (times.sum() if length is None else length) / mean))


def _weights(profiles: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents together: the number of terms of each, the terms, and their weights."""
    sizes = np.array([len(t) for t, _ in profiles])
    terms, times = (np.concatenate([p[k] for p in profiles]) for k in (0, 1))
    length = np.diff(np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(sizes)))])
    return sizes, terms, bm25(terms, times, idf, mean, np.repeat(length, sizes))


def _turns(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What terms are ordered by for a weighted minhash."""
    u = (mixed(terms.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float) / 2**53
    return -np.log(u + 2.0**-54) / np.maximum(weights, 1e-9)


def route(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The first terms in the order of a weighted minhash: two documents agree on the first with a chance that is the
    common part of their weights."""
    order = _turns(terms, weights).argsort(kind="stable")[:_ROUTE_TERMS]
    return np.pad(terms[order].astype(np.int64), (0, _ROUTE_TERMS - len(order)), constant_values=-1)


def routes(profiles: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float) -> np.ndarray:
    """A row per document: its ``route``."""
    out = np.full((len(profiles), _ROUTE_TERMS), -1, np.int64)
    sizes, terms, weights = _weights(profiles, idf, mean)
    ends, keys = np.cumsum(sizes), _turns(terms, weights)
    for d, (low, high) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        first = terms[low:high][keys[low:high].argsort(kind="stable")[:_ROUTE_TERMS]]
        out[d, : len(first)] = first
    return out


def _routed(statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = statistics.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                out = batch.slice(first, 1024)
                for k, column in enumerate(routes(list(_profiles(out)), idf, mean).T):
                    out = out.append_column(f"r{k}", pa.array(np.ascontiguousarray(column), pa.int32()))
                yield out

    return run


class _Index:
    """BM25 weights of one shard: postings of the rarer terms, and a matrix for those that very many documents have."""

    def __init__(self, profiles: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        self.n = len(profiles)
        sizes, terms, weight = _weights(profiles, idf, mean)
        terms, weight = terms.astype(np.int64), weight.astype(np.float32)
        doc = np.repeat(np.arange(self.n), sizes)
        often = np.bincount(terms, minlength=len(idf))
        column = np.full(len(idf), -1)
        full = np.flatnonzero(often > max(8, self.n // 32))
        column[full] = np.arange(len(full))
        in_matrix = column[terms] >= 0
        self.matrix = np.zeros((self.n, len(full)), np.float32)
        self.matrix[doc[in_matrix], column[terms[in_matrix]]] = weight[in_matrix]
        self.in_query = self.matrix > 0
        terms, weight, doc = terms[~in_matrix], weight[~in_matrix], doc[~in_matrix]
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        self.terms = terms
        order = np.argsort(terms, kind="stable")
        self.doc, self.value = doc[order], weight[order]
        self.posting = np.searchsorted(terms[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        begin, size = self.posting[terms], self.posting[terms + 1] - self.posting[terms]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.value[at], self.n) + self.matrix @ self.in_query[seed].astype(np.float32)


def fill(rests: list[np.ndarray], profiles: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) over the rests; all but the last ones are exactly full. ``profiles``: the terms
    of the whole documents.

    What would be one short window at the end is cut into windows whose lengths are powers of two, which need no padding.
    """
    index = _Index(profiles, idf, mean)
    left = np.array([len(r) for r in rests])
    start = np.zeros(len(rests), np.int64)
    made: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, seed = window, 0

    def take(d: int) -> None:
        nonlocal now, room
        n = min(int(left[d]), room)
        now.append((d, int(start[d]), n))
        left[d] -= n
        start[d] += n
        room -= n
        if not room:
            made.append(now)
            now, room = [], window

    while seed < len(rests):
        if not left[seed]:
            seed += 1
            continue
        take(seed)
        if not now:
            continue
        scores = index.scores(seed)
        scores[left == 0] = 0
        while now:
            best = int(scores.argmax())
            if scores[best] <= 0:  # nothing alike is left: the next document goes on
                break
            scores[best] = 0
            take(best)
    rest, size = now, 1 << (window - 1).bit_length()
    total = sum(n for _, _, n in rest)
    while total:
        while size > total:
            size //= 2
        now, total, need = [], total - size, size
        while need:
            d, s, n = rest[0]
            used = min(n, need)
            now.append((d, s, used))
            need -= used
            rest = rest[1:] if used == n else [(d, s + used, n - used), *rest[1:]]
        made.append(now)
    return made


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _packed(statistics, window: int, with_ids: bool, per_shard: int):
    """Packs successive runs of ``per_shard`` rows of a partition, each as a shard."""

    def shard(table: pa.Table, sequence: int) -> tuple[pa.RecordBatch, int]:
        idf, mean = statistics.value
        ids_of, n, crcs = (table[c].to_pylist() for c in ("doc_id", "n", "crcs"))
        rests = [np.frombuffer(r, f"<u{w}") for r, w in zip(table["rest"].to_pylist(), table["width"].to_pylist())]
        rows = []
        for i in range(len(n)):
            for k, crc in enumerate(crcs[i]):
                rows.append((ids_of[i], k * window, window, crc, n[i], sequence, 0, None))
                sequence += 1
        some = [i for i in range(len(n)) if len(rests[i])]
        profiles = list(_profiles(table)) if some else []
        for pieces in fill([rests[i] for i in some], [profiles[i] for i in some], idf, mean, window) if some else []:
            offset = 0
            for d, s, length in pieces:
                i = some[d]
                ids = rests[i][s : s + length].astype("<u4")
                rows.append((ids_of[i], len(crcs[i]) * window + s, length, zlib.crc32(ids.tobytes()), n[i], sequence, offset, ids if with_ids else None))
                offset += length
            sequence += 1
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]), sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= per_shard:
                table = pa.Table.from_batches(held)
                out, sequence = shard(table.slice(0, per_shard), sequence)
                yield out
                held = table.slice(per_shard).to_batches()
        if sum(b.num_rows for b in held):
            yield shard(pa.Table.from_batches(held), sequence)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, with_ids: bool = False, per_shard: int = DOCS_PER_SHARD, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids of packed pieces).

    A null or empty text is the end token alone, so every document has a piece. Documents of a window or more give whole
    windows first and their rest to the packing. Rows that repeat an id are documents of their own; a null id stays null.
    Documents alike in content stand next to each other and fill as many shards as they need. Of equally good neighbours
    the one earlier in the shard is taken. An empty table gives no rows. Other columns are not read. ``tokenizer`` is a
    tokenizer file that executors have too. ``keep_words``: workers keep the words they met, for a query that packs again;
    without it they free them in the steps after tokenizing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    at = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    rows.mapInArrow(_tokenized(tokenizer, window), _TOKENS).write.option("compression", "zstd").parquet(at)
    tokens = spark.read.parquet(at)
    n_docs, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    frequencies = tokens.select("width", "terms", "times").mapInArrow(_later(_document_frequencies, keep_words), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # at most a row per vocabulary entry
    idf = np.zeros(int(frequencies["term"].max()) + 1 if len(frequencies) else 1)
    df = frequencies["df"].to_numpy(float)
    idf[frequencies["term"].to_numpy(int)] = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    statistics = spark.sparkContext.broadcast((idf, max(mean or 1.0, 1.0)))
    order = [f"r{k}" for k in range(_ROUTE_TERMS)]
    routed = tokens.mapInArrow(_later(_routed(statistics), keep_words), ", ".join([_TOKENS, *(f"{r} int" for r in order)])).withColumn("last", F.xxhash64("doc_id", "n", F.crc32("rest")))
    # Written, so that finding the borders of the ranges reads the keys alone.
    routed.write.option("compression", "zstd").parquet(f"{at}-routed")
    routed = spark.read.parquet(f"{at}-routed")
    parts = max(1, -(-n_docs // (per_shard * _SHARDS_PER_TASK)))
    dealt = routed.repartitionByRange(parts, *order, "last").sortWithinPartitions(*order, "last", "doc_id").drop(*order, "last")
    packed = dealt.mapInArrow(_later(_packed(statistics, window, with_ids, per_shard), keep_words), _PIECE)
    return packed if with_ids else packed.drop("ids")
