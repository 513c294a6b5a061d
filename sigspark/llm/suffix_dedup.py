"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

Windows of ``LENGTH`` bytes that are equal have the same minimizer, the least hash of their 64-byte substrings, so runs
of windows with one minimizer are the suffix buckets, and each is sorted by itself. Minimizers that one window run alone
has, and runs that are equal throughout, need no sorting: a table of minimizers by hash settles them. The text of the
others goes to its bucket. There, positions of a difference cover modulo ``PERIOD`` are ranked by prefix doubling;
suffixes that agree at the start are ordered by the ranks of two cover positions at the same distance from both. Neighbours that share ``LENGTH`` bytes are repeats. A minimizer of more than ``HOT`` runs, such
as one at the rim of a passage that very many documents quote, is split: its windows are looked up by their own hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import ANSWERED, ASKED, answers, asked, bucket_count, bucket_runs, into_blocks, joined_answers, opened, questions, restored, squeezed, unpacked
from .common import Rolling, per_document

LENGTH = 200
MINIMIZER = 64
HOT = 1024
_LONGEST_RUN = 1024
_SORT_BYTES = 1 << 19
#: Windows that are alone with their first so many bytes are no repeats and need no place in the order.
_PREFIX = 100
#: A perfect difference cover: every distance modulo PERIOD is a difference of two members. Fixed values.
PERIOD = 7
COVER = (1, 2, 4)
_MINIMIZERS, _TEXTS, _NAMES = 1, 2, 3
_PLACE_BITS = np.uint64(21)
_PIECE = (1 << 21) - 256
_ALONE, _SAME, _MIXED, _CROWDED = 0, 1, 2, 3

_SHIFT = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])


def _leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` successive hashes the least one's upper bits, and its place in the lower bits (leftmost of equal
    ones, modulo a piece). Pieces of a long text overlap, so a result depends on its own window only."""
    n = max(0, len(hashes) - width + 1)
    out = np.empty(n, np.uint64)
    for low in range(0, n, _PIECE):
        high = min(n, low + _PIECE)
        x = hashes[low : high + width - 1] >> _PLACE_BITS << _PLACE_BITS
        x |= np.arange(len(x), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        out[low:high] = np.minimum(x[: high - low], x[width - span : width - span + high - low])
    return out


class Runs:
    """The runs of windows of a block: first window, number of windows, minimizer, hash of the run's bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.hashes = Rolling.of_bytes(data)
        least = _leftmost_minima(self.hashes.windows(MINIMIZER), LENGTH - MINIMIZER + 1)
        room = np.maximum(np.diff(at) - LENGTH + 1, 0)
        windows = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(room.sum())
        least = least[windows] if len(windows) else np.zeros(0, np.uint64)
        keys = least >> _PLACE_BITS << _PLACE_BITS
        new = np.ones(len(windows), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (windows[1:] != windows[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(windows)))
        parts = -(-n // _LONGEST_RUN)
        if len(n) and parts.max() > 1:
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, left = np.repeat(begin, parts) + inner * _LONGEST_RUN, np.repeat(n, parts) - inner * _LONGEST_RUN
            n = np.minimum(left, _LONGEST_RUN)
        self.start = windows[begin] if len(begin) else begin
        self.n, self.key = n, keys[begin]
        moved = np.zeros(len(windows), bool)
        moved[1:] = least[1:] != least[:-1]
        moved[begin] = False
        #: The leftmost place of the minimizer moves inside the run; else no two windows of it are equal.
        self.repetitive = np.add.reduceat(moved, begin, dtype=np.int64) > 0 if len(begin) else moved
        self.hash = self.hashes.between(self.start, self.start + n + LENGTH - 1)
        self.keys, self.of_key = np.unique(self.key, return_inverse=True)

    def chosen(self, verdict: np.ndarray, what: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs with this verdict by (minimizer, hash): their numbers and counts; all runs with it, and which distinct one each is."""
        runs = np.flatnonzero(verdict[self.of_key] == what)
        order = runs[np.lexsort((self.hash[runs], self.key[runs]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.key[order[1:]] != self.key[order[:-1]]) | (self.hash[order[1:]] != self.hash[order[:-1]])
        which = np.cumsum(new) - 1
        return order[new], np.bincount(which, minlength=int(new.sum())), order, which


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then the same for start[1] and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _minimizers(batch: pa.RecordBatch, row: int):
    runs = Runs(*opened(batch, row))
    order = np.argsort(runs.of_key, kind="stable")
    first = np.searchsorted(runs.of_key[order], np.arange(len(runs.keys)))
    # A run that repeats itself counts as two different ones, which are sorted.
    itself = runs.repetitive.astype(np.uint64)
    low = np.minimum.reduceat((runs.hash & ~itself)[order], first) if len(order) else runs.hash
    high = np.maximum.reduceat((runs.hash | itself)[order], first) if len(order) else runs.hash
    times = np.minimum(np.bincount(runs.of_key, 1.0 + itself, len(runs.keys)), 65535).astype("<u2")

    def more(a: int, b: int) -> bytes:
        differ = high[a:b] != low[a:b]
        return b"".join((np.packbits(differ).tobytes(), times[a:b].tobytes(), low[a:b].astype("<u8").tobytes(), high[a:b][differ].astype("<u8").tobytes()))

    yield _MINIMIZERS, runs.keys, more


def _judged(hot: int):
    def run(table: pa.Table) -> pa.Table:
        keys, times, low, high = [], [], [], []
        for k, m in zip(table["keys"], table["more"]):
            new, more = unpacked(k.as_py()), m.as_py()
            n, at = len(new), (len(new) + 7) // 8
            differ = np.unpackbits(np.frombuffer(more, np.uint8, at))[:n].astype(bool)
            keys.append(new)
            times.append(np.frombuffer(more, "<u2", n, at))
            low.append(np.frombuffer(more, "<u8", n, at + 2 * n))
            high.append(low[-1].copy())
            high[-1][differ] = np.frombuffer(more, "<u8", offset=at + 10 * n)
        names, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate(times))
        least, most = np.full(len(names), ~np.uint64(0)), np.zeros(len(names), np.uint64)
        np.minimum.at(least, back, np.concatenate(low))
        np.maximum.at(most, back, np.concatenate(high))
        verdict = np.where(total == 1, _ALONE, np.where(least == most, _SAME, np.where(total > hot, _CROWDED, _MIXED))).astype(np.uint8)[back]
        ends = np.cumsum([len(k) for k in keys])
        return answers(table, [squeezed(verdict[e - len(k) : e].tobytes()) for k, e in zip(keys, ends)])

    return run


def _verdicts(replies: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(map(restored, joined_answers(replies, _MINIMIZERS))), np.uint8)


def _names(runs: Runs, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of these runs, their distinct hashes, and which one each window has."""
    windows = _ranges(runs.start[order], runs.n[order])
    keys, back = np.unique(runs.hashes.between(windows, windows + LENGTH), return_inverse=True)
    return windows, keys, back


def _open_cases(buckets: int):
    """Asks about runs whose minimizer others have too, but with other bytes around it."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        data, at = opened(blocks, 0)
        runs, verdict = Runs(data, at), _verdicts(replies)
        block = blocks["block"][0].as_py()
        out = []
        one, times, _, _ = runs.chosen(verdict, _MIXED)
        if len(one):
            # Several runs of a block may have one minimizer: keys repeat here, which the packing allows.
            def texts(a: int, b: int) -> bytes:
                some = one[a:b]
                body = data[_ranges(runs.start[some], runs.n[some] + LENGTH - 1)]
                return squeezed(b"".join((runs.n[some].astype("<u4").tobytes(), np.minimum(times[a:b], 2).astype(np.uint8).tobytes(), runs.hash[some].astype("<u8").tobytes(), body.tobytes())))

            out.append(asked(block, _TEXTS, runs.key[one], texts, buckets))
        _, _, order, _ = runs.chosen(verdict, _CROWDED)
        if len(order):
            _, keys, back = _names(runs, order)
            several = np.bincount(back) > 1
            out.append(asked(block, _NAMES, keys, lambda a, b: np.packbits(several[a:b]).tobytes(), buckets))
        if not out:
            out.append(asked(block, _NAMES, np.zeros(0, np.uint64), lambda a, b: b"", 1))
        return pa.Table.from_batches(out)

    return run


def cover_ranks(code: np.ndarray, word: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions, up to their text's end; 0 elsewhere. ``depth``: the longest text."""
    place = np.flatnonzero(np.isin(np.arange(len(code)) % PERIOD, COVER) & (code > 0))
    rank = np.zeros(len(code), np.int64)
    if not len(place):
        return rank
    rank[place] = np.unique(word[place] >> np.uint64(8), return_inverse=True)[1] + 1
    reach = PERIOD
    while reach < depth and rank.max() < len(place):
        later = place + reach
        inside = later < end[place]
        pair = (rank[place].astype(np.uint64) << np.uint64(32)) | np.where(inside, rank[np.minimum(later, len(code) - 1)], 0).astype(np.uint64)
        rank[place] = np.unique(pair, return_inverse=True)[1] + 1
        reach *= 2
    return rank


def repeated_windows(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of ``length`` bytes inside one of the texts: does it occur again? In the order of the texts."""
    lead = np.cumsum(sizes + PERIOD + 1) - (sizes + PERIOD + 1)
    code = np.zeros(int((sizes + PERIOD + 1).sum()) + length + 8, np.uint8)
    code[_ranges(lead, sizes)] = data + 1  # UTF-8 has no byte 255; 0 marks an end
    word = np.zeros(len(code), np.uint64)
    for k in range(8):
        word[: len(code) - k] |= code[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    end = np.zeros(len(code), np.int64)
    end[_ranges(lead, sizes)] = np.repeat(lead + sizes, sizes)
    windows = _ranges(lead, sizes - length + 1)
    out = np.zeros(len(windows), bool)
    prefix = Rolling.of_bytes(code).between(windows, windows + min(length, _PREFIX))
    _, group, times = np.unique(prefix, return_inverse=True, return_counts=True)
    order = np.flatnonzero(times[group] > 1)
    group = group[order]
    if not len(order):
        return out
    rank = cover_ranks(code, word, end, int(sizes.max()))
    # Windows of one residue are in order by the rank at one distance; two residues merge by the rank at a distance at
    # which both are cover positions. A window's place is its own place plus what other residues have before it.
    at = windows[order]
    residue = at % PERIOD
    base = group.astype(np.int64) << 32
    members, places = [], []
    for r in range(PERIOD):
        m = np.flatnonzero(residue == r)
        m = m[np.argsort(base[m] + rank[at[m] + _SHIFT[r, r]], kind="stable")]
        members.append(m)
        places.append(np.arange(len(m)))
    for r in range(PERIOD):
        for s in range(PERIOD):
            if r != s and len(members[r]) and len(members[s]):
                mine = base[members[r]] + rank[at[members[r]] + _SHIFT[r, s]]
                other = base[members[s]] + rank[at[members[s]] + _SHIFT[r, s]]
                places[r] = places[r] + np.searchsorted(other, mine, "left" if r < s else "right")
    line = np.empty(len(order), np.int64)
    for m, p in zip(members, places):
        line[p] = m
    same = group[line[1:]] == group[line[:-1]]
    a, b = at[line[:-1]][same], at[line[1:]][same]
    whole = np.flatnonzero(same)
    for k in [*range(0, length - 7, 8), length - 8]:
        equal = word[a + k] == word[b + k]
        a, b, whole = a[equal], b[equal], whole[equal]
    out[order[line[whole]]] = True
    out[order[line[whole + 1]]] = True
    return out


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """The runs of one bucket, a few minimizers at a time: which of their windows are repeats."""
    keys, n, times, hashes, bodies, sent = [], [], [], [], [], []
    for k, m in zip(table["keys"], table["more"]):
        new, more = unpacked(k.as_py()), restored(m.as_py())
        c = len(new)
        keys.append(new)
        n.append(np.frombuffer(more, "<u4", c).astype(np.int64))
        times.append(np.frombuffer(more, np.uint8, c, 4 * c))
        hashes.append(np.frombuffer(more, "<u8", c, 5 * c))
        bodies.append(np.frombuffer(more, np.uint8, offset=13 * c))
        sent.append(int(n[-1].sum()))
    key, n, times, hash_, data = (np.concatenate(x) for x in (keys, n, times, hashes, bodies))
    size = n + LENGTH - 1
    lead, first = np.cumsum(size) - size, np.cumsum(n) - n
    order = np.lexsort((hash_, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (hash_[order[1:]] != hash_[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]  # one of each group of equal runs, by minimizer
    several = np.bincount(which, times) > 1
    found = np.zeros(int(n[one].sum()), bool)
    begin = np.cumsum(n[one]) - n[one]
    total = np.cumsum(size[one])
    edge = np.flatnonzero(np.r_[True, key[one][1:] != key[one][:-1]])
    edge = np.append(edge, len(one))
    a = 0
    while a < len(one):
        limit = (total[a - 1] if a else 0) + _SORT_BYTES
        b = int(edge[max(np.searchsorted(edge, a, "right"), np.searchsorted(edge, np.searchsorted(total, limit, "right"), "right") - 1)])
        some = one[a:b]
        found[begin[a] : begin[a] + int(n[some].sum())] = repeated_windows(data[_ranges(lead[some], size[some])], size[some])
        a = b
    found |= np.repeat(several, n[one])
    flags = found[_ranges(begin[which], n)]
    ends = np.cumsum(sent)
    return answers(table, [squeezed(np.packbits(flags[e - c : e]).tobytes()) for c, e in zip(sent, ends)])


def _looked_up(table: pa.Table) -> pa.Table:
    keys = [unpacked(k.as_py()) for k in table["keys"]]
    own = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8))[: len(k)] for k, m in zip(keys, table["more"])]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    again = (np.bincount(back, 1.0 + np.concatenate(own)) > 1)[back]
    ends = np.cumsum([len(k) for k in keys])
    return answers(table, [squeezed(np.packbits(again[e - len(k) : e]).tobytes()) for k, e in zip(keys, ends)])


def _settled(key: tuple, table: pa.Table) -> pa.Table:
    return _sorted_bucket(table) if key[0].as_py() == _TEXTS else _looked_up(table)


def _flags(replies: pa.Table, kind: int, counts: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(restored(a), np.uint8))[:c] for a, c in zip(joined_answers(replies, kind), counts)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _removed(buckets: int, with_text: bool):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        data, at = opened(blocks, 0)
        runs, verdict = Runs(data, at), _verdicts(replies)
        change = np.zeros(len(data) + LENGTH + 1, np.int32)

        def repeats(windows: np.ndarray) -> None:
            np.add.at(change, windows, 1)
            np.add.at(change, windows + LENGTH, -1)

        same = np.flatnonzero(verdict[runs.of_key] == _SAME)
        np.add.at(change, runs.start[same], 1)
        np.add.at(change, runs.start[same] + runs.n[same] + LENGTH - 1, -1)
        one, _, order, which = runs.chosen(verdict, _MIXED)
        if len(one):
            lead = np.concatenate(([0], np.cumsum(runs.n[one])))
            flags = _flags(replies, _TEXTS, [int(lead[b] - lead[a]) for _, a, b in bucket_runs(runs.key[one], buckets)])
            repeats(_ranges(runs.start[order], runs.n[order])[flags[_ranges(lead[which], runs.n[order])]])
        _, _, order, _ = runs.chosen(verdict, _CROWDED)
        if len(order):
            windows, keys, back = _names(runs, order)
            repeats(windows[_flags(replies, _NAMES, [b - a for _, a, b in bucket_runs(keys, buckets)])[back]])
        gone = np.cumsum(change[: len(data)]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = at[:-1][at[:-1] < len(data)]
        begins[edge] = gone[edge]
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:])]
        columns = [pa.array(blocks["ids"][0].as_py(), pa.int64()), pa.array(np.diff(at)), pa.array(per_document(gone, at)), pa.array(per_document(begins, at)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.table([*columns, pa.array(kept if with_text else [None] * len(kept), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes (``kept``): one row per document.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another;
    overlapping occurrences count, and strings never cross documents. A null text is empty; a text shorter than LENGTH
    keeps all. Of rows with equal texts of LENGTH bytes or more nothing is left, whatever their ids; a null id stays null.
    An empty table gives no rows. Other columns are not read.
    """
    blocks = into_blocks(docs, text, id_column)
    buckets = bucket_count(4 * blocks.count())
    whole, body = blocks.select("block", "ids", "sizes", "data"), blocks.select("block", "sizes", "data")
    verdicts = body.mapInArrow(questions(_minimizers, buckets), ASKED).groupBy("kind", "bucket").applyInArrow(_judged(hot), ANSWERED)
    asks = body.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_open_cases(buckets), ASKED)
    # Little text can be much sorting, so buckets are not coalesced by size.
    settled = asks.repartition(2 * buckets, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_settled, ANSWERED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return whole.groupBy("block").cogroup(verdicts.unionByName(settled).groupBy("block")).applyInArrow(_removed(buckets, with_text), schema)
