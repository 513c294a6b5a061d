"""Stupid-backoff language-model scores, computed relationally.

Exploded n-grams are put, block by block, to count tables that are partitioned by hash; the counts come back to the
block and are summed per document. The counts cover every document. A document is scored against all others: what its
own text adds to a count is taken off again, for else every n-gram of the corpus would be known.

N-grams are asked about one length after the other: an n-gram that another document has was seen there with both its
shorter parts, so only those are asked about whose parts others have. Blocks are written once, bucketed; only keys and
counts are shuffled, and the answers to one length once, however many lengths follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import ANSWERED, ASKED, answers, asked, bucket_count, bucket_runs, into_blocks, joined_answers, opened, questions, restored, squeezed, unpacked
from .common import Rolling, mixed, per_document, word_bounds

ORDER = 3
BACKOFF = 0.4
#: Larger blocks ask about fewer keys: a key is asked about once per block.
BLOCK_BYTES = 6_000_000
#: Spark's own limit of a table's buckets.
_MOST_PARTS = 100_000


def _grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n = 1 to ``order``, (index of the last word, hash) of each n-gram; and where each document's words begin."""
    starts, ends, first = word_bounds(data, at)
    words = Rolling.of_bytes(data).between(starts, ends)
    rolling = Rolling(words)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out = [(np.arange(len(words)), words)]
    for n in range(2, order + 1):
        last = np.flatnonzero(place >= n - 1)
        out.append((last, rolling.windows(n)[last - n + 1] if len(last) else np.zeros(0, np.uint64)))
    return out, first


def _times(counts: np.ndarray) -> bytes:
    """A bit for each key, whether it occurs more than once, and the counts of those that do."""
    more = counts > 1
    return np.packbits(more).tobytes() + squeezed(counts[more].astype("<u4").tobytes())


def _untimed(data: bytes, n: int) -> np.ndarray:
    counts = np.ones(n, np.int64)
    more = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8))[:n].astype(bool)
    counts[more] = np.frombuffer(restored(data[(n + 7) // 8 :]), "<u4")
    return counts


def _asked(batch: pa.RecordBatch, row: int):
    keys, counts = np.unique(_grams(*opened(batch, row), 1)[0][0][1], return_counts=True)
    yield 1, keys, lambda a, b: _times(counts[a:b])


def _counted(table: pa.Table) -> pa.Table:
    """One bucket of a count table. An answer has a bit for each key, whether other blocks have it too, and the totals of
    those."""
    keys = [unpacked(k.as_py()) for k in table["keys"]]
    own = [_untimed(m.as_py(), len(k)) for k, m in zip(keys, table["more"])]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(own))[back].astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    replies = []
    for k, o, e in zip(keys, own, ends):
        mine = total[e - len(k) : e]
        more = mine > o
        wide = "<u4" if not more.any() or mine.max() < 1 << 32 else "<u8"
        replies.append((b"4" if wide == "<u4" else b"8") + np.packbits(more).tobytes() + squeezed(mine[more].astype(wide).tobytes()))
    return answers(table, replies)


class _Known:
    """A block's n-grams and what the replies say of them: ``elsewhere[n]``, the count of the n-gram that ends at each word
    in all other documents, up to the length ``answered``; level 0 holds the words of all other documents."""

    def __init__(self, blocks: pa.Table, replies: pa.Table, corpus_words: int, order: int, buckets: int, answered: int):
        grams, self.first = _grams(*opened(blocks, 0), order)
        self.n = np.diff(self.first)
        self.document = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.document)) - np.repeat(self.first[:-1], self.n)
        self.salt = mixed(self.document.astype(np.uint64) + np.uint64(1))
        self.elsewhere = [np.repeat(corpus_words - self.n, self.n).astype(float)]
        self.buckets = buckets
        for k, (last, hashes) in enumerate(grams[:answered], 1):
            if k > 1:
                last, hashes = self.possible(k, last, hashes)
            keys, back, own = np.unique(hashes, return_inverse=True, return_counts=True)
            totals = own.astype(np.int64)
            for (_, a, b), part in zip(bucket_runs(keys, buckets), joined_answers(replies, k), strict=True):
                bits = 1 + (b - a + 7) // 8
                more = np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8, bits - 1, 1))[: b - a])
                totals[a + more] = np.frombuffer(restored(part[bits:]), f"<u{chr(part[0])}")
            _, mine, times = np.unique(mixed(hashes ^ self.salt[last]), return_inverse=True, return_counts=True)
            counts = np.zeros(len(self.document))
            if len(hashes):
                counts[last] = totals[back] - times[mine]
            self.elsewhere.append(counts)
        self.left = grams[answered] if answered < order else None

    def possible(self, k: int, last: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those n-grams of length k of which other documents have both parts, words 1 to k - 1 and 2 to k."""
        shorter = self.elsewhere[k - 1] > 0
        both = shorter[last] & shorter[last - 1]
        return last[both], hashes[both]


def _asked_next(order: int, corpus_words: int, buckets: int):
    """Asks about the n-grams of length ``order`` of which other documents have both parts."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        known = _Known(blocks, replies, corpus_words, order, buckets, order - 1)
        keys, counts = np.unique(known.possible(order, *known.left)[1], return_counts=True)
        return pa.Table.from_batches([asked(blocks["block"][0].as_py(), order, keys, lambda a, b: _times(counts[a:b]), buckets)])

    return run


def _scored(order: int, corpus_words: int, buckets: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        known = _Known(blocks, replies, corpus_words, order, buckets, order)
        n, first, document, elsewhere = known.n, known.first, known.document, known.elsewhere
        log = -np.log10(np.maximum(elsewhere[0], 0) + 1)  # an unseen word: one in all other words and one
        level = np.zeros(len(document), np.int64)
        for k in range(1, len(elsewhere)):
            context = elsewhere[0] if k == 1 else np.r_[0.0, elsewhere[k - 1][:-1]]
            found = elsewhere[k] > 0
            log[found] = np.log10(elsewhere[k][found] / context[found])
            level[found] = k
        possible = np.minimum(known.place + 1, order)
        log += np.log10(BACKOFF) * (possible - np.maximum(level, 1))
        total = np.bincount(document, log, len(n)).astype(float)
        return pa.table(
            [pa.array(blocks["ids"][0].as_py(), pa.int64()), pa.array(n.astype(np.int64)), pa.array(per_document(level < possible, first)), pa.array(total), pa.array(total / np.maximum(n, 1))],
            names=["doc_id", "n_words", "n_backed_off", "log10_score", "mean_log10"],
        )

    return run


def score(docs: DataFrame, text: str = "text", id_column: str = "doc_id", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_backed_off, log10_score, mean_log10: one row per document.

    S(w | context) is count(context w) / count(context) over all other documents where that is known, else BACKOFF times
    the score with a context shorter by a word; a word that no other document has counts as one occurrence. A null or
    empty text has no words and scores 0. Rows that repeat an id are documents of their own; a null id stays null. An
    empty table gives no rows. Other columns are not read. Whole texts are scored, whatever their length.
    """
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), _MOST_PARTS)
    blocks = into_blocks(docs, text, id_column, BLOCK_BYTES, parts)
    n_blocks, words = blocks.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    buckets = bucket_count(n_blocks)
    whole, body = blocks.select("block", "ids", "sizes", "data"), blocks.select("block", "sizes", "data")
    replies = body.mapInArrow(questions(_asked, buckets), ASKED).groupBy("kind", "bucket").applyInArrow(_counted, ANSWERED).repartition(parts, "block")
    for n in range(2, order + 1):
        more = whole.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_asked_next(n, words, buckets), ASKED)
        replies = replies.unionByName(more.groupBy("kind", "bucket").applyInArrow(_counted, ANSWERED).repartition(parts, "block"))
    schema = "doc_id long, n_words long, n_backed_off long, log10_score double, mean_log10 double"
    return whole.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scored(order, words, buckets), schema)
