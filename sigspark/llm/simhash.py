"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints collapse first. Two fingerprints within the radius agree in all but ``radius`` of ``radius + 2``
parts, hence in some pair of parts; they are grouped by every pair. A pair of parts that more than ``HOT`` fingerprints
share is split the same way on the bits that are left, after which so few bits are free that a group is at most 65,536
fingerprints. Inside a group, fingerprints lie in blocks of 64, one machine word per bit plane; a row is compared with a
whole block by adding planes into carry-save counters, and a block is given up once all its counters exceed the radius.
A group hands on a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, join_hot
from .components import components, least_reached as roots

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
HOT = 4096
_ROWS_PER_STEP = 1 << 17
_PLANES_PER_LOOK = 8


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits: bit k is set if it is set in over half the XXH64 hashes of the word shingles, repeats included."""
    w = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words))))
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 32768):
        counts += np.unpackbits(hashes[k : k + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"", words) for t in batch.column("text")], np.uint64)
            yield batch.drop_columns("text").append_column("print", pa.array(prints.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = SHINGLE_WORDS, rest: Column | None = None) -> DataFrame:
    """doc_id, rest (a long, null unless given), print: the fingerprint's 64 bits as a long."""
    rest = F.lit(None).cast("long") if rest is None else rest
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), rest.alias("rest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, rest long, print long")


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``, from the highest counter plane down."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the links a-b that form a minimum spanning forest of the ``n`` rows, by Boruvka's rounds."""
    at = np.lexsort((b, a, weight))
    a, b = a[at], b[at]
    label, chosen = np.arange(n), []
    while True:
        apart = np.flatnonzero(label[a] != label[b])
        a, b, at = a[apart], b[apart], at[apart]
        if not len(at):
            return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(at))
        np.minimum.at(best, label[a], np.arange(len(at)))
        np.minimum.at(best, label[b], np.arange(len(at)))
        pick = np.unique(best[best < len(at)])
        chosen.append(at[pick])
        label = roots(n, label[a[pick]], label[b[pick]])[label]


def near(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS, distances: bool = False) -> tuple[np.ndarray, ...]:
    """Links (row a > row b) between rows of one group within ``radius`` bits, as a spanning forest. ``group`` is sorted;
    ``prints`` are rows of 64 bits, or of several such words. With ``distances`` the links are real pairs, the forest is a
    minimum one, and their distances come third."""
    n = len(prints)
    wide = prints if prints.ndim == 2 else prints[:, None]
    bits = 64 * wide.shape[1]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    blocks = (size + 63) // 64
    block_of_group = np.r_[0, np.cumsum(blocks)]
    of = np.repeat(np.arange(len(first)), size)
    lane = (np.arange(n) - first[of]) % 64
    own = block_of_group[of] + (np.arange(n) - first[of]) // 64
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else first  # a block's first row
    one = np.uint64(1)
    planes = [np.bitwise_or.reduceat((wide[:, k // 64] >> np.uint64(k % 64) & one) << lane.astype(np.uint64), begin) if n else np.zeros(0, np.uint64) for k in range(bits)]
    filled = np.diff(np.r_[begin, n])
    empty = np.where(filled == 64, np.uint64(0), ~np.uint64(0) << (filled % 64).astype(np.uint64))
    todo = block_of_group[of + 1] - own  # from its own block to its group's last
    ends = np.cumsum(todo)
    label_a, label_b = [], []
    held, held_d = 0, []
    row = 0
    # A step may find 64 pairs for each of its rows; with distances all of them are held for a moment.
    in_step = _ROWS_PER_STEP // 16 if distances else _ROWS_PER_STEP

    def kept(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        best = spanning(n, a, b, d)
        return a[best], b[best], d[best]

    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + in_step, "right")))
        rows = np.repeat(np.arange(row, stop), todo[row:stop])
        block = own[rows] + np.arange(len(rows)) - np.repeat(ends[row:stop] - todo[row:stop] - (ends[row - 1] if row else 0), todo[row:stop])
        dead = empty[block] | np.where(block == own[rows], (one << lane[rows].astype(np.uint64) << one) - one, np.uint64(0))
        counters = [np.zeros(len(rows), np.uint64) for _ in range(radius.bit_length())]
        for k in range(bits):
            add = planes[k][block] ^ (np.uint64(0) - (wide[rows, k // 64] >> np.uint64(k % 64) & one))
            for c in counters:
                carry = c & add
                c ^= add
                add = carry
            dead |= add  # a counter that ran over stays out
            if k % _PLANES_PER_LOOK == _PLANES_PER_LOOK - 1:
                alive = (~(dead | _over(counters, radius))) != 0
                if not alive.all():
                    rows, block, dead, counters = rows[alive], block[alive], dead[alive], [c[alive] for c in counters]
        hit = ~(dead | _over(counters, radius))
        if len(hit):
            at, lanes = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = begin[block[at]] + lanes, rows[at]
            if distances:
                d = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
                label_a, label_b, held_d = [*label_a, a], [*label_b, b], [*held_d, d]
                held += len(a)
                if held > 4 * n:
                    a, b, d = kept(*map(np.concatenate, (label_a, label_b, held_d)))
                    label_a, label_b, held_d, held = [a], [b], [d], 0
            else:
                root = roots(n, a, b) if len(a) > n else None
                label_a.append(np.flatnonzero(root != np.arange(n)) if root is not None else a)
                label_b.append(root[label_a[-1]] if root is not None else b)
        row = stop
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (label_a, label_b))
    if distances:
        return kept(a, b, np.concatenate(held_d) if held_d else np.zeros(0, np.int64))
    root = roots(n, a, b)
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = print_ = np.zeros((0,), np.int64)
        sub = np.zeros(0, np.int64)

        def links(upto: int) -> pa.RecordBatch:
            group = np.cumsum(np.r_[0, (key[1:upto] != key[: upto - 1]) | (sub[1:upto] != sub[: upto - 1])]) if upto else np.zeros(0, np.int64)
            size = np.bincount(group)
            several = size[group] > 1 if upto else np.zeros(0, bool)
            prints = print_[:upto][several].view(np.uint64)
            a, b = near(prints, group[several], radius)
            return pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], ["u", "v"])

        for batch in batches:
            key, sub, print_ = (np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, old in enumerate((key, sub, print_)))
            last = np.flatnonzero((key != key[-1]) | (sub != sub[-1])) if len(key) else key
            upto = int(last[-1]) + 1 if len(last) else 0
            if upto >= 16384:  # whole groups only; the last may go on
                yield links(upto)
                key, sub, print_ = key[upto:], sub[upto:], print_[upto:]
        yield links(len(key))

    return run


def _part(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): a spanning forest, group by group, of all pairs of distinct ``print`` values within ``radius`` bits."""
    parts = radius + 2
    edges = [64 * k // parts for k in range(parts + 1)]

    def pair_keys(value: Column, edges: list[int]) -> Column:
        widths = np.diff(edges).tolist()
        pairs = combinations(range(parts), 2)
        return F.array(*[F.lit(i) * F.lit(1 << 40) + F.shiftleft(_part(value, edges[a], widths[a]), widths[b]) + _part(value, edges[b], widths[b]) for i, (a, b) in enumerate(pairs)])

    distinct = prints.select("print").distinct()
    keyed = distinct.select("print", F.explode(pair_keys(F.col("print"), edges)).alias("key"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    keyed = join_hot(keyed, "key", shared, "k").select("key", "print", (F.col("n") > HOT).alias("hot"))
    cold = keyed.filter("NOT hot").select("key", F.lit(-1).cast("long").alias("sub"), "print")
    # The bits outside the pair, drawn together, are cut into parts again.
    rest = None
    for i, (a, b) in enumerate(combinations(range(parts), 2)):
        drawn, at = F.lit(0).cast("long"), 0
        for c in set(range(parts)) - {a, b}:
            drawn = drawn.bitwiseOR(F.shiftleft(_part(F.col("print"), edges[c], edges[c + 1] - edges[c]), at))
            at += edges[c + 1] - edges[c]
        cut = [at * k // parts for k in range(parts + 1)]
        sub = pair_keys(drawn, cut)
        here = F.shiftright("key", 40) == i
        rest = F.when(here, sub) if rest is None else rest.when(here, sub)
    split = keyed.filter("hot").select("key", F.explode(rest).alias("sub"), "print")
    grouped = cold.unionByName(split).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return grouped.mapInArrow(_compared(radius), "u long, v long")


def _first_of_component(prints: DataFrame, order: Column, found: DataFrame) -> DataFrame:
    """(p, first): for every print the least ``order`` in its component; nulls are passed over."""
    least = prints.groupBy("print").agg(F.min(order).alias("least"))
    tree = components(found)
    rooted = least.join(tree, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = cut_lineage(rooted)
    firsts = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("first"))
    return rooted.join(firsts, F.col("root") == F.col("r")).select(F.col("print").alias("p"), "first")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Texts with fewer words than a
    shingle are one shingle. component_id is the smallest id reachable over links; null ids are passed over, a component
    of null ids alone has a null one. Repeated rows share a fingerprint, hence a component. An empty table gives no rows.
    Other columns are not read. Texts of any length are hashed whole.
    """
    prints = cut_lineage(fingerprints(docs, text, id_column, words))
    joined = join_hot(prints, "print", _first_of_component(prints, F.col("doc_id"), links(prints, radius)), "p")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with the columns of ``docs``: that with the smallest id, null ids last.

    Rows of one id are told apart by a hash of all their columns (maps excepted), so of different rows that repeat an id,
    or have none, one stays as well. Rows alike in all columns are one document: they stay or go together.
    """
    prints = cut_lineage(fingerprints(docs, text, id_column, words, row_hash(docs)))
    return keep_first(docs, prints, links(prints, radius), id_column)


def row_hash(docs: DataFrame) -> Column:
    kinds = dict(docs.dtypes)
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if "map<" not in kinds[c]])


def keep_first(docs: DataFrame, prints: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """The first document of each component of ``prints`` (doc_id, rest, print) over the links ``found``."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("rest"))
    joined = join_hot(prints, "print", _first_of_component(prints, order, found), "p")
    gone = joined.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rest") == F.col("first.rest")))).select("doc_id", "rest").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).cast("long").alias("_id"), row_hash(docs).alias("_rest"))
    return rows.join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_rest") == F.col("rest")), "left_anti").select("_row.*")
