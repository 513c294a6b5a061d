"""Near-duplicates of a stated similarity by wide SimHash fingerprints: Jaccard of five-word shingle sets, 0.8 or more.

A fingerprint has ``BITS`` bits, each the majority over the distinct shingles. Two sets of Jaccard similarity s have the
cosine 2s / (1 + s), so a bit differs with chance p = arccos(2s / (1 + s)) / pi, 0.15 at 0.8. Candidates share some
sampled bits: as many as leave ``GROUP`` documents a group at random, in so many tables that a pair of similarity 0.8 is
missed by all with chance ``MISSED``. Inside a group the bit-sliced comparison finds the pairs within ``radius`` bits and
hands on a minimum spanning forest of them, the closest pairs first, never all pairs. Candidates are checked on the whole
shingle sets, and inside a family of candidates no pair stays unchecked whose documents are not joined already. Groups and
families above a size are cut into chunks by hash and every pair of chunks is compared, so no pair is left out and no
task holds more than two chunks; the work then grows with the square of that group.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, cut_lineage, gathered, join_hot, mixed, shared_dir, steps, trimmed, word_bounds
from .components import components
from .simhash import keep_first, near, roots, row_hash

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BITS = 128
#: Random documents a group, and the most that one task compares as a group.
GROUP, HOT = 256, 4096
#: Shingles of a family that one task compares with as many others.
CHUNK = 1 << 20
#: Chance that a pair of the least similarity shares no table's bits.
MISSED = 0.001
#: Standard deviations of the distance that the radius allows for.
SPARE = 3.0
_STEP = 1 << 20

_WORDS = BITS // 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FLIP = np.random.default_rng(20240301).integers(0, 1 << 63, _WORDS, dtype=np.uint64)
#: Eight counters of eight bits for each byte, one for each of its bits.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8)).view(np.uint64).ravel()


def differing_share(least: tuple[int, int] = LEAST) -> float:
    """Chance that a fingerprint bit of two sets of this similarity differs."""
    s = least[0] / least[1]
    return math.acos(2 * s / (1 + s)) / math.pi


def radius() -> int:
    p = differing_share()
    return round(BITS * p + SPARE * math.sqrt(BITS * p * (1 - p)))


def tables(n: int) -> list[np.ndarray]:
    """The sampled bits of each table for ``n`` fingerprints: both numbers grow with the logarithm or a small power of n."""
    width = max(8, math.ceil(math.log2(max(1, n) / GROUP)))
    found = math.ceil(math.log(MISSED) / math.log1p(-((1 - differing_share()) ** width)))
    rng = np.random.default_rng(20240302)
    return [rng.choice(BITS, width, replace=False) for _ in range(found)]


def shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, sorted. A text of fewer words is one shingle."""
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, at)
    rolling = Rolling(Rolling.of_bytes(data).between(starts, ends))
    n = np.diff(first)
    document = np.repeat(np.arange(len(n)), n)
    begin = np.flatnonzero(np.arange(len(document)) + words <= first[1:][document])
    short = np.flatnonzero((n > 0) & (n < words))
    hashes = np.concatenate([rolling.between(begin, begin + words), rolling.between(first[short], first[short] + n[short])])
    document = np.concatenate([document[begin], short])
    order = np.lexsort((hashes, document))
    document, hashes = document[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (document[1:] != document[:-1]) | (hashes[1:] != hashes[:-1])
    return document[new], hashes[new]


def majority(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints (documents x words) of documents that have ``size`` of the ``hashes`` each, one after the other."""
    out = np.zeros((len(size), _WORDS), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    # Counters of eight bits hold 255 hashes.
    pieces = -(-size[full] // 255)
    lead = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(lead, pieces)
    begin = np.repeat((np.cumsum(size) - size)[full], pieces) + 255 * inner
    for k in range(_WORDS):
        octets = mixed(hashes ^ _FLIP[k]).view(np.uint8).reshape(-1, 8)
        lanes = np.stack([np.add.reduceat(_LANES[octets[:, b]], begin) for b in range(8)], axis=1)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), lead, axis=0)
        out[full, k] = np.packbits(2 * counts > size[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _prints(words: int):
    """Appends set (a hash of the shingle set, 0 if it is empty) and the fingerprint p0, p1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            for low, high, data, at in steps(batch.column("text"), _STEP):
                document, hashes = shingles(data, at, words)
                size = np.bincount(document, minlength=high - low)
                out = batch.slice(low, high - low).drop_columns("text").append_column("print", pa.array(_set_hash(hashes, size)))
                for k, column in enumerate(majority(hashes, size).view(np.int64).T):
                    out = out.append_column(f"p{k}", pa.array(np.ascontiguousarray(column)))
                yield out

    return run


def _set_hash(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(hashes), (np.cumsum(size) - size)[full]) + size[full].astype(np.uint64))
    return out.view(np.int64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in steps(batch.column(0), _STEP):
                document, hashes = shingles(data, at, words)
                size = np.bincount(document, minlength=high - low)
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(hashes, size)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["print", "set"])

    return run


def _keyed(sampled: list[np.ndarray]):
    """A row per table: key (table number and its sampled bits), print and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1 + _WORDS)]
            bits = np.unpackbits(np.column_stack(columns[1:]).view(np.uint8), axis=1, bitorder="little")
            for t, places in enumerate(sampled):
                key = (np.int64(t) << np.int64(48)) + bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", *batch.schema.names])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, print, fingerprint), sorted by key and sub: per group, a minimum spanning forest of the near pairs."""
    held: list[pa.RecordBatch] = []
    most = radius()

    def forest(table: pa.Table, upto: int) -> pa.RecordBatch:
        key, sub, name = (table.column(c).to_numpy()[:upto] for c in ("key", "sub", "print"))
        prints = np.column_stack([table.column(f"p{k}").to_numpy()[:upto] for k in range(_WORDS)]).view(np.uint64)
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]) if upto else np.zeros(0, np.int64)
        several = np.bincount(group)[group] > 1 if upto else np.zeros(0, bool)
        prints, name = prints[several], name[several]
        a, b, d = near(prints, group[several], most, distances=True)
        return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b]), pa.array(d.astype(np.int32))], ["u", "v", "d"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 16384:
            table = pa.Table.from_batches(held).combine_chunks()
            key, sub = table.column("key").to_numpy(), table.column("sub").to_numpy()
            other = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            upto = int(other[-1]) + 1 if len(other) else 0  # whole groups only; the last may go on
            if upto:
                yield forest(table, upto)
            held = table.slice(upto).to_batches()
    if held:
        yield forest(pa.Table.from_batches(held).combine_chunks(), sum(b.num_rows for b in held))


def candidates(prints: DataFrame) -> DataFrame:
    """u, v (prints, u < v) and their distance d: spanning forests of the pairs within the radius, group by group."""
    fingerprint = [f"p{k}" for k in range(_WORDS)]
    distinct = cut_lineage(prints.filter("print <> 0").groupBy("print").agg(*[F.first(p).alias(p) for p in fingerprint]))
    schema = "key long, print long, " + ", ".join(f"{p} long" for p in fingerprint)
    keyed = distinct.mapInArrow(_keyed(tables(distinct.count())), schema)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.col("key").alias("hot"), F.ceil(F.col("n") * 2 / HOT).cast("long").alias("chunks"))
    dealt = join_hot(keyed, "key", hot, "hot", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("print"), chunks)
    partner = F.sequence(F.lit(0).cast("long"), chunks - 1)
    dealt = dealt.select("key", F.explode(F.transform(partner, lambda x: F.least(x, mine) * chunks + F.greatest(x, mine))).alias("sub"), "print", *fingerprint)
    found = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_compared, "u long, v long, d int")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d").filter("u <> v").distinct()


def _written(df: DataFrame, name: str) -> DataFrame:
    """As a table in the shared folder; unlike a checkpoint, its size is known to the planner, which may then broadcast it."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    gathered(df)[0].write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _sets_of(names: DataFrame, prints: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """print, set: the shingle sets of these prints (one column), from one text of each."""
    wanted = _written(prints.join(names.toDF("p"), F.col("print") == F.col("p"), "left_semi").groupBy("print").agg(F.min("text_hash").alias("h")).select("h").distinct(), "wanted")
    some = texts.join(wanted, F.xxhash64("text") == F.col("h"), "left_semi").select("text")
    return cut_lineage(some.mapInArrow(_sets(words), "print long, set array<long>").groupBy("print").agg(F.first("set").alias("set")))


def _alike(pairs: DataFrame, prints: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose whole sets are similar enough."""
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("p")).distinct(), prints, texts, words)
    one = join_hot(pairs.select("u", "v"), "v", sets.select(F.col("print").alias("pv"), F.col("set").alias("sv")), "pv").drop("pv")
    both = join_hot(one, "u", sets.select(F.col("print").alias("pu"), F.col("set").alias("su")), "pu").drop("pu")
    common, total = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    return gathered(both.filter(common * (LEAST[0] + LEAST[1]) >= total * LEAST[0]).select("u", "v"))[0]


def _labelled(found: DataFrame, tree: DataFrame) -> DataFrame:
    """``found`` (u, v, ...) with the roots ru and rv of both ends in ``tree``; a print outside it is its own root."""
    rooted = join_hot(found, "u", tree.select(F.col("node").alias("nu"), F.col("root").alias("ru")), "nu", "left")
    rooted = join_hot(rooted, "v", tree.select(F.col("node").alias("nv"), F.col("root").alias("rv")), "nv", "left")
    return rooted.withColumns({"ru": F.coalesce("ru", "u"), "rv": F.coalesce("rv", "v")}).drop("nu", "nv")


def _checked_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, sub, root, print, set), sorted by family and sub: links between all similar sets of a group whose
    roots differ. An inverted index gives a set's overlaps with all others of its group at once."""
    held: list[pa.RecordBatch] = []

    def linked(table: pa.Table) -> pa.RecordBatch:
        root, name = (table.column(c).to_numpy() for c in ("root", "print"))
        sets = table.column("set").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        hashes = sets.flatten().to_numpy()
        n = len(name)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(hashes, kind="stable")
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        first = np.cumsum(times) - times
        owners = owner[order]
        lead = np.cumsum(size) - size
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(n):
            mine = which[lead[i] : lead[i] + size[i]]
            count = np.bincount(np.concatenate([owners[first[k] : first[k] + times[k]] for k in mine]), minlength=n)
            hit = np.flatnonzero(count[i + 1 :] * (LEAST[0] + LEAST[1]) >= (size[i] + size[i + 1 :]) * LEAST[0]) + i + 1
            hit = hit[root[hit] != root[i]]
            a, b = np.append(a, np.full(len(hit), i)), np.append(b, hit)
            if len(a) > 4 * n:
                least = roots(n, a, b)
                a = np.flatnonzero(least != np.arange(n))
                b = least[a]
        return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], ["u", "v"])

    def groups(last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        family, sub = table.column("family").to_numpy(), table.column("sub").to_numpy()
        begin = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (sub[1:] != sub[:-1])])
        ends = np.append(begin[1:], len(family))
        for low, high in zip(begin, ends) if last else zip(begin[:-1], ends[:-1]):
            if high - low > 1:
                yield linked(table.slice(low, high - low))
        held[:] = [] if last else table.slice(begin[-1]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from groups(False)
    if held:
        yield from groups(True)


def _whole_families(families: DataFrame, prints: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(u, v) of similar sets in each family (print, family, root) that has several roots. A family of more shingles than
    ``CHUNK`` is cut into chunks by hash, and every pair of chunks is compared."""
    several = families.groupBy(F.col("family").alias("f")).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("f")
    open_, _ = gathered(join_hot(families, "family", several, "f").select("print", "family", "root"))
    sets = _sets_of(open_.select("print"), prints, texts, words)
    size = join_hot(open_.select("print", "family"), "print", sets.select(F.col("print").alias("p"), F.size("set").alias("n")), "p").groupBy(F.col("family").alias("f")).agg(F.ceil(F.sum("n") / CHUNK).cast("long").alias("chunks"))
    mine = F.pmod(F.xxhash64("print"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: F.least(x, mine) * F.col("chunks") + F.greatest(x, mine))
    dealt = join_hot(open_, "family", size, "f").select("family", F.explode(pairs).alias("sub"), "root", "print")
    full = join_hot(dealt, "print", sets.select(F.col("print").alias("p"), "set"), "p").select("family", "sub", "root", "print", "set")
    return full.repartition("family", "sub").sortWithinPartitions("family", "sub").mapInArrow(_checked_whole, "u long, v long")


def links(prints: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(u, v): checked links between distinct prints.

    Families are the components of the candidates. In rounds, each component's closest candidate outside it is checked and
    joined, until a round joins few; that settles families of similar texts with few checks. What is still apart inside a
    family is then compared whole.
    """
    found, _ = gathered(candidates(prints))
    families = cut_lineage(components(found))
    done, asked, tree, before = None, None, found.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0), None
    while True:
        apart = _labelled(found, tree).filter("ru <> rv")
        if asked is not None:
            apart = apart.join(asked, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")), "left_anti")
        apart, _ = gathered(apart)
        ends = apart.select("ru", "u", "v", "d").unionByName(apart.select(F.col("rv").alias("ru"), "u", "v", "d"))
        closest, n = gathered(ends.groupBy("ru").agg(F.min(F.struct("d", "u", "v")).alias("best")).select("best.u", "best.v").distinct())
        if not n or before is not None and n > before * 0.75:
            break
        before = n
        new = _alike(closest, prints, texts, words)
        done = new if done is None else done.unionByName(new)
        named = closest.select(F.col("u").alias("a"), F.col("v").alias("b"))
        asked = named if asked is None else asked.unionByName(named)
        tree = cut_lineage(components(done))
    labels = join_hot(families.select(F.col("node").alias("print"), F.col("root").alias("family")), "print", tree.withColumnRenamed("root", "r"), "node", "left")
    rest = _whole_families(labels.select("print", "family", F.coalesce("r", "print").alias("root")), prints, texts, words)
    rest, _ = gathered(rest)
    return rest if done is None else done.unionByName(rest)


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component of similar documents, with the columns of ``docs``: that with the smallest id, null
    ids last.

    Words are lower-cased in ASCII. Null, empty and blank texts have the empty set and are alike. Repeated shingles count
    once. Equal sets are alike. Rows that repeat an id are told apart by a hash of all columns (maps excepted); rows alike
    in all columns are one document and stay or go together. An empty table gives no rows. Texts of any length are taken
    whole.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), row_hash(docs).alias("rest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "rest", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, rest long, text_hash long, print long, " + ", ".join(f"p{k} long" for k in range(_WORDS))
    prints = cut_lineage(rows.mapInArrow(_prints(words), schema))
    return keep_first(docs, prints.select("doc_id", "rest", "print"), links(prints, texts, words), id_column)
