"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word and every word shape (letters, digits and marks, with runs collapsed) has a sparse random index vector and a
row in a table of fixed size. The row collects the index vectors of its neighbours, over all documents. A document is
the mean of its words' rows, the mean of its shapes' rows, and a few surface numbers. The network learns from a bounded
sample of labelled rows; a temperature fitted on rows it has not seen calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, cut_lineage, mixed, per_document, steps, word_bounds

DIMENSIONS = 32
ROWS = 8192
NONZERO = 2
#: The network learns from at most about this many labelled rows, chosen by hash.
TRAINING_ROWS = 20_000
HIDDEN = 32
#: Updates of the network, each on 256 rows, however many rows there are.
UPDATES = 9000
THRESHOLD = 0.3
_STEP = 1 << 19
_SLICES = 64

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("X")
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = ord("x")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def items(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (lower-cased) and of their shapes, and the number of each document's first word."""
    starts, ends, first = word_bounds(data, at)
    words = Rolling.of_bytes(_LOWER[data]).between(starts, ends)
    kind = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shapes = mixed(Rolling.of_bytes(kind[keep]).between(place[starts], place[ends]))
    return words, shapes, first


def _indexed(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nonzero places of the index vectors, and their signs."""
    return [(((h >> np.uint64(20 + 8 * k)) % np.uint64(DIMENSIONS)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(60 - k)) & np.uint64(1))) for k in range(NONZERO)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the context table, by slice of rows."""
    table = np.zeros(2 * ROWS * DIMENSIONS)
    for batch in batches:
        for _, _, data, at in steps(batch.column(0), _STEP):
            words, shapes, first = items(data, at)
            if len(words) < 2:
                continue
            joined = np.ones(len(words), bool)
            joined[first[(first < len(words))]] = False  # not across two documents
            later = np.flatnonzero(joined)
            rows = [(words % np.uint64(ROWS)).astype(np.int64) * DIMENSIONS, (shapes % np.uint64(ROWS)).astype(np.int64) * DIMENSIONS + ROWS * DIMENSIONS]
            for place, sign in [*_indexed(words), *_indexed(shapes)]:
                for row in rows:
                    table += np.bincount(np.concatenate([row[later] + place[later - 1], row[later - 1] + place[later]]), np.concatenate([sign[later - 1], sign[later]]), len(table))
    parts = table.reshape(_SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["slice", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[k] = sums.get(k, 0) + np.frombuffer(part.as_py(), np.float32).astype(np.float64)
    for k, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """2 x ROWS x DIMENSIONS, each row of length one: a fixed size, whatever the corpus."""
    sums = docs.select(F.col(text).alias("text")).mapInArrow(_contexts, "slice int, part binary").repartition("slice").mapInArrow(_added, "slice int, part binary")
    table = np.zeros((_SLICES, 2 * ROWS * DIMENSIONS // _SLICES))
    for k, part in sums.collect():
        table[k] = np.frombuffer(bytes(part))
    table = table.reshape(2, ROWS, DIMENSIONS)
    # Sums in another order may differ in the last bits; rounding makes reruns agree.
    return np.round(table / np.maximum(np.linalg.norm(table, axis=2, keepdims=True), 1e-9), 5).astype(np.float32)


def pooled(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    words, shapes, first = items(data, at)
    n = np.maximum(np.diff(first), 1)[:, None]
    out = []
    for h, table in ((words, vectors[0]), (shapes, vectors[1])):
        rows = table[(h % np.uint64(ROWS)).astype(np.int64)]
        sums = np.zeros((len(at) - 1, DIMENSIONS), np.float64)
        some = np.diff(first) > 0
        if len(rows):
            sums[some] = np.add.reduceat(rows, first[:-1][some], axis=0, dtype=np.float64)
        out.append(sums / n)
    size = np.diff(at)
    total = np.maximum(size, 1)
    upper = per_document((data >= 65) & (data <= 90), at) / total
    marks = per_document((data > 32) & (_CLASS[data] != ord("X")) & (_CLASS[data] != ord("x")), at) / total
    lines = per_document(data == 0x0A, at) / n[:, 0]
    document = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(first))
    kinds = np.unique(mixed(words ^ mixed(document + np.uint64(1))) >> np.uint64(24) << np.uint64(24) | document.astype(np.uint64) & np.uint64(0xFFFFFF))
    distinct = np.bincount((kinds & np.uint64(0xFFFFFF)).astype(np.int64), minlength=len(at) - 1) / n[:, 0]
    return np.column_stack([*out, np.log1p(size), np.log1p(np.diff(first)), upper, marks, lines, distinct]).astype(np.float32)


class Network:
    """Two layers, trained by Adam on standardised features; ``temperature`` divides its logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant = float(y.mean()) if len(y) else 0.5
        self.trained = len(np.unique(y)) == 2
        if not self.trained:
            return
        order = rng.permutation(len(y))
        seen, unseen = order[len(y) // 5 :], order[: len(y) // 5]
        self.middle, self.spread = x[seen].mean(0), x[seen].std(0) + 1e-6
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z = self._standard(x)
        at = len(seen)
        for t in range(1, UPDATES + 1):
            if at >= len(seen):
                rng.shuffle(seen)
                at = 0
            some, at = seen[at : at + 256], at + 256
            h = np.tanh(z[some] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[some]) / len(some)
            back = np.outer(error, w[2]) * (1 - h * h)
            for i, g in enumerate((z[some].T @ back + 1e-4 * w[0], back.sum(0), h.T @ error + 1e-4 * w[2], error.sum())):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if len(np.unique(y[unseen])) == 2:
            logit = self.logit(x[unseen])
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda s: np.logaddexp(0, np.where(y[unseen] == 1, -logit, logit) / s).sum())

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh(self._standard(x) @ a + b) @ c + d) / getattr(self, "temperature", 1.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x))) if self.trained else np.full(len(x), self.constant)


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in steps(batch.column(1), _STEP):
                rows = pooled(data, at, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "features"])

    return run


def score(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; learns from ``labels`` (id_column and 0/1 label).

    Null and empty texts have zero features and get a score like any other. Labels that are null, or whose document is
    not there, are passed over; where an id has several labels the largest counts. Without labels of both kinds the score
    is their mean, 0.5 without any. Repeated rows get equal scores; a null id stays null and is never learned from; an
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(word_vectors(docs, text))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = cut_lineage(rows.mapInArrow(_featured(shared), "doc_id long, features binary"))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, TRAINING_ROWS / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted((i, bytes(f), y) for i, f, y in features.join(sample, "doc_id").select("doc_id", "features", "y").collect())  # about TRAINING_ROWS rows
    x = np.array([np.frombuffer(f, np.float32) for _, f, _ in rows], np.float64)
    network = spark.sparkContext.broadcast(Network(x, np.array([y for _, _, y in rows], np.float64)))

    @F.pandas_udf("double")
    def probability(f: pd.Series) -> pd.Series:
        if not len(f):
            return pd.Series([], dtype=float)
        return pd.Series(network.value.probability(np.frombuffer(b"".join(f), np.float32).reshape(len(f), -1).astype(np.float64)))

    return features.select("doc_id", probability("features").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
