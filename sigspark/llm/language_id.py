"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose slots hold one bit per language: the AND of an n-gram's slots is the set of languages that have it.
Counts of n-grams cover every training document. An n-gram enters the filter of every language in which its share of the
n-grams is at least ``MIN_RATE``, so a language has at most ``1 / MIN_RATE`` of them and the filter has a fixed bound,
however large the corpus; rarer ones are misspellings and names that any language may hold. A document's bits are counted
per language and corrected for each language's false positives; the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, mixed, per_document, steps

NGRAM_BYTES = 4
MIN_RATE = 2e-5
#: A document is taken for text of a known language if that language has at least this share of its n-grams.
LEAST_KNOWN = 0.2
_SLOTS_PER_NGRAM = 8
_PROBES = 3
_FLUSH = 4_000_000
#: An n-gram takes some 50 bytes while it is counted or looked up.
_STEP = 1 << 19

_FOLD = np.full(256, 0x20, np.uint8)
for _c in (*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)):
    _FOLD[_c] = _c
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of folded bytes with a space at both ends of a text, without those that start with two spaces; where each document's begin."""
    n = len(at) - 1
    folded = np.insert(_FOLD[data], np.repeat(at, 2)[1:-1], 0x20).astype(np.uint32)
    edges = at + 2 * np.arange(n + 1)
    if len(folded) < NGRAM_BYTES:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    size = len(folded) - NGRAM_BYTES + 1
    grams = np.zeros(size, np.uint32)
    for k in range(NGRAM_BYTES):
        grams = (grams << np.uint32(8)) | folded[k : k + size]
    good = (grams >> np.uint32(16)) != 0x2020
    for k in range(1, NGRAM_BYTES):  # none across two documents
        last = edges[1:-1] - k
        good[last[(last >= 0) & (last < size)]] = False
    return grams[good], np.searchsorted(np.flatnonzero(good), np.minimum(edges, size))


def _counted(languages: list[str]):
    code_of = {x: i for i, x in enumerate(languages)}

    def emit(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["code", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            codes = np.array([code_of.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for first, end, data, at in steps(batch.column(0), _STEP):
                grams, begins = ngrams(data, at)
                code = np.repeat(codes[first:end], np.diff(begins))
                new, n = np.unique((code[code >= 0].astype(np.uint64) << np.uint64(32)) | grams[code >= 0], return_counts=True)
                both = np.concatenate([keys, new])
                keys, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > _FLUSH:
                    yield emit(keys, counts)
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(keys):
            yield emit(keys, counts)

    return run


class Filter:
    """Slots of language bits, 64 languages to a plane."""

    def __init__(self, languages: list[str], sizes: list[int], grams: np.ndarray, codes: np.ndarray):
        self.languages, self.prior = languages, int(np.argmax(sizes)) if sizes else -1
        self.slots = 1 << max(10, (_SLOTS_PER_NGRAM * len(np.unique(grams))).bit_length())
        self.planes = [np.zeros(self.slots, np.uint64) for _ in range(0, max(1, len(languages)), 64)]
        for place in self._places(grams.astype(np.uint64)):
            for k, plane in enumerate(self.planes):
                own = codes // 64 == k
                np.bitwise_or.at(plane, place[own], np.uint64(1) << (codes[own] % 64).astype(np.uint64))
        filled = [np.count_nonzero(self.planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / self.slots for i in range(len(languages))]
        self.false_rate = np.array(filled) ** _PROBES

    def _places(self, grams: np.ndarray) -> list[np.ndarray]:
        h = mixed(grams + np.uint64(1))
        return [((h >> np.uint64(20 * k)) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(_PROBES)]

    def scores(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents x languages: how many n-grams each language has, without the false positives to be expected; and how
        many each document has."""
        grams, begins = ngrams(data, at)
        places = self._places(grams.astype(np.uint64))
        out = np.zeros((len(at) - 1, len(self.languages)))
        for k, plane in enumerate(self.planes):
            bits = plane[places[0]]
            for place in places[1:]:
                bits &= plane[place]
            for i in range(64 * k, min(64 * k + 64, len(self.languages))):
                hits = per_document((bits >> np.uint64(i % 64)) & np.uint64(1), begins)
                out[:, i] = (hits - np.diff(begins) * self.false_rate[i]) / (1 - self.false_rate[i])
        return np.maximum(out, 0), np.diff(begins)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filter:
    """Learns from every row of ``docs`` whose language is not null; null texts add nothing."""
    known = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL")
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not languages:
        return Filter([], [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = known.mapInArrow(_counted(languages), "code int, gram long, n long").groupBy("gram", "code").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("code", "n")).alias("of"))  # a language occurs once in it
    by_gram = cut_lineage(by_gram)
    sizes = {r[0]: r[1] for r in by_gram.select(F.inline("of")).groupBy("code").agg(F.sum("n")).collect()}
    sizes_of = [sizes.get(i, 0) for i in range(len(languages))]
    rate = F.create_map(*[F.lit(x) for i, n in enumerate(sizes_of) for x in (i, 1.0 / max(1, n))])
    chosen = by_gram.select("gram", F.inline("of")).filter(F.col("n") * F.element_at(rate, F.col("code")) >= MIN_RATE)
    rows = chosen.select("gram", "code").toPandas()  # at most 1 / MIN_RATE rows per language
    return Filter(languages, sizes_of, rows["gram"].to_numpy(np.int64), rows["code"].to_numpy(np.int64))


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1: the best language's part of the n-grams of the two best) and known (0 to 1:
    the share of the text's n-grams that the best language has).

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. A text without any known n-gram
    gets the language with most training text, and score 0; ties go to the first language by code point. Repeated rows get
    equal answers, an empty table gives no rows, and input columns named lang_pred, score or known are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, known double>")
    def predict(texts, letters):
        import pandas as pd

        model = shared.value
        names, scores, shares = [], [], []
        has = letters.to_numpy(bool)
        for first, end, data, at in steps(pa.array(texts, pa.string(), from_pandas=True), _STEP):
            if not model.languages:
                names += ["und"] * (end - first)
                scores += [0.0] * (end - first)
                shares += [0.0] * (end - first)
                continue
            found, total = model.scores(data, at)
            best = np.where(found.max(1) > 0, found.argmax(1), model.prior)
            top = found.max(1)
            second = np.sort(found, 1)[:, -2] if found.shape[1] > 1 else np.zeros(len(found))
            share = np.divide(top, top + second, out=np.zeros(len(found)), where=top > 0)
            names += [model.languages[b] if ok else "und" for b, ok in zip(best, has[first:end])]
            scores += np.where(has[first:end], share, 0.0).tolist()
            shares += np.where(has[first:end], np.minimum(top / np.maximum(total, 1), 1.0), 0.0).tolist()
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float), "known": pd.Series(shares, dtype=float)})

    t = F.coalesce(F.col(text), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "known")]
    rows = docs.select(F.struct(*others).alias("doc"), predict(t, t.rlike(r"\p{L}")).alias("found"))
    return rows.select("doc.*", "found.*")
