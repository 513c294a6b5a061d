"""Repetition rules: characters inside repeated n-grams and lines, from rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, mixed, per_document, steps, word_bounds

#: Per n-gram length, the percentage of a text's word characters that may lie in n-grams that repeat an earlier one. The
#: first occurrence does not count, so one line said twice does not condemn a short text.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for characters in lines that repeat an earlier line.
LINE_LIMIT = 20
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``_NAMES`` for each document of ``data``."""
    starts, ends, first = word_bounds(data, at)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    chars = letters[ends] - letters[starts]
    n_words = np.diff(first)
    document = np.repeat(np.arange(len(at) - 1), n_words)
    salt = mixed(document.astype(np.uint64) + np.uint64(1))
    out = {"n_words": n_words, "word_chars": per_document(chars, first), "n_symbols": per_document(_SYMBOL[data], at)}

    bytes_of = Rolling.of_bytes(data)
    words = Rolling(bytes_of.between(starts, ends))
    room = first[document + 1] - np.arange(len(starts)) if len(starts) else np.zeros(0, np.int64)

    def cover(begins: np.ndarray, n: int) -> np.ndarray:
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + n, -1)
        return np.cumsum(change[:-1]) > 0

    # A repeated n-gram consists of repeated shorter ones, so each length looks only where the one before it repeats.
    before, begins = 3, np.flatnonzero(room >= 3)
    for n in (3, *NGRAM_LIMITS):
        if n > 3:
            held = np.zeros(len(starts) + n, bool)
            held[begins] = True
            begins = begins[np.logical_and.reduce([held[begins + k] for k in range(n - before + 1)]) & (room[begins] >= n)]
        later = begins
        if len(begins):
            keys = mixed(words.between(begins, begins + n) ^ salt[begins])
            later = begins[_later(keys)]
            begins = begins[_repeated(keys)]
        before = n
        if n == 3:
            out["n_repeat_words"] = per_document(cover(begins, n), first)
        else:
            out[f"dup_{n}gram_chars"] = per_document(np.where(cover(later, n), chars, 0), first)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.union1d(breaks + 1, at[:-1])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    if len(line_starts):
        line_ends = line_ends - ((data[line_ends - 1] == 0x0A) & (line_ends > line_starts))
    of = np.searchsorted(at, line_starts, "right") - 1
    low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = high > low
    line_starts, line_ends, of, low, high = (x[full] for x in (line_starts, line_ends, of, low, high))
    again = _later(mixed(bytes_of.between(line_starts, line_ends) ^ mixed(of.astype(np.uint64) + np.uint64(1))))
    sums = np.concatenate(([0], np.cumsum(chars)))
    out["n_dup_lines"] = np.bincount(of[again], minlength=len(at) - 1)
    out["dup_line_chars"] = np.bincount(of[again], (sums[high] - sums[low])[again], len(at) - 1).astype(np.int64)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in steps(batch.column(1)):
            found = measure(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(found[k].astype(np.int64)) for k in _NAMES)], ["doc_id", *_NAMES])


def repetition_rules(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule; a null id stays null; repeated rows are judged one by one,
    each on its own text; an empty table gives no rows. Only the id and text columns are read, so other columns do not
    matter, whatever their names. Whole texts are measured, a long one as one numpy step.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(_run, ", ".join(["doc_id long", *(f"{n} long" for n in _NAMES)]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, most in NGRAM_LIMITS.items():
        fine &= 100 * F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
