import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sigspark.llm import suffix_dedup as s


def brute(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + s.LENGTH] for t in texts for i in range(len(t) - s.LENGTH + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - s.LENGTH + 1):
            if seen[t[i : i + s.LENGTH]] > 1:
                gone[i : i + s.LENGTH] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if t else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(docs, **more):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(docs, **more).collect())


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 300)
    texts = [prose(rng, 120) + passage + prose(rng, rng.randint(1, 90)) for _ in range(25)]
    for _ in range(12):  # near copies
        words = base.split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [base, base, passage[:199], passage[:200], passage[50:260], "ab" * 400, "x" * 1500, "x" * 200, "x" * 199, passage + passage, "\0" * 300 + base[:150], base[100:299], "", None]
    return texts


@pytest.mark.parametrize("hot", [s.HOT, 2])
def test_against_brute_force(table, hot):
    texts = corpus()
    assert got(table(list(enumerate(texts))), hot=hot) == brute(texts)


@pytest.mark.parametrize("block", [700, 4000])
def test_small_blocks(spark, table, block, monkeypatch):
    texts = corpus()
    docs = table(list(enumerate(texts)))
    import pyarrow as pa

    from sigspark.llm import blocks

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = pa.Table.from_batches(list(blocks._blocks(iter([batch]), block)))
    assert len(made) > 1
    assert sum(len(x) for x in made["ids"].to_pylist()) == len(texts)
    monkeypatch.setattr(s, "into_blocks", lambda docs, text, ids: blocks.into_blocks(docs, text, ids, block))
    assert got(docs.repartition(7)) == brute(texts)


def test_sort_finds_every_tie():
    rng = np.random.default_rng(1)
    for length in (40, 64, 200):
        texts = [rng.integers(97, 99, rng.integers(length, 3 * length)).astype(np.uint8) for _ in range(40)]
        texts += [np.concatenate([texts[0][3:], texts[1]]), np.full(4 * length, 97, np.uint8), np.tile(np.array([97, 98, 98], np.uint8), length)]
        sizes = np.array([len(t) for t in texts])
        windows = [bytes(t[i : i + length]) for t in texts for i in range(len(t) - length + 1)]
        seen = Counter(windows)
        assert s.repeated_windows(np.concatenate(texts), sizes, length).tolist() == [seen[w] > 1 for w in windows]


def test_cover_has_every_distance():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))


def test_odd_rows(odd, empty, clashing):
    from .conftest import ODD

    assert got(odd) == brute([r[1] for r in ODD]) == got(clashing)
    assert got(empty) == []


def test_kept_bytes(table):
    rng = random.Random(9)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = {r.doc_id: bytes(r.kept) for r in s.remove_repeats(table([(1, "first " + a), (2, a + " second"), (3, b)])).collect()}
    assert rows == {1: b"first ", 2: b" second", 3: b.encode()}
