"""The quality classifier against plain loops: context vectors, pooling, and the network's own sums, on fifty documents."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sigspark.llm import quality_classifier as qc

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def hashes(word):
    data = np.frombuffer(word, np.uint8)
    w, s, _ = qc.items(data, np.array([0, len(word)]))
    return int(w[0]), int(s[0])


def shape(word):
    kinds = "".join("X" if 65 <= b <= 90 else "x" if 97 <= b <= 122 or b >= 128 else "9" if 48 <= b <= 57 else chr(b) for b in word)
    return re.sub(r"(.)\1+", r"\1", kinds)


def index_vector(h):
    v = [0.0] * qc.DIMENSIONS
    for k in range(qc.NONZERO):
        v[(h >> (20 + 8 * k)) % qc.DIMENSIONS] += 1.0 - 2.0 * ((h >> (60 - k)) & 1)
    return v


def vectors(texts):
    """Row of words and of shapes to the sum of its neighbours' index vectors, scaled to length one."""
    sums = [defaultdict(lambda: [0.0] * qc.DIMENSIONS) for _ in range(2)]
    for t in texts:
        known = [hashes(w) for w in WORDS.findall((t or "").encode())]
        for left, right in zip(known, known[1:]):
            for one, other in ((left, right), (right, left)):
                for side in (0, 1):
                    row = sums[side][one[side] % qc.ROWS]
                    for h in other:
                        for d, x in enumerate(index_vector(h)):
                            row[d] += x
    return [{r: [round(x / max(math.sqrt(sum(y * y for y in v)), 1e-9), 5) for x in v] for r, v in side.items()} for side in sums]


def features(text, table):
    data = (text or "").encode()
    words = WORDS.findall(data)
    n, size = max(len(words), 1), max(len(data), 1)
    out = []
    for side in (0, 1):
        rows = [table[side].get(hashes(w)[side] % qc.ROWS, [0.0] * qc.DIMENSIONS) for w in words]
        out += [sum(r[d] for r in rows) / n for d in range(qc.DIMENSIONS)]
    upper = sum(65 <= b <= 90 for b in data)
    marks = sum(b > 32 and not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b == ord("X") or b == ord("x")) for b in data)
    return [*out, math.log1p(len(data)), math.log1p(len(words)), upper / size, marks / size, data.count(b"\n") / n, len({w.lower() for w in words}) / n]


def forward(network, x):
    a, b, c, d = (np.asarray(w).tolist() for w in network.weights)
    z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, network.middle.tolist(), network.spread.tolist())]
    hidden = [math.tanh(sum(z[i] * a[i][j] for i in range(len(z))) + b[j]) for j in range(len(b))]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, c)) + d) / network.temperature))


RNG = random.Random(17)
TEXTS = [" ".join(RNG.choices(["Good", "plain", "words", "of", "prose,", "and", "More.", "a1b2"] if k % 2 else ["$$$", "BUY", "now!!", "x9x9", "free", "CLICK", "9999", "é"], k=RNG.randint(1, 60))) + "\n" * (k % 3) for k in range(50)] + [None, "", " \t "]


def test_shapes_are_told_apart_as_written():
    words = [b"Abc", b"Xyyy", b"a1", b"zz99", b"A-b", b"\xc3\xa9t\xc3\xa9", b"ABC", b"9.9", b"x"]
    for v in words:
        for w in words:
            assert (hashes(v)[1] == hashes(w)[1]) == (shape(v) == shape(w)), (v, w)


def test_vectors_and_pooling_equal_plain_loops(table):
    docs = table(list(enumerate(TEXTS))).repartition(3)
    got, want = qc.word_vectors(docs), vectors(TEXTS)
    for side in (0, 1):
        assert {r for r in range(qc.ROWS) if got[side][r].any()} == {r for r, v in want[side].items() if any(v)}
        assert all(np.allclose(got[side][r], v, atol=2e-5) for r, v in want[side].items())
    data = [(t or "").encode() for t in TEXTS]
    rows = qc.pooled(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))), got)
    assert np.allclose(rows, [features(t, want) for t in TEXTS], atol=1e-4)


def test_scores_equal_a_plain_forward_pass(spark, table, monkeypatch):
    monkeypatch.setattr(qc, "UPDATES", 300)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qc.score(table(list(enumerate(TEXTS))), labels).collect()}
    want = vectors(TEXTS)
    x = np.array([features(t, want) for t in TEXTS], np.float32).astype(float)
    network = qc.Network(x[:50], np.arange(50) % 2.0)
    for k in range(len(TEXTS)):
        p = forward(network, x[k].tolist())
        assert got[k].score == pytest.approx(p, abs=5e-3) and (abs(p - qc.THRESHOLD) < 5e-3 or got[k].predicted == int(p >= qc.THRESHOLD))
    assert sum(got[k].predicted == k % 2 for k in range(50)) >= 48
