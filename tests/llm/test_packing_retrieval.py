from collections import Counter

import numpy as np
import pytest
import pyarrow.parquet as pq

from sigspark.llm import packing
from sigspark.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def corpus():
    words = packing._Words.of(tokenizer_file())
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()[:4000]
    return [np.unique(words.ids(t or ""), return_counts=True) for t in texts]


def statistics(profiles):
    df = np.zeros(1 << 16)
    for terms, _ in profiles:
        df[terms] += 1
    return np.where(df > 0, np.log1p((len(profiles) - df + 0.5) / (df + 0.5)), 0.0), np.mean([c.sum() for _, c in profiles])


def test_scores_are_bm25(corpus):
    some = corpus[:150]
    idf, mean = statistics(some)
    index = packing._Index(some, idf, mean)
    for seed in (0, 7, 149):
        expected = np.zeros(len(some))
        for d, (terms, times) in enumerate(some):
            tf = dict(zip(terms.tolist(), times.tolist()))
            for t in some[seed][0].tolist():
                if t in tf:
                    expected[d] += idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * times.sum() / mean))
        assert np.allclose(index.scores(seed), expected, rtol=1e-5)


@pytest.mark.parametrize("n, per_shard", [(1000, 200), (4000, 800), (4000, 200)])
def test_nearest_neighbours_share_a_shard(corpus, n, per_shard):
    """How often the best neighbour of all documents, by brute force, stands in the seed's own shard. By chance it is per_shard / n."""
    profiles = corpus[:n]
    idf, mean = statistics(profiles)
    index = packing._Index(profiles, idf, mean)
    keys = [tuple(packing.route(t, packing.bm25(t, c, idf, mean))) for t, c in profiles]
    shard = {d: k // per_shard for k, d in enumerate(sorted(range(n), key=lambda d: keys[d]))}
    hits = []
    for seed in range(0, n, n // 200):
        scores = index.scores(seed)
        scores[seed] = 0
        hits.append(shard[int(scores.argmax())] == shard[seed])
    print(n, per_shard, np.mean(hits))
    assert np.mean(hits) > per_shard / n + 0.12


def test_small_shards_hold_every_id_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(docs, tokenizer_file(), per_shard=17).collect()
    taken = Counter()
    for p in pieces:
        taken[p.doc_id] += p.length
    assert taken == {p.doc_id: p.doc_tokens for p in pieces} and len(taken) == docs.count()
    windows = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert windows[p.sequence_id] == p.offset
        windows[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in windows.values()) and max(windows.values()) <= 2048
