import random

import numpy as np
import pytest

import corpus_pipeline
from sigspark.llm import wide_simhash
from sigspark.llm.common import mixed
from sigspark.llm.simhash import spanning


def pairs(rows, words=5):
    """Pairs of ids whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    split = {i: t.lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for i, w in split.items()}
    return {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and 5 * len(a & b) >= 4 * len(a | b)}


def least_of_components(rows):
    least = {i: i for i, _ in rows}
    found = pairs(rows)
    while True:
        new = dict(least)
        for i, j in found:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            return sorted(set(least.values()))
        least = new


def copies(groups, size, changes):
    """Groups of texts of 200 words in which up to ``changes`` words differ from the group's first."""
    rng = random.Random(7)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(changes + 1)):
                text[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_stage_keeps_one_of_each_component_of_similar_texts(spark, table):
    rows = copies(60, 3, 4)
    near = pairs(rows)
    assert len(near) > 60
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, table(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == least_of_components(rows)


def test_recall_of_pairs(table):
    """Documents two by two, so that every lost pair is seen."""
    rows = copies(300, 2, 4)
    near = pairs(rows)
    kept = {r.doc_id for r in wide_simhash.drop_near_duplicates(table(rows)).collect()}
    found = {(i, j) for i, j in near if j not in kept}
    assert len(near) > 150 and len(found) >= 0.99 * len(near)
    assert len(kept) == len(rows) - len(found)


@pytest.mark.parametrize("hot, chunk", [(wide_simhash.HOT, wide_simhash.CHUNK), (40, 3000)])
def test_crowded_key_is_searched_whole(table, hot, chunk, monkeypatch):
    monkeypatch.setattr(wide_simhash, "HOT", hot)
    monkeypatch.setattr(wide_simhash, "CHUNK", chunk)
    rows = copies(1, 120, 8)
    kept = [r.doc_id for r in wide_simhash.drop_near_duplicates(table(rows)).collect()]
    assert sorted(kept) == least_of_components(rows)


def test_odd_rows(odd, empty, clashing):
    assert wide_simhash.drop_near_duplicates(empty).collect() == []
    kept = wide_simhash.drop_near_duplicates(odd).collect()
    assert sum(not (r.text or "").strip() for r in kept) == 1 and {r.doc_id for r in kept} >= {5, 6, 7}
    assert wide_simhash.drop_near_duplicates(clashing).columns == clashing.columns


def test_fingerprints_against_brute_force():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 255, 256, 700, 2])
    hashes = rng.integers(0, 1 << 63, size.sum(), dtype=np.uint64)
    got = wide_simhash.majority(hashes, size)
    for row, h in zip(got, np.split(hashes, np.cumsum(size)[:-1])):
        for k, flip in enumerate(wide_simhash._FLIP):
            x = [int(v) for v in mixed(h ^ flip)]
            assert int(row[k]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x) > len(x))


def test_minimum_spanning_forest():
    rng = np.random.default_rng(4)
    a, b, w = rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 9, 200)
    label, total = list(range(60)), 0
    for i in np.lexsort((b, a, w)):  # Kruskal
        x, y = label[a[i]], label[b[i]]
        if x != y:
            total += w[i]
            label = [y if v == x else v for v in label]
    best = spanning(60, a, b, w)
    assert w[best].sum() == total and len(best) == 60 - len(set(label))
