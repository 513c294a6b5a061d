import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sigspark.llm import simhash

from .conftest import ODD


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows, radius=2):
    """The component of each id (ids distinct)."""
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            label[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {d: (f"{brute_print(t):016x}", expected[d]) for d, t in rows}


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_of_crowded_prints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(250):
            v = centre
            for _ in range(rng.randint(0, 6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from sigspark.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "print long"))).collect()}
    label = np.arange(len(values))
    pairs = [(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2]
    label = simhash.roots(len(values), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    groups = {}
    for s, k in zip(signed, label):
        groups.setdefault(k, []).append(s)
    assert {s: min(g) for g in groups.values() if len(g) > 1 for s in g} == got


def test_near_gives_a_spanning_forest():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**10, 700).astype(np.uint64)
    group = np.sort(rng.integers(0, 5, 700))
    a, b = simhash.near(prints, group, 2)
    expected = [(i, j) for i, j in combinations(range(700), 2) if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= 2]
    i, j = np.array(expected).T
    assert (simhash.roots(700, a, b) == simhash.roots(700, i, j)).all() and len(a) < 700


def test_odd_rows(odd, empty, clashing):
    got = sorted(simhash.near_duplicates(odd).collect(), key=str)
    assert len(got) == len(ODD) and sorted(simhash.near_duplicates(clashing).collect(), key=str) == got
    assert {(r.doc_id, r.component_id) for r in got if r.fingerprint == "0" * 16} == {(None, 1), (1, 1), (2, 1), (3, 1)}
    assert [r.component_id for r in got if r.doc_id == 4 and r.fingerprint == f"{brute_print('one'):016x}"] == [4, 4]
    assert simhash.near_duplicates(empty).collect() == []


def test_one_document_of_each_component_stays(table, clashing, empty):
    words = [f"word{k}" for k in range(400)]
    some, other = " ".join(words), " ".join(reversed(words))
    rows = [(9, some), (3, some.upper()), (None, some + "\n"), (5, other), (5, other + " "), (5, other + "  "), (None, ""), (None, None), (8, "alone"), (8, "alone")]
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(table(rows)).collect()]
    assert kept.count((8, "alone")) == 2 and (3, some.upper()) in kept  # rows alike in all columns stay together
    left = [k for k in kept if k[0] not in (3, 8)]
    assert len(left) == 2 and sum(d == 5 and t.strip() == other for d, t in left) == 1 and sum(d is None and not t for d, t in left) == 1
    named = clashing.withColumnsRenamed({"key": "_gone", "score": "rest", "block": "_row"})
    assert simhash.drop_near_duplicates(named).columns == named.columns
    assert len({r.fingerprint for r in simhash.near_duplicates(named).collect()}) == len({(r.doc_id, r.text) for r in simhash.drop_near_duplicates(named).collect()})
    assert simhash.drop_near_duplicates(empty).collect() == []
