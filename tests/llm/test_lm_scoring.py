import math
import re
from collections import Counter

import pytest

from sigspark.llm import lm_scoring


def brute(rows, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in docs), Counter()) for n in range(1, order + 1)]
    words = sum(map(len, docs))
    out = []
    for (i, _), w in zip(rows, docs):
        own = [grams(w, n) for n in range(1, order + 1)]
        known = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g] if g else words - len(w)
        score = back = 0
        for k in range(len(w)):
            g, penalty = tuple(w[max(0, k - order + 1) : k + 1]), 0
            while len(g) > 1 and known(g) <= 0:
                g, penalty = g[1:], penalty + 1
            seen = known(g) > 0
            back += penalty > 0 or not seen
            score += penalty * math.log10(0.4) + (math.log10(known(g) / known(g[:-1])) if seen else -math.log10(words - len(w) + 1))
        out.append((i, len(w), back, round(score, 6)))
    return sorted(out, key=str)


def got(docs, order):
    return sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log10_score, 6)) for r in lm_scoring.score(docs, order=order).collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(table, order):
    rows = [(i, " ".join("abcdefg"[(i * k * k + k) % 7] * (1 + k % 3) for k in range(i % 23))) for i in range(90)]
    assert got(table(rows), order) == brute(rows, order)


def test_odd_rows(odd, empty, clashing):
    from .conftest import ODD

    expected = brute([r[:2] for r in ODD], 3)
    assert got(odd, 3) == expected == got(clashing, 3)
    assert got(empty, 3) == []


def test_many_blocks_against_brute_force(table, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 300)
    rows = [(i, " ".join(f"{'abcdefghi'[(i * k + k * k) % 9]}{i % (1 + k % 4)}" for k in range(i % 31))) for i in range(120)]
    assert got(table(rows).repartition(5), 3) == brute(rows, 3)


def test_blocks_are_not_shuffled_and_answers_once(table):
    """Blocks once more in a shuffle, and the answers about words and pairs twice, were about a fifth of the disk."""
    plan = lm_scoring.score(table([(1, "a b c"), (2, "a b d")]))._jdf.queryExecution().executedPlan().toString()
    lines = [line.lstrip(" :+-*()0123456789") for line in plan.splitlines()]
    lines = [line for line in lines if not line.startswith(("Project", "ColumnarToRow"))]
    below = {after.split()[0] for line, after in zip(lines, lines[1:]) if line.startswith("Exchange")}
    assert below == {"MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow"}
