"""The filter audit against a plain loop over documents and orders."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sigspark.llm import filter_audit

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def fails(docs):
    smallest = {}
    for i, t, *_ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, *_ in docs:
        t = t or ""
        w = WORDS.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        out.append({k for k, b in bad.items() if b})
    return out


def brute(docs, labels):
    good, toxic = ({i for i, q, x in labels if v(q, x) and i is not None} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    bad, rows = fails(docs), {}
    for part in {d[3] or "" for d in docs}:
        mine = [(d[0], b) for d, b in zip(docs, bad) if (d[3] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                rows[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def got(docs, labels):
    rows = filter_audit.audit_texts(docs, labels).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): list(r[3:]) for r in rows}


TEXTS = ["plain words of a text that is long enough " + " ".join(f"w{k}" for k in range(60)), "SHOUT " * 60, "too short", "has a # sign " + " ".join(f"v{k}" for k in range(60)), "same same " * 40, None, "", "A", "MANY CAPS IN A LONG TEXT # " + " ".join(f"X{k}" for k in range(60))]


def test_against_a_loop(spark, table):
    docs = [(i, TEXTS[i * 7 % len(TEXTS)] if i % 5 else TEXTS[i % 3], None, (None, "", "a", "b")[i % 4]) for i in range(60)] + [(3, TEXTS[0], None, "a"), (3, TEXTS[0], None, "a"), (3, "other", None, "b"), (None, TEXTS[0], None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(1, None, 1), (1, 1, None), (None, 1, 1), (999, 1, 1)]
    assert got(table(docs), spark.createDataFrame(labels, LABELS)) == brute(docs, labels)


def test_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, None, None)], LABELS)
    want = brute(ODD, [(4, 1, 0), (6, 0, 1)])
    assert got(odd, labels) == want == got(clashing, labels.withColumn("part", F.lit("x")).withColumn("n", F.lit(7)))
    assert got(empty, labels) == {}
    assert got(odd, labels.limit(0)) == brute(ODD, [])


def test_joins_and_no_python_in_the_plan(spark, table):
    docs = table([(i, f"text {i % 3}", None, "a") for i in range(20)])
    rows = filter_audit.keyed(docs, "text", "source", "doc_id")
    failing = {k: filter_audit.stored(rows.filter(k), k) for k in "ABCD"} | {"E": filter_audit.stored(filter_audit.repeats(rows), "E")}
    assert failing["E"].count() == 17 and failing["A"].count() == 20
    labelled = filter_audit.labelled(rows, spark.createDataFrame([], LABELS))
    assert filter_audit.removals(labelled, failing).filter("filter = 'A' AND before = 0").first().removed == 20


def test_other_numbers_of_filters(spark):
    keys = spark.createDataFrame([(i, i, "p", 1, 0, 0) for i in range(10)], "_id long, _h long, part string, n long, good long, toxic long")
    failing = {"X": keys.filter("_id < 4").select("_id", "_h"), "Y": keys.filter("_id % 2 = 0").select("_id", "_h")}
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(keys, failing).collect()}
    assert rows == {("XY", 1): (6, 4, 0, 2, 6), ("XY", 2): (3, 3, 2, 3, 8), ("YX", 1): (5, 5, 0, 3, 8), ("YX", 2): (3, 2, 2, 2, 6)}


@pytest.mark.parametrize("text,letters", [("x " * 49, "ABD"), (" ".join(f"w{k}" for k in range(50)), "")])
def test_limits(spark, text, letters):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in filter_audit.text_filters(F.col("t")).items()]).first()
    assert {k for k in "ABCD" if row[k]} == set(letters) - {"D"}
