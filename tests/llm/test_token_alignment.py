"""Token alignment against the tokenizers' own libraries and a plain loop, and the spill counting against sorting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigspark.llm import token_alignment as ta
from sigspark.llm.queries import op11_spill_counted_alignment

from .conftest import ODD

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    back = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for x in range(256):
        if x not in back.values():
            back[chr(256 + len(back) - 188)] = x

    def a_bytes(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        full = (" " + text).encode()
        x = [(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, b_bytes(i)) for i in b.encode(text)]
        return (x, y) if b"".join(t for _, t in x) == full == b"".join(t for _, t in y) else ([], [])

    return tokens


def brute(tokens, texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups for every text."""
    links, out = [], []
    for text in texts:
        x, y = tokens(text)
        ends = []
        for side in (x, y):
            at, places = 0, {}
            for k, (i, t) in enumerate(side):
                at += len(t)
                places[at] = (k, i)
            ends.append(places)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links.append([(ends[0][e][1], ends[1][e][1]) for e in shared])
        groups, p, q = [], 0, 0
        for e in shared:
            k, m = ends[0][e][0] + 1, ends[1][e][0] + 1
            groups.append(",".join(str(i) for i, _ in x[p:k]) + "|" + ",".join(str(i) for i, _ in y[q:m]))
            p, q = k, m
        out.append([len(x), len(y), len(groups), len(links[-1]), 0, 0, ";".join(groups)])
    count = Counter(p for one in links for p in one)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    for row, one in zip(out, links):
        row[4:6] = sum(count[p] == top[p[1]] for p in one), sum(count[p] for p in one)
    return [tuple(r) for r in out]


def got(df, **more):
    return sorted(ta.align(df, *FILES, **more).collect(), key=str)


RNG = random.Random(11)
TEXTS = [None, "", " ", "one", "  two  spaces ", "a\nb\t\tc", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ already there", "é" * 40, "字符 and 🎉", "I'll 12345 don't", "x\x1cy\x00z", "word " * 300, "ﬁ Å   nbsp"]
TEXTS += ["".join(RNG.choices("abcdeé 12\n'.,字 tion er the", k=RNG.randint(0, 120))) for _ in range(80)] + ["the same text"] * 6


def test_against_a_loop(table, tools):
    want = sorted(((i, *r) for i, r in enumerate(brute(tools, TEXTS))), key=str)
    rows = table(list(enumerate(TEXTS)))
    for more in ({}, {"radixes": 3, "fan": 2}, {"radixes": 1}):
        assert [tuple(r) for r in got(rows.repartition(7), **more)] == want
    assert any(w[5] < w[4] for w in want) and any(w[3] > 5 for w in want)


def test_every_letter_below_the_settled_limit(tools):
    pair = ta.TokenPair.of(*FILES)
    chars = [chr(c) for c in range(0x250)]
    texts = ["".join(RNG.sample(chars, 60)) for _ in range(200)] + [f"a{c}{c} {c}b" for c in chars]
    ids, at = pair.encode_a([" " + t for t in texts])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == pair.library(" " + t).tolist(), t


def test_query_on_whole_documents(spark, tools):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op11_spill_counted_alignment(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for i, want in zip(docs, brute(tools, docs.values())):
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6]
        assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")


def test_odd_rows(odd, empty, clashing, tools):
    rows = got(odd)
    assert rows == got(clashing) and got(empty) == []
    assert sorted(map(str, rows)) == sorted(str(type(rows[0])(*((i, *r)))) for (i, *_), r in zip(ODD, brute(tools, [t for _, t, *_ in ODD]))) or sorted(tuple(map(str, r)) for r in rows) == sorted(tuple(map(str, (i, *r))) for (i, *_), r in zip(ODD, brute(tools, [t for _, t, *_ in ODD])))


def test_pair_table(spark, table, tools):
    docs = table(list(enumerate(TEXTS)))
    blocks, runs, n = ta.blocks_of(docs.repartition(9), *FILES, "text", "doc_id", 4, True)
    count = Counter({(r.a_id, r.b_id): r.links for r in ta.pair_table(ta.count_pairs(runs, n, 3)[1]).collect()})
    assert sum(count.values()) == sum(r[3] for r in brute(tools, TEXTS))
    best = {(r.a_id, r.b_id) for r in ta.pair_table(ta.count_pairs(runs, n, 3)[1]).filter("best").collect()}
    assert best == {p for p, c in count.items() if c == max(d for q, d in count.items() if q[1] == p[1])}


def test_merging_runs(monkeypatch):
    monkeypatch.setattr(ta, "CHUNK", 7)
    rng = np.random.default_rng(4)
    for k in (1, 2, 5, 16):
        runs, want = [], Counter()
        for _ in range(k):
            keys = np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64) << np.uint64(22))
            values = rng.integers(1, 5, len(keys)).astype(np.uint64)
            want.update(dict(zip(keys.tolist(), values.tolist())))
            runs.append(ta.spilled([(keys, values)]))
        chunks = list(ta.merged(runs))
        flat = {int(a): int(b) for keys, values in chunks for a, b in zip(keys, values)}
        assert flat == dict(want) and all((np.diff(c[0].astype(np.int64)) > 0).all() for c in chunks)
        top = defaultdict(int)
        for key, n in want.items():
            top[key >> 24] = max(top[key >> 24], n)
        marked = {int(a): int(b) for keys, values in ta.with_best(ta.merged(runs)) for a, b in zip(keys, values)}
        assert marked == {key: 2 * n + (n == top[key >> 24]) for key, n in want.items()}
    assert list(ta.merged([])) == [] and list(ta.read_run(ta.spilled([]))) == []
