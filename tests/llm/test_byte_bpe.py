"""Byte-level BPE against the tiktoken library, ids and bytes, and the perfect hash by its definition."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import byte_bpe
from sigspark.llm.queries import op12_perfect_hash_bpe

from .conftest import ODD

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return byte_bpe.Vocabulary.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def both(df):
    tokens = byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return byte_bpe.decode(tokens, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        index = byte_bpe.PerfectHash(keys)
        assert sorted(index(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([1, 1], np.uint64))


def test_every_entry_is_resolved_whole_and_no_other_string_is(known):
    assert (known.whole(known.words, known.starts, known.sizes) == np.arange(len(known.sizes))).all()
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab e\xc3\xa9\x00", k=rng.randint(1, 20))) for _ in range(3000)]
    joined, sizes = b"".join(strings), np.array([*map(len, strings)])
    got = known.whole(byte_bpe.Words(joined), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [known.ranks.get(s, -1) for s in strings]


def test_equals_tiktoken_on_odd_texts(known, plain):
    rng = random.Random(5)
    texts = ["", " ", "\n\n  \n x", "a" * 3000, " " * 5000 + "b", "é" * 700, "<|endoftext|>", "I'll it's 12345 3.14 don't\t\ttabs", " x y\x1cz", "字符 🎉🎉 🎉 family 👨‍👩‍👧", "ſ K", "-" * 400 + "=" * 129]
    texts += ["".join(rng.choices("abcdeé 12\n'.,字 tion er", k=rng.randint(0, 200))) for _ in range(300)]
    ids, at = known.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode_ordinary(t), t
    assert known.decode(ids.astype(np.int64)).tobytes() == "".join(texts).encode()


def test_the_second_tier_gives_the_entries_themselves(known):
    """The heap alone comes to the same ids as the perfect hash for entries that the merges reach."""
    for entry in list(known.ranks)[256:4000:17]:
        assert np.frombuffer(known.merged(entry), "<u4").tolist() == [known.ranks[entry]], entry


def test_query_equals_tiktoken_on_whole_documents(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_perfect_hash_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode_bytes(ids)).hexdigest() == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd, empty, clashing, plain):
    got = sorted(both(odd), key=str)
    assert got == sorted(both(clashing), key=str) and len(got) == len(ODD) and both(empty) == []
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in got) == sorted((str(i), len(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in ODD)


def test_decode_keeps_other_columns_and_takes_null(spark):
    rows = spark.createDataFrame([(1, "k", bytearray(np.array([0, 1], "<u4").tobytes())), (2, None, None)], "a int, decoded string, ids binary").withColumn("_ids", F.lit(1))
    got = byte_bpe.decode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("a").collect()
    assert [bytes(r.decoded) for r in got] == [b'!"', b""] and got[0]["_ids"] == 1


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary([bytes([b]) for b in range(255)], r".")
