import random
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers

from sigspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_that_come_again_are_not_merged_again():
    """250,000 words are what a few MB of a worker's share hold of a corpus with invented words."""
    words = packing._Words(PATH)
    rng = random.Random(1)
    many = {"".join(rng.choices("abdeiklmnorstu", k=8)) for _ in range(250_000)}
    text, made, make = " ".join(w + "," * (k % 2) for k, w in enumerate(many)), [], words.pieces.make
    words.ids(text)
    words.pieces.make = lambda p: made.append(p) or make(p)
    words.ids(text)
    assert not made


def test_words_with_marks_are_cut_as_the_tokenizer_does():
    words = packing._Words(PATH)
    rng = random.Random(2)
    odd = ["it's", "'s", "a's,", "don't!!", "x'll.", "a''", "ab's'", "é,", "a²,", "µ's...", "3,", "a3,", "a-b,", "(a)", "a_", "ª,", "'re,", "q'm'", "x\x85y,", "\xa0,a."]
    odd += ["".join(rng.choices("ab'stlredvem,.!3²é-(\" _ªµ×", k=rng.randrange(1, 9))) for _ in range(3000)]
    for text in odd:
        assert words.ids(text).tobytes()[: -np.dtype(words.kind).itemsize] == words._plain(text), text


def test_routes_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(3)
    idf, mean = rng.uniform(0, 9, 500), 40.0
    profiles = [(np.sort(rng.choice(500, n, replace=False)).astype(np.uint16), rng.integers(1, 400, n)) for n in (1, 3, 4, 60, 200, 2)]
    for row, (terms, times) in zip(packing.routes(profiles, idf, mean), profiles):
        assert row.tolist() == packing.route(terms, packing.bm25(terms, times, idf, mean)).tolist()


def test_workers_of_the_pipeline_free_their_words(monkeypatch):
    """In every later step of packing: with 700,000 words a worker, near-dedup of a second run went beyond its memory."""
    import corpus_pipeline

    steps = []
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda *_, **named: steps.append(named))
    corpus_pipeline.windows(None, None, "")
    packing._Words.of(PATH).ids("a few words, and some more")
    assert not list(packing._later(iter, steps[0]["keep_words"])(iter([]))) and not packing._Words._made
    kept = packing._Words.of(PATH)
    list(packing._later(iter, True)(iter([])))
    assert packing._Words.of(PATH) is kept


def test_a_word_of_many_texts_is_looked_up_once(monkeypatch):
    """Not once per occurrence: looking up every word of a text took most of the query's time."""
    asked = []

    class Counted(packing._Cache):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    words = packing._Words(PATH)
    words.words = Counted(words._word, 1000)
    monkeypatch.setitem(packing._Words._made, PATH, words)
    texts = [f"Some words, some{'x' * (k % 3)} more words and ÉTÉ été" for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["doc_id", "text"])
    rows = [r for out in packing._tokenized(PATH, 2048)(iter([batch])) for r in out.to_pylist()]
    assert [r["n"] for r in rows] == [len(words._plain(t)) // 2 + 1 for t in texts]
    assert sorted(asked) == sorted({w for t in texts for w in t.lower().split()})


def test_texts_of_a_batch_have_the_ids_of_each(monkeypatch):
    """Texts that the tokenizer splits itself stand between others, nulls and empty texts touch, and many steps are made."""
    rng = random.Random(4)
    alphabet = list("abcXYZ'.,!?0 \n\t\x1c\x85\xa0éÉ×ÞßµªÀ÷ſ字☃") + [" the", " The", "don't", " <|EndOfText|> "]
    texts = [None, "", " ", "\xa0", "Ü", "Â", "a", "ÃÀ Â\xa0Â\x85", *("".join(rng.choices(alphabet[: 20 + k % 30], k=rng.choice((0, 3, 40, 400)))) for k in range(600)), " x" * 700, None]
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), column], ["doc_id", "text"])
    for step, window in ((1, 2048), (5000, 16), (4 << 20, 64)):
        monkeypatch.setattr(packing, "_STEP", step)
        rows = [r for out in packing._tokenized(PATH, window)(iter([batch])) for r in out.to_pylist()]
        assert [r["doc_id"] for r in rows] == list(range(len(texts)))
        words = packing._Words.of(PATH)
        for text, row in zip(texts, rows):
            ids = np.append(np.frombuffer(words._plain(text or ""), np.uint16), np.uint16(1))
            whole = len(ids) // window * window
            terms, times = np.unique(ids, return_counts=True)
            assert row["n"] == len(ids) and row["rest"] == ids[whole:].tobytes() and row["terms"] == terms.tobytes(), text
            assert row["crcs"] == [zlib.crc32(ids[k : k + window].astype("<u4").tobytes()) for k in range(0, whole, window)]
            assert row["times"] == times.astype("<u4" if times.max() > 255 else np.uint8).tobytes()


def test_weights_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(5)
    idf, mean = rng.uniform(0, 9, 500), 40.0
    profiles = [(np.sort(rng.choice(500, n, replace=False)).astype(np.uint16), rng.integers(1, 400, n)) for n in (1, 3, 60, 200, 2)]
    sizes, terms, weights = packing._weights(profiles, idf, mean)
    assert sizes.tolist() == [1, 3, 60, 200, 2] and terms.tolist() == [t for p, _ in profiles for t in p]
    assert weights.tolist() == [w for p in profiles for w in packing.bm25(*p, idf, mean)]


def test_many_words_take_little_memory():
    """As strings and bytes in a dictionary a word took 136 bytes, and the pipeline's executors went beyond their memory."""
    words = [f"word{k * 7919:x}" for k in range(250_000)]
    packing._Cache(lambda w: b"", 9).many(pa.array(["x"], pa.large_string()))  # what Arrow imports on first use is not the cache's
    tracemalloc.start()
    try:
        cache = packing._Cache(lambda w: b"123456", 250_000)
        for k in range(0, len(words), 50_000):
            cache.many(pa.array(words[k : k + 50_000], pa.large_string()))
        taken = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(cache) == len(words) and taken < 60 * len(words)


def test_a_cache_gives_what_is_made_of_each_word():
    """One at a time or together, kept or beyond the cache's size, and where hashes and slots meet."""

    class Same(str):  # three hashes for all words
        def __hash__(self):
            return len(self) % 3

    rng, made = random.Random(6), []
    cache = packing._Cache(lambda w: made.append(w) or w[::-1].encode(), 40)
    for _ in range(300):
        some = sorted({"".join(rng.choices("aé☃", k=rng.randrange(6))) for _ in range(rng.randrange(12))})
        assert cache.many(pa.array(some, pa.large_string())).to_pylist() == [w[::-1].encode() for w in some]
        for w in some:
            assert cache[w] == w[::-1].encode() and cache.get(w) in (None, w[::-1].encode())
    assert len(cache) == 40 and sum(made.count(w) == 1 for w in set(made)) >= 40
    same = packing._Cache(lambda w: w.encode() * 2, 40)
    for w in map(Same, ["a", "b", "ab", "bc", "abc", "", "b", "ab", "bc", "a"]):
        assert same[w] == w.encode() * 2
    assert len(same) == 3


def test_words_freed_are_gone():
    """Words and their caches refer to each other: a worker kept all of them until the next full collection, if one came."""
    gone = weakref.ref(packing._Words.of(PATH))
    packing._Words.forget()
    assert gone() is None
