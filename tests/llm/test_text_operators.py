"""Brute-force, round-trip and held-out checks of the operators whose results SQL does not express, and odd rows for all."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import exact_dedup, language_id, mixing, packing, pii, quality_classifier, quality_rules
from sigspark.llm.queries import held_out, tokenizer_file

from .conftest import ODD

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return str(tuple(row))


# Quality rules


def quality_brute(text):
    w = WORDS.findall(text or "")
    grams = lambda n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    def covered(n, first_too=False):
        all_of, seen, inside = Counter(grams(n)), set(), set()
        for i, g in enumerate(grams(n)):
            if g in seen or first_too and all_of[g] > 1:
                inside |= set(range(i, i + n))
            seen.add(g)
        return inside

    lines = Counter(x for x in (text or "").split("\n") if WORDS.search(x))
    chars = lambda i: len(w[i])
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": sum(lines.values()) - len(lines), "n_repeat_words": len(covered(3, True))}
    out["dup_line_chars"] = sum((k - 1) * sum(map(len, WORDS.findall(x))) for x, k in lines.items())
    out |= {f"dup_{n}gram_chars": sum(map(chars, covered(n))) for n in quality_rules.NGRAM_LIMITS}
    return out


def test_quality_rules_against_brute_force(table):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab cd é x* y%\n z".split(" "), k=rng.randint(0, 90))) for _ in range(120)]
    texts += ["\n\na\n a\na\n\n", "line one\nline one\nline one", "a b c a b c", "\n", "a b c", "x\x1cy"]
    for r in quality_rules.repetition_rules(table(list(enumerate(texts)))).collect():
        assert {k: r[k] for k in quality_brute("")} == quality_brute(texts[r.doc_id]), texts[r.doc_id]


def test_quality_rules_odd_rows(odd, empty, clashing):
    got = sorted(quality_rules.repetition_rules(odd).collect(), key=key)
    assert len(got) == len(ODD) and got == sorted(quality_rules.repetition_rules(clashing).collect(), key=key)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality_rules.repetition_rules(empty).collect() == []


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        found = []
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append(m.span())
        out[kind] = found
    return out


def test_base_spans_equal_the_patterns():
    anchors, rng = pii._automaton(), random.Random(8)
    pieces = ["a@b.co", "@", "x.y_z%+-@h-o.s.t", ".", "1.2.3.4", "300.1.1.1", "1.1.1.1.1.1.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "+", "5", " ", "-", "é", "--", "  ", "+12", "()", "word", "4111-1111-1111-1111-1", "\n", "0000.1.2.3", "a@b", "@c.d"]
    for _ in range(20000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 9)))
        found = pii.spans(text, anchors)
        assert {k: found[k] for k in PATTERNS} == base_brute(text), text


def test_base_spans_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        base = base_brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)


def test_added_spans():
    find = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.spans(t, pii._automaton()).items() if v}
    assert find("see https://user@host.example.org:80/p?q=1, ok")["url"] == ["https://user@host.example.org:80/p?q=1"]
    assert find("IBAN: GB82 WEST 1234 5698 7654 32 and")["account"] == ["GB82 WEST 1234 5698 7654 32"]
    assert "account" not in find("IBAN: GB82 WEST 1234 5698 7654 33")
    assert find("SSN 123-45-6789")["account"] == ["123-45-6789"]
    assert find('token = "2321bac4d15ec8f9"')["account"] == ["2321bac4d15ec8f9"]
    assert find("the token of my account was kept") == {} == find("http:// no host")


def test_redaction_and_odd_rows(odd, empty, clashing, table):
    got = sorted(pii.find_personal_data(odd).collect(), key=key)
    assert len(got) == len(ODD) and got == sorted(pii.find_personal_data(clashing).collect(), key=key)
    assert pii.find_personal_data(empty).collect() == []
    cleaned = {r.doc_id: r.text for r in pii.redact(table([(1, "mail a.b@c.de or +1 (555) 010-9999!"), (2, None), (3, "none")])).collect()}
    assert cleaned == {1: "mail <email> or <phone>!", 2: None, 3: "none"}


# Exact copies


@pytest.mark.parametrize("bits", [1 << 18, exact_dedup.MAX_BITS])
def test_exact_duplicates(odd, clashing, bits):
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[t or ""].append(i)
    rows = exact_dedup.mark_duplicates(odd.repartition(5), max_bits=bits).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == len(groups)
    for r in rows:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    again = exact_dedup.mark_duplicates(clashing)
    assert Counter((r.doc_id, r.keep_id, r.kept) for r in again.collect()) == Counter((r.doc_id, r.keep_id, r.kept) for r in rows)
    kept = exact_dedup.drop_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(groups)


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.mark_duplicates(empty).collect() == []


def test_filter_misses_no_repeat(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), (F.col("id") % 30000).cast("string").alias("text"))
    marked = exact_dedup.mark_duplicates(docs.repartition(9))
    assert marked.filter("group_size = 2").count() == 20000 and marked.filter("kept").count() == 30000


# Packing


def unpacked(pieces):
    out = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        out[p.doc_id].append(p)
    return out


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = Tokenizer.from_file(tokenizer_file())
    ids = {r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = packing.pack(docs, tokenizer_file()).collect()
    by_doc = unpacked(pieces)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for p in parts:
            assert p.start == at and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW and at & (at - 1) == 0


def test_packing_brings_alike_documents_together(table):
    rng = random.Random(1)
    topics = [[f"{chr(97 + t)}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}zq" for _ in range(40)] for t in range(4)]
    docs = table([(i, " ".join(rng.choices(topics[i % 4], k=120))) for i in range(60)])
    pieces = packing.pack(docs, tokenizer_file()).collect()
    together = defaultdict(Counter)
    for p in pieces:
        together[p.sequence_id][p.doc_id % 4] += p.length
    assert sum(max(c.values()) for c in together.values()) > 0.8 * sum(sum(c.values()) for c in together.values())


def test_packing_odd_rows(odd, empty, clashing):
    got = packing.pack(odd, tokenizer_file(), with_ids=True)
    assert sum(r.length for r in got.collect()) == sum(r.doc_tokens for r in got.filter("start = 0").collect())
    assert got.filter("start = 0").count() == len(ODD) == packing.pack(clashing, tokenizer_file()).filter("start = 0").count()
    assert packing.pack(empty, tokenizer_file()).collect() == []


def test_word_cache_equals_the_tokenizer():
    words, rng = packing._Words.of(tokenizer_file()), random.Random(3)
    assert words.by_word
    alphabet = list("abcXYZ'.,!?%*0123 \n\t\x1c\x85\xa0éÉßµªº²½İıſﬁ字☃é") + ["'ll", "n't", "don't", "é́"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert words.ids(text)[:-1].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


# Language


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language_id.train(docs.filter("NOT held_out"))
    rows = language_id.identify(docs.filter("held_out"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_filter_returns_every_language_of_an_ngram():
    rng = np.random.default_rng(0)
    grams, codes = rng.integers(0, 1 << 32, 3000), rng.integers(0, 70, 3000)
    f = language_id.Filter([f"l{i:02}" for i in range(70)], [1] * 70, grams, codes)
    places = f._places(grams.astype(np.uint64))
    for i, c in enumerate(codes):
        plane = f.planes[c // 64]
        assert all(int(plane[p[i]]) >> int(c % 64) & 1 for p in places)


def test_language_odd_rows(odd, empty, clashing):
    for docs in (odd, clashing):
        rows = language_id.identify(docs, language_id.train(docs)).collect()
        assert len(rows) == len(ODD) and all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in rows)
        assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows)
    nothing = language_id.train(empty)
    assert language_id.identify(empty, nothing).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


# Mixing


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    laid, pieces = mixing.schedule(docs, block_words=64)
    rows = mixing.mix(docs, block_words=64).collect()
    by_source, target = Counter(), {}
    for r in rows:
        by_source[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for s, t in target.items():  # the points of a golden-ratio sequence in an interval are off by a few, here blocks of 64 words
        assert abs(by_source[s] - t) <= 2 * 64, s
    assert abs(sum(by_source.values()) - sum(target.values())) <= 4 * 64
    assert sorted(map(key, mixing.mix(docs.repartition(7), block_words=64).collect())) == sorted(map(key, rows))
    assert sum(r.n_slots for r in rows) == pieces.count() and all((r.first_slot is None) == (r.taken == 0) for r in rows)
    order = [r.sid for r in pieces.groupBy("slot").agg(F.max("sid").alias("sid")).orderBy("slot").collect()]
    share = Counter(order)
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[s] - share[s] / 2) <= 8 for s in share)  # the schedule is even all along


def test_the_schedule_decides_what_is_taken(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    golden = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "_GOLDEN", 1)  # all slots near point 0: the first source's alone
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} != golden


def test_places_of_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_FAN", 5)
    rows = [(s, k, (7 * k + s) % 11) for s in range(3) for k in range(0, 40, s + 1)]
    got = {(r.s, r.k): r.before for r in mixing._before(spark.createDataFrame(rows, "s int, k long, n long"), ["s"], "k", "n").collect()}
    assert got == {(s, k): sum(n for t, j, n in rows if t == s and j < k) for s, k, _ in rows}


def test_repeated_rows_are_taken_in_turn(table):
    rows = [(7, "same words here", "en", "a")] * 9 + [(None, "no id", "en", "a")] * 5 + [(8, "w " * 30, "en", "b")]
    got = mixing.mix(table(rows), block_words=4).collect()
    assert len(got) == 15 and all(0 <= r.taken <= 3 * r.size for r in got)
    target = {r.source: r.target for r in got}
    assert all(abs(sum(r.taken for r in got if r.source == s) - t) <= 8 for s, t in target.items())


def test_mix_of_one_large_and_small_sources(table):
    rows = [(i, "w " * 50, "en", "big") for i in range(60)] + [(100 + i, "w w", "en", f"s{i}") for i in range(4)] + [(200, None, "en", "none"), (201, "w", None, None)]
    got = mixing.mix(table(rows)).collect()
    size = Counter()
    for r in got:
        size[r.source] += r.size
    assert all(r.target <= 3 * size[r.source] for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(size.values())) < 1e-6
    assert {r.doc_id: r.taken for r in got}[200] == 0


def test_mix_odd_rows(odd, empty, clashing):
    got = sorted(mixing.mix(odd).collect(), key=key)
    assert len(got) == len(ODD) and got == sorted(mixing.mix(clashing).collect(), key=key)
    assert mixing.mix(empty).collect() == [] == mixing.repeat_as_taken(empty).collect()
    assert mixing.repeat_as_taken(clashing).columns == clashing.columns


# Quality classifier


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_classifier.score(docs, labels.filter(~held_out("doc_id", 5, 0)))
    held = rows.join(labels, "doc_id").filter(held_out("doc_id", 5, 0)).collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (4000, 5))
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality_classifier.Network(x[:3000], y[:3000]).probability(x[3000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        some = (p >= low) & (p < low + 0.25)
        assert abs(p[some].mean() - y[3000:][some].mean()) < 0.12


def test_classifier_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, 0), (7, 1), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    got = sorted(quality_classifier.score(odd, labels).collect(), key=key)
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(quality_classifier.score(clashing, labels).collect(), key=key)]
    assert quality_classifier.score(empty, labels).collect() == []
    assert {r.score for r in quality_classifier.score(odd, labels.filter("false")).collect()} == {0.5}
