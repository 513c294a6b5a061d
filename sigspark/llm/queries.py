"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, exact_dedup, filter_audit, language_id, lm_scoring, mixing, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_alignment
from .common import table


def op1_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.repetition_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[c for c in found.columns if c.startswith("dup_")])


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("log10_score", "mean_log10")})


def op4_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_two_pass_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def held_out(id_column: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is always held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(True))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language_id.train(docs.filter("NOT held_out"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op8_low_discrepancy_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    return quality_classifier.score(docs, labels).withColumn("held_out", held_out("doc_id", 5, 0))


def op10_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spill_counted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    return token_alignment.align(table(spark, sf_dir, "documents"), known.path("byte_bpe_50k.json"), known.path("piece_bpe_32k.model"), known.PATTERN, digest=True)


def op12_perfect_hash_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.decode(tokens, ranks, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_failing_id_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_difference_cover, op2_repetition_coverage, op3_stupid_backoff, op4_anchor_expansion, op5_two_pass_bloom, op6_lexical_packing, op7_language_bitmask_filters, op8_low_discrepancy_schedule, op9_random_indexing, op10_bit_sliced_simhash, op11_spill_counted_alignment, op12_perfect_hash_bpe, op13_failing_id_relations)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

_LIMITS = " AND ".join(["100 * dup_line_chars <= 20 * word_chars", *(f"100 * dup_{n}gram_chars <= {p} * word_chars" for n, p in quality_rules.NGRAM_LIMITS.items())])
_GRAMS = quality_rules.NGRAM_LIMITS

ORACLE = {
    "op2_repetition_coverage": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
w AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM l),
g AS (SELECT r, i, n, length(word) AS c, word, {", ".join(f"CASE WHEN i + {k - 1} <= n THEN concat_ws(' ', {', '.join(f'lead(word, {j}) OVER p' if j else 'word' for j in range(k))}) END AS g{k}" for k in (3, *_GRAMS))}
  FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, c, g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 AS f3, {", ".join(f"g{k} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{k} ORDER BY i) > 1 AS f{k}" for k in _GRAMS)} FROM g),
v AS (SELECT r, c, {", ".join(f"max(f{k}::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS v{k}" for k in (3, *_GRAMS))} FROM f),
s AS (SELECT r, count(*) AS n_words, sum(c) AS word_chars, sum(v3) AS n_repeat_words, {", ".join(f"sum(c * v{k}) AS dup_{k}gram_chars" for k in _GRAMS)} FROM v GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
many AS (SELECT r, line, count(*) - 1 AS again FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line),
dl AS (SELECT r, sum(again) AS n_dup_lines, sum(again * length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars FROM many GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(dup_{k}gram_chars, 0)::BIGINT AS dup_{k}gram_chars" for k in _GRAMS)}
  FROM d LEFT JOIN s USING (r) LEFT JOIN dl USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_LIMITS} AS kept, dup_line_chars, {", ".join(f"dup_{k}gram_chars" for k in _GRAMS)} FROM b""",
    "op3_stupid_backoff": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
b AS (SELECT r, i, n, word, lag(word) OVER p AS prev, lag(word, 2) OVER p AS prev2, (count(*) OVER ())::DOUBLE AS total FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, n, total, count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY r, word) AS c1,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY prev, word) - count(*) OVER (PARTITION BY r, prev, word) ELSE 0 END AS c2,
  CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY prev2, prev, word) - count(*) OVER (PARTITION BY r, prev2, prev, word) ELSE 0 END AS c3 FROM b),
e AS (SELECT r, i, total - n AS others, c1, c2, c3, lag(c1) OVER p AS before1, lag(c2) OVER p AS before2 FROM c WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT *, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level, least(i, 3) AS possible FROM e),
s AS (SELECT r, CASE level WHEN 3 THEN log10(c3 / before2) WHEN 2 THEN log10(c2 / before1) WHEN 1 THEN log10(c1 / others) ELSE -log10(others + 1) END
  + log10(0.4) * (possible - greatest(level, 1)) AS s, level < possible AS back FROM f),
t AS (SELECT r, count(*) AS n, count(*) FILTER (back) AS backed, sum(s) AS total FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(backed, 0)::BIGINT AS n_backed_off, round(coalesce(total, 0), 6) + 0e0 AS log10_score, round(coalesce(total / n, 0), 6) + 0e0 AS mean_log10
FROM d LEFT JOIN t USING (r)""",
    "op5_two_pass_bloom": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_low_discrepancy_schedule": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, (sum(cap) OVER (ORDER BY cap / weight, sid ROWS UNBOUNDED PRECEDING))::BIGINT - cap AS before,
  (sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM w),
c AS (SELECT *, (total - before) * weight > cap * rest AS capped FROM l),
t AS (SELECT sid, total, source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (total - coalesce((sum(cap) FILTER (capped) OVER ())::BIGINT, 0)))::DOUBLE
  / ((sum(weight) FILTER (NOT capped) OVER ())::BIGINT)::DOUBLE END AS target FROM c),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
e AS (SELECT sid, high, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM
  (SELECT sid, floor(sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / total * {mixing._RING} + 0.5)::BIGINT AS high FROM g)),
n AS (SELECT (coalesce(max(total), 0) + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS} AS n FROM g),
pts AS (SELECT range AS slot, (range % {mixing._RING}) * {mixing._GOLDEN} % {mixing._RING} AS point FROM range((SELECT n FROM n)::BIGINT)),
hit AS (SELECT slot, sid FROM pts JOIN e ON point >= low AND point < high
  UNION ALL SELECT n + sid, sid FROM g, n WHERE goal > 0 AND sid NOT IN (SELECT sid FROM pts JOIN e ON point >= low AND point < high)),
r AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY sid) * {mixing.BLOCK_WORDS} AS won FROM hit),
p AS (SELECT row_number() OVER () AS id, doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS place FROM d),
q AS (SELECT id, doc_id, size, source_size, target, g.sid, place + k * source_size AS low, least(place + k * source_size + size, won, {mixing.MOST_REPEATS} * source_size) AS high
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN (SELECT DISTINCT sid, won FROM r) USING (sid), range({mixing.MOST_REPEATS}) AS turns(k)),
u AS (SELECT id, doc_id, size, source_size, target, greatest(0, least(high, (rank + 1) * {mixing.BLOCK_WORDS}) - greatest(low, rank * {mixing.BLOCK_WORDS})) AS words, slot
  FROM q LEFT JOIN r ON q.sid = r.sid AND size > 0 AND low < high AND rank BETWEEN low // {mixing.BLOCK_WORDS} AND (high - 1) // {mixing.BLOCK_WORDS})
SELECT doc_id, size, source_size, target, coalesce(sum(words), 0)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(slot)::BIGINT AS n_slots
FROM u GROUP BY id, doc_id, size, source_size, target""",
    "op13_failing_id_relations": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT d.doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS sig FROM d JOIN w USING (r)),
s AS (SELECT part, sig, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY part, sig),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM l v, l w, l x, l y, l z WHERE v.b + w.b + x.b + y.b + z.b = 31
  AND v.b <> w.b AND v.b <> x.b AND v.b <> y.b AND v.b <> z.b AND w.b <> x.b AND w.b <> y.b AND w.b <> z.b AND x.b <> y.b AND x.b <> z.b AND y.b <> z.b),
k AS (SELECT filter_order, step::INT AS step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS before FROM o, (SELECT range AS step FROM range(1, 6)) q),
a AS (SELECT part, filter_order, step, own, sum(CASE WHEN sig & (own + before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN sig & own <> 0 AND sig & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN sig & own <> 0 AND sig & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN sig = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN sig & own <> 0 AND sig & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN sig & own <> 0 AND sig & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a""",
}
