import re
import zlib
from collections import Counter

import corpus_pipeline
from .conftest import ODD
from .test_wide_simhash import least_of_components

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.collect()
    kept = stage("language ID")(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}
    docs = spark.createDataFrame(kept, docs.schema)
    kept = stage("exact dedup")(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.text: r.doc_id for r in sorted(docs.collect())}.values())
    docs = spark.createDataFrame(kept, docs.schema)
    least = least_of_components([(r.doc_id, r.text) for r in kept])  # five words, Jaccard of 0.8 or more
    kept = stage("SimHash near-dedup")(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == least
    docs = spark.createDataFrame(kept, docs.schema)
    mixed = stage("source mix")(spark, docs, "")
    assert mixed.columns == DOCUMENTS
    rows = mixed.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept} and max(Counter(r.doc_id for r in rows).values()) <= 3
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert abs(sum(map(words, rows)) / sum(map(words, kept)) - 1) < 0.25
    pieces = stage("packing")(spark, mixed, "").collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in rows)


def test_odd_rows_run_through(spark, table, empty):
    for docs in (table(ODD), empty):
        for name, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, "")
            assert docs.columns == DOCUMENTS, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert bool(pieces) == bool(docs.count())
