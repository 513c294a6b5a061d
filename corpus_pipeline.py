"""A corpus pipeline: language, exact copies, near copies, source mix, packed windows.

Each stage reads the whole table its predecessor left and returns the columns of ``documents``; the last returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigspark.llm import exact_dedup, language_id, mixing, packing, wide_simhash
from sigspark.llm.common import shared_dir, table
from sigspark.llm.queries import held_out, tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: no text, no letter, or too few n-grams of any known language."""
    model = language_id.train(docs.filter(~held_out("doc_id", 4, 2)))
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("known") >= language_id.LEAST_KNOWN)).select("_row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word Jaccard 0.8 or more, found by wide SimHash: the smallest id."""
    return wide_simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them: as many copies as its taken words make whole documents, rounded."""
    return mixing.repeat_as_taken(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training windows, a row per piece. Workers free their words, which the next run's stages would
    have to live beside."""
    return packing.pack(docs, tokenizer_file(), keep_words=False)


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("source mix", source_mix), ("packing", windows)]

#: Language filters, fingerprints and tokens are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
