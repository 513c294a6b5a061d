import pytest
from pyspark.sql import SparkSession, types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


@pytest.fixture
def table(spark):
    """(doc_id, text[, lang[, source]]) rows as a table like ``documents``."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in full], SCHEMA)

    return make


#: Nulls in every column, empty and blank texts, repeated rows, a repeated id, and a long text.
ODD = [
    (None, None, None, None), (1, None, "en", None), (2, "", None, "a"), (3, " \t\n ", "en", "a"), (4, "one", "de", "b"), (4, "one", "de", "b"), (4, "two words", "de", "b"),
    (5, "Ünïcødé 字 words and ſigns ☃ " * 20, "de", "c"), (6, "many words of the same kind " * 20000, "en", "c"), (None, "no id here but some text", "en", "c"), (7, "x" * 5000, "en", "a"),
]


@pytest.fixture
def odd(table):
    return table(ODD)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(table):
    """Extra columns named like those that the operators add or use."""
    from pyspark.sql import functions as F

    docs = table(ODD)
    for name in ("kept", "keep_id", "size", "block", "score", "lang_pred", "print", "n_words", "sid", "shard", "features", "key", "_hash", "text_sha256"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
