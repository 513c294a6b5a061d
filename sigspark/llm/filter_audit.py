"""Filter interaction audit on relations of failing ids.

Every filter is one stored table of the ids that fail it. What a filter removes after a set of others is a left-semi join of
the documents with its own table, once for each set, followed by a left-anti join with the table of every filter in that
set. Only sets matter, not their order, so five filters need 5 x 16 counts and not 120 x 5; orders are read off a small
table at the end. Rows are 8-byte keys: documents and tables are dealt out by the key once and every join reuses that.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, cut_lineage, join_hot, shared_dir

KEY = ["_id", "_h"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, for what a text alone decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {"A": n < 50, "B": F.size(F.array_distinct(words)) * 100 < n * 65, "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 5, "D": text.rlike("[#$%&*|]")}


def keyed(docs: DataFrame, text: str, part: str, id_column: str) -> DataFrame:
    """_id, _h, part, _digest and a column per letter, for every row. A row's key is its id and a hash of its text, as rows
    that repeat an id may differ in text; a null id is 0 with another hash."""
    rows = docs.select(F.col(id_column).cast("long").alias("_own"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    key = [F.coalesce("_own", F.lit(0)).cast("long").alias("_id"), F.xxhash64(F.col("_own").isNull(), "_t").alias("_h")]
    return cut_lineage(rows.select("_own", *key, "part", F.unhex(F.sha2("_t", 256)).alias("_digest"), *[c.alias(k) for k, c in text_filters(F.col("_t")).items()]))


def repeats(rows: DataFrame) -> DataFrame:
    """Keys of rows whose text a smaller id has too. A null id has none smaller and is none."""
    own = rows.filter(F.col("_own").isNotNull())
    first = own.groupBy(F.col("_digest").alias("_of")).agg(F.min("_own").alias("_first"), F.max("_own").alias("_last")).filter("_first < _last")
    return join_hot(own, "_digest", first.drop("_last"), "_of").filter("_own > _first").select(*KEY)


def stored(table: DataFrame, name: str) -> DataFrame:
    """An id table in the shared folder."""
    at = f"{shared_dir(table.sparkSession)}/failing-{name}-{uuid.uuid4().hex}"
    table.select(*KEY).write.parquet(at)
    return table.sparkSession.read.parquet(at)


def labelled(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """_id, _h, part, n, good, toxic: alike rows as one, with how many there are and how many of them are labelled so. Of
    several labels of an id any one counts."""
    marks = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("_labelled"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    alike = rows.groupBy("_own", *KEY, "part").agg(F.count("*").alias("n"))
    both = alike.join(marks, F.col("_own") == F.col("_labelled"), "left")
    return cut_lineage(both.select(*KEY, "part", "n", *[(F.coalesce(f"_{c}", F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")]))


def removals(docs: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """part, filter, before, removed, good_lost, toxic_lost: what each filter removes of what is left by every set of the
    others. ``before`` has bit k for the k-th filter; sets that leave nothing to remove have no row."""
    dealt = docs.repartition(*KEY)
    tables = {k: t.select(F.col("_id").alias(f"_id{k}"), F.col("_h").alias(f"_h{k}")) for k, t in failing.items()}
    on = {k: (F.col("_id") == F.col(f"_id{k}")) & (F.col("_h") == F.col(f"_h{k}")) for k in failing}
    bit = {k: 1 << i for i, k in enumerate(failing)}
    parts = []
    for k in failing:
        sets = [s for s in range(1 << len(failing)) if not s & bit[k]]
        left = dealt.join(tables[k], on[k], "left_semi").withColumn("before", F.explode(F.array(*map(F.lit, sets))))
        for other in failing:
            if other != k:
                left = left.join(tables[other], on[other] & (F.col("before").bitwiseAND(bit[other]) != 0), "left_anti")
        sums = [F.sum(c).alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
        parts.append(left.groupBy("part", "before").agg(*sums).withColumn("filter", F.lit(k)))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def orders(docs: DataFrame, letters: str) -> DataFrame:
    """filter_order, step, filter, before: as many rows as there are orders times filters, whatever the input."""
    rows = [("".join(o), step, f, sum(1 << letters.index(x) for x in o[: step - 1])) for o in permutations(letters) for step, f in enumerate(o, 1)]
    return docs.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def audit(docs: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for documents with a
    key, part, n, good and toxic, and an id table per filter (a letter each, at most six)."""
    letters = "".join(failing)
    found = removals(docs, failing)
    every = orders(docs, letters)
    totals = docs.groupBy("part").agg(F.sum("n").alias("_all"))
    # Every part with every slot, zeros included: the slots of a part are exploded, not joined.
    cells = [F.struct(F.lit(f).alias("filter"), F.lit(s).alias("before")) for i, f in enumerate(letters) for s in range(1 << len(letters)) if not s >> i & 1]
    full = totals.select("part", "_all", F.explode(F.array(*cells)).alias("_c")).select("part", "_all", "_c.*")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("removed", "good_lost", "toxic_lost")}
    full = full.join(found, ["part", "filter", "before"], "left").withColumns(zero)
    own = W.partitionBy("part", "filter")
    # After no other filter a filter removes all that fail it; after all others what fails nothing else.
    at_first, at_last = F.min_by("removed", "before").over(own), F.max_by("removed", "before").over(own)
    full = full.withColumns({"redundant": at_first - F.col("removed"), "unique_fails": at_last})
    times = every.groupBy("filter", "before").agg(F.count("*").alias("_times"))
    full = full.join(times, ["filter", "before"]).withColumn("shapley", F.sum(F.col("removed") * F.col("_times")).over(own)).drop("_times")
    steps = full.join(every, ["filter", "before"])
    so_far = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("kept", F.col("_all") - so_far).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_texts(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The audit of filters A to E over ``docs``, for every part, order of the filters and step.

    A: under 50 words; B: distinct words under 65 %; C: over 5 % of the code points are A to Z; D: holds one of #$%&*|;
    E: a smaller id has the same text. A null text is empty, a null part is the empty string. Rows that repeat an id and a
    text are as many documents; rows that repeat an id with other texts are judged one by one. A document without an id
    never fails E, makes none fail it, and has no labels. An empty table gives no rows; without labels nothing counts as
    lost. Columns other than the three named are not read.
    """
    rows = keyed(docs, text, part, id_column)
    failing = {k: stored(rows.filter(k), k) for k in "ABCD"} | {"E": stored(repeats(rows), "E")}
    return audit(labelled(rows, labels), failing)
