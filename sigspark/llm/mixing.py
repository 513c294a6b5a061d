"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule is the point ``t * golden ratio modulo 1``; mapped through the cumulative target shares it names a
source. Slots are ranked per source, and slot number k of a source takes block k of that source: its documents in md5
order, laid end to end up to three times, cut into blocks of ``BLOCK_WORDS`` words, the same for every source. What a
source gives is what its slots win. Ranks and positions are sums over small parts plus an order inside each, so no source
is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut_lineage, word_count

BLOCK_WORDS = 64
MOST_REPEATS = 3
_RING = 1 << 31
#: The golden ratio's fractional part as an odd multiple of 1 / _RING.
_GOLDEN = 1327217885
#: Places that one window orders, and parts whose sums one window adds up.
_FAN = 4096
_DOCS_PER_BUCKET = 1024
_LOOKUP_BITS = 8


def source_targets(sized: DataFrame) -> DataFrame:
    """sid, source, source_size, target, goal: one row per source, numbers only.

    Weights are 1, 2, 3, repeating over the sources by code point, null last. Sources are visited by the level at which
    they reach their cap; those that reach it before the words run out are capped, the rest share what is left by weight.
    """
    all_rows = W.partitionBy()
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy(F.col("cap") / F.col("weight"), "sid")
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    t = t.withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("long")).withColumn("cap", MOST_REPEATS * F.col("source_size"))
    t = t.withColumn("total", F.sum("source_size").over(all_rows))
    t = t.withColumn("before", F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    t = t.withColumn("left", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("capped", (F.col("total") - F.col("before")) * F.col("weight") > F.col("cap") * F.col("left"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_rows)
    sharing = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows)
    share = (F.col("weight") * (F.col("total") - spent)).cast("double") / sharing.cast("double")
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    return t.select("sid", "source", "source_size", "total", "target", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))


def _before(df: DataFrame, by: list[str], at: str, n: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over smaller ``at`` (distinct places from 0) of the same ``by``. No window holds
    more than ``_FAN`` rows but the last, which has one row per ``_FAN``."""
    part = F.floor(F.col(at) / _FAN).cast("long")
    sums = df.groupBy(*by, part.alias("_part")).agg(F.sum(n).alias("_sum"))
    sums = sums.withColumn("_lead", F.sum("_sum").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum"))
    inside = F.sum(n).over(W.partitionBy(*by, "_part").orderBy(at).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    return df.withColumn("_part", part).withColumn("_inside", inside).join(sums.drop("_sum"), [*by, "_part"]).withColumn("before", F.col("_lead") + F.col("_inside")).drop("_part", "_inside", "_lead")


def _slots(targets: DataFrame, total: int, block_words: int) -> DataFrame:
    """slot, sid, rank: which source each slot takes from, and the how-manieth slot of that source it is."""
    spark = targets.sparkSession
    n = -(-total // block_words)
    shift = 31 - _LOOKUP_BITS
    cumulative = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    edges = targets.withColumn("high", F.floor(cumulative / F.col("total") * _RING + 0.5).cast("long"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("sid")), F.lit(0))).filter("high > low")
    edges = edges.select("sid", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("part"))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", F.pmod(F.pmod(F.col("slot"), F.lit(_RING)) * _GOLDEN, F.lit(_RING)))
    slots = slots.withColumn("part", F.shiftright("point", shift)).join(edges, "part").filter("point >= low AND point < high")
    slots = slots.select("slot", "sid", F.floor(F.col("slot") / _FAN).cast("long").alias("chunk"))
    before = _before(slots.groupBy("sid", "chunk").agg(F.count("*").alias("n")), ["sid"], "chunk", "n")
    ranked = slots.withColumn("at", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(before.select("sid", "chunk", "before"), ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("before") + F.col("at")).alias("rank"))
    # A source too small to be hit by a point gets a slot after the last one.
    missed = targets.filter("goal > 0").join(before.select("sid").distinct(), "sid", "left_anti")
    return ranked.unionByName(missed.select((F.lit(n) + F.col("sid")).alias("slot"), "sid", F.lit(0).cast("long").alias("rank")))


def _laid_out(sized: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``at``: the words of the same source before this document, in md5 order. Rows alike are one row with a count
    until their places are known, so that many copies do not crowd a bucket."""
    buckets = max(1, n_docs // _DOCS_PER_BUCKET)
    alike = sized.groupBy(*sized.columns).agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    alike = alike.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 6), 16, 10).cast("long") * buckets, 24))
    sums = _before(alike.groupBy("sid", "bucket").agg(F.sum("words").alias("n")), ["sid"], "bucket", "n")
    inside = F.sum("words").over(W.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    placed = alike.withColumn("inside", inside).join(sums.select("sid", "bucket", "before"), ["sid", "bucket"])
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("at", F.col("before") + F.col("inside") + F.col("copy") * F.col("size")).select(*[c for c in sized.columns if c != "order"], "at")


def schedule(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(laid, pieces). laid: a row per document with sid, doc_id, size, source_size, target, goal and its place ``at``.
    pieces: slot, sid, at, start, length: the words of the document at that place which a slot takes."""
    order = F.md5(F.coalesce(F.col(id_column).cast("string"), F.col(text), F.lit("")))
    sized = cut_lineage(docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("order")))
    n_docs, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = cut_lineage(source_targets(sized))
    known = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "total")
    laid = cut_lineage(_laid_out(known, n_docs))
    slots = cut_lineage(_slots(targets, total, block_words))
    # A source gives its slots' words, but no document more than MOST_REPEATS times.
    limits = slots.groupBy("sid").agg((F.count("*") * block_words).alias("won"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)))
    placed = laid.filter("size > 0").join(limits, "sid").select("sid", "size", "at", F.least("won", F.col("source_size") * MOST_REPEATS).alias("limit"), "source_size", turn.alias("turn"))
    placed = placed.withColumn("low", F.col("at") + F.col("turn") * F.col("source_size"))
    placed = placed.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("limit"))).filter("low < high")
    block = F.lit(block_words)
    pieces = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block)))).join(slots, ["sid", "rank"])
    begin = F.greatest("low", F.col("rank") * block)
    length = F.least("high", (F.col("rank") + 1) * block) - begin
    return laid, pieces.select("slot", "sid", "at", (begin - F.col("low")).alias("start"), length.alias("length"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, n_slots: one row per document.

    ``taken`` is the sum over the slots that take from the document, ``n_slots`` how often one does, ``first_slot`` the
    first of them (null if none). A source's words differ from its target by the few blocks by which the schedule's points
    do. A null text has size 0 and takes nothing; a null source is a source of its own, the last; documents without an id
    are ordered by their text. Rows that repeat an id and size stand next to each other and are taken in turn. An empty
    table gives no rows. Other columns are not read. Reruns agree, for the order depends on ids, texts and sizes only.
    """
    laid, pieces = schedule(docs, text, source, id_column, block_words)
    taken = pieces.groupBy(F.col("sid").alias("_sid"), F.col("at").alias("_at")).agg(F.sum("length").alias("words"), F.min("slot").alias("first_slot"), F.count("*").alias("n"))
    joined = laid.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
    zero = F.lit(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", zero).cast("long").alias("taken"), "first_slot", F.coalesce("n", zero).cast("long").alias("n_slots"))


def repeat_as_taken(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as the mix takes its words, rounded to whole documents.

    Rows with equal id and size share what their places take evenly, as far as whole copies go. Documents without words
    are not taken. All columns stay as they are.
    """
    taken = mix(docs, text, source, id_column)
    copies = taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum("taken").alias("_taken"), F.count("*").alias("_n"))
    copies = copies.filter("_size > 0").withColumn("_copies", F.floor(F.col("_taken") / (F.col("_size") * F.col("_n")) + 0.5).cast("int")).filter("_copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).alias("_i"), F.col(source).alias("_s"), word_count(F.col(text)).alias("_z"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_z") == F.col("_size"))
    return rows.join(copies, same).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
