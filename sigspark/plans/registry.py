"""Where queries register, and the views of the test tables that they share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a query under its function's name. ``sql`` may use the views named; it starts with SELECT or with a comma and further tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            named = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views.split())
            ORACLE[f.__name__] = f"WITH {named} {sql}" if named else sql.lstrip(" ,\n") if sql.lstrip()[:1] != "," else f"WITH {sql.lstrip(' ,')}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals, and no minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sig_emb(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("series_id"), F.col("label").cast("long").alias("grp"), F.posexplode("embedding").alias("idx", "x")).select("series_id", "grp", F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"))


def pair_emb(spark: SparkSession, d: str) -> DataFrame:
    """Series 2k and 2k + 1 side by side."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id"), (F.col("vec_id") % 2).alias("side"), "embedding")
    both = e.groupBy("pair_id").agg(F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    zipped = both.select("pair_id", F.posexplode(F.arrays_zip("a", "b")).alias("idx", "v"))
    return zipped.select("pair_id", F.col("idx").cast("long").alias("idx"), F.col("v.a").cast("double").alias("x"), F.col("v.b").cast("double").alias("y"))


def sig_events(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6
    row = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("series_id"), row.cast("long").alias("idx"), seconds.alias("t_s"), F.col("value").alias("x"), F.col("event_type").alias("channel"))


def sig_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means per user bucket and event type; hours without events are null."""
    e = table(spark, d, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3600000000).cast("long")
    means = e.groupBy((F.col("user_id") % 8).alias("series_id"), F.col("event_type").alias("channel"), hour.alias("idx")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / (100.0 * F.count("value"))).alias("x"))
    grid = means.select("series_id", "channel").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("idx"))
    return grid.join(means, ["series_id", "channel", "idx"], "left")


def frame_emb(spark: SparkSession, d: str) -> DataFrame:
    return sig_emb(spark, d).select(F.col("grp").alias("clip"), F.col("series_id").alias("frame"), F.floor(F.col("idx") / 8).cast("long").alias("y"), (F.col("idx") % 8).alias("px"), F.col("x").alias("v"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Subject x condition means: a repeated-measures table."""
    o = table(spark, d, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.groupBy((F.col("o_custkey") % 20).alias("subject"), F.col("o_orderpriority").alias("condition")).agg((cents / (100.0 * F.count("*"))).alias("value"))


VIEW_SQL = {
    "sig_emb": "SELECT vec_id AS series_id, label::BIGINT AS grp, (generate_subscripts(embedding, 1) - 1)::BIGINT AS idx, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "pair_emb": "SELECT a.vec_id // 2 AS pair_id, (generate_subscripts(a.embedding, 1) - 1)::BIGINT AS idx, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0",
    "sig_events": "SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, (epoch_us(ts) - 1704067200000000) / 1e6 AS t_s, value AS x, event_type AS channel FROM events",
    "sig_hourly": "SELECT g.series_id, g.channel, g.idx, m.x FROM (SELECT DISTINCT user_id % 8 AS series_id, event_type AS channel, i.idx FROM events, (SELECT range AS idx FROM range(720)) i) g LEFT JOIN (SELECT user_id % 8 AS series_id, event_type AS channel, (epoch_us(ts) - 1704067200000000) // 3600000000 AS idx, sum(round(value * 100)::BIGINT)::BIGINT / (1e2 * count(value)) AS x FROM events GROUP BY ALL) m ON g.series_id = m.series_id AND g.channel = m.channel AND g.idx = m.idx",
    "frame_emb": "SELECT label::BIGINT AS clip, vec_id AS frame, i // 8 AS y, i % 8 AS px, v FROM (SELECT label, vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "cells": "SELECT o_custkey % 20 AS subject, o_orderpriority AS condition, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / (1e2 * count(*)) AS value FROM orders GROUP BY ALL",
}
