"""Reading and writing recordings: device CSVs, sound files, subject configuration, result tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.scalar import subject_key
from ..operators.align import zipped


def numbered(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds idx, the row's number in its file: ids grow along a file, so only their order inside a file counts."""
    keys = keys or ["_file"]
    tagged = df.withColumn("_file", F.input_file_name()) if keys == ["_file"] else df
    w = W.partitionBy(*keys).orderBy("_at")
    return tagged.withColumn("_at", F.monotonically_increasing_id()).withColumn("idx", (F.row_number().over(w) - 1).cast("long")).drop("_at")


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of the CSV files at ``path`` as doubles, with series_id from a ``sub-NN`` folder and idx in file order.

    Columns that a file does not have are null. Parsing stops at nothing: a cell that is no number is null.
    """
    raw = spark.read.option("header", True).csv(path, enforceSchema=False)
    have = {c: F.col(f"`{c}`").try_cast("double") for c in raw.columns}
    picked = raw.select(F.input_file_name().alias("_file"), *[have.get(c, F.lit(None).cast("double")).alias(c) for c in columns])
    rows = numbered(picked, ["_file"])
    return rows.select(subject_key(F.regexp_extract("_file", r"(sub-[0-9]+)", 1)).alias("series_id"), "idx", *columns)


def device_recordings(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Single-column device files side by side by row number. ``paths``: output name -> (path, column in the file)."""
    frames = [csv_table(spark, path, [column]).select("series_id", "idx", F.col(column).alias(name)) for name, (path, column) in paths.items()]
    return zipped(frames)


def sound(spark: SparkSession, path: str, left: bool = True, block: int = 1 << 16) -> DataFrame:
    """path, fs, start, samples: 16-bit WAV files as blocks of samples in -1..1, the left channel or the mean."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(bytes(content))) as w:
                    fs, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                    if width != 2:
                        raise ValueError(f"{name}: {8 * width}-bit samples; only 16-bit files are read")
                    start = 0
                    while data := w.readframes(block):
                        x = np.frombuffer(data, "<i2").reshape(-1, channels) / 32768.0
                        yield pd.DataFrame({"path": [name], "fs": [float(fs)], "start": [start], "samples": [x[:, 0] if left else x.mean(1)]})
                        start += len(x)

    return files.mapInPandas(run, "path string, fs double, start long, samples array<double>")


SUBJECT = T.StructType([
    T.StructField("condition_order", T.ArrayType(T.StringType())), T.StructField("audio_sync", T.StringType()), T.StructField("trigger_threshold", T.IntegerType()),
    T.StructField("trigger_patches", T.StructType([T.StructField("add_after_last_s", T.DoubleType()), T.StructField("remove_indices", T.ArrayType(T.IntegerType()))])),
    T.StructField("status", T.StringType()), T.StructField("notes", T.StringType()),
])


def subject_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per subject of a JSON map; keys such as ``sub-02``, ``02`` and ``2`` all become ``02``."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), SUBJECT))).alias("key", "v"))
    return rows.select(subject_key("key").alias("series_id"), "v.*")


def annotated(spark: SparkSession, path: str, fs: float) -> DataFrame:
    """An annotated CSV with time_s from the row number where it is missing, in time order, one row per time."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    df = numbered(df)
    time = F.coalesce(F.col("time_s").cast("double"), F.col("idx") / fs) if "time_s" in df.columns else F.col("idx") / fs
    return one_per_time(df.withColumn("time_s", time), ["_file"]).drop("_file")


def one_per_time(df: DataFrame, keys: list[str], t: str = "time_s", order: str = "idx") -> DataFrame:
    """The first row of each time of a series."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys, t).orderBy(order))).filter("_k = 1").drop("_k")


def results(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """A result table partitioned by subject and condition; the filter prunes folders. Columns a file lacks are null."""
    df = spark.read.schema(schema).option("mergeSchema", True).parquet(path)
    return df.filter(where) if where is not None else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Tables with different columns one after the other; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_results(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Partitioned Parquet. Without ``overwrite`` an existing table is left as it is; with it only the partitions written are replaced."""
    writer = df.write.partitionBy(*by)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else writer.mode("ignore")).parquet(path)


def write_documents(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> None:
    """One JSON document per key: the other columns as arrays of rows ordered by all of them."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*others))).alias("rows"))
    grouped.write.mode("overwrite" if overwrite else "ignore").json(path)


def read_documents(spark: SparkSession, path: str, keys: str, row: str) -> DataFrame:
    return spark.read.schema(f"{keys}, rows array<struct<{row}>>").json(path).select(*[k.split()[0] for k in keys.split(", ")], F.inline("rows"))


def first_of_equal(df: DataFrame, content: Column, order: str) -> DataFrame:
    """order, sha256, first: rows of equal content, the one with the least ``order`` marked, and one alike in both with it. Null
    contents are equal; a null ``order`` is first only where no other is. Only hashes and ``order`` are shuffled, and no task holds a
    group: the least is an aggregate, and it is joined on the hash and ``order`` together."""
    hashed = df.select(order, F.sha2(content, 256).alias("sha256"))
    firsts = hashed.groupBy(F.col("sha256").alias("_h")).agg(F.min(order).alias("_o")).withColumn("_first", F.lit(True))
    same = F.col("sha256").eqNullSafe(F.col("_h")) & F.col(order).eqNullSafe(F.col("_o"))
    return hashed.join(firsts, same, "left").select(order, "sha256", F.coalesce("_first", F.lit(False)).alias("first"))


def first_of_equal_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, first: equal files in any folder, the first path of each kind marked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return first_of_equal(files, F.col("content"), "path")


def pictures(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """clip, frame, y, px, v, red, green, blue: the images at ``path`` as a frame table, every ``stride``-th row and column.

    clip is the file, frame 0, v the luma from 0 to 255. Images of one channel are grey; alpha is not read. Files that hold no
    image give no rows. An image is cut into its lines before Python sees it.
    """
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    wide = F.col("width") * F.col("nChannels")
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1, F.lit(stride)), lambda y: F.struct(F.floor(y / stride).cast("long").alias("y"), F.substring("data", y * wide + 1, wide).alias("line")))
    each = image.select(F.col("origin").alias("clip"), F.col("nChannels").alias("n"), F.inline(lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for clip, n, y, line in zip(batch["clip"], batch["n"], batch["y"], batch["line"]):
                bgr = np.frombuffer(bytes(line), np.uint8).reshape(-1, n)[::stride, :3].astype(float)
                b, g, r = bgr.T if n > 1 else (bgr[:, 0],) * 3
                luma = (299 * r + 587 * g + 114 * b) / 1000  # exact for greys
                yield pd.DataFrame({"clip": clip, "frame": 0, "y": y, "px": np.arange(len(luma)), "v": luma, "red": r, "green": g, "blue": b})

    return each.mapInPandas(run, "clip string, frame long, y long, px long, v double, red double, green double, blue double")
