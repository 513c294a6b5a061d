import json
import struct
import wave
import zlib

import numpy as np
from pyspark.sql import functions as F

from sigspark.functions import scalar as S
from sigspark.operators import align as A, frames as fr
from sigspark.sources import recordings as rec
from sigspark.streaming import streams


def test_device_files_side_by_side(spark, tmp_path):
    for name, n in (("ecg", 5), ("resp", 3)):
        folder = tmp_path / "sub-02"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.csv").write_text("CH1,other\n" + "".join(f"{i}.5,x\n" for i in range(n)))
    rows = rec.device_recordings(spark, {"ecg": (str(tmp_path / "*/ecg.csv"), "CH1"), "resp": (str(tmp_path / "*/resp.csv"), "CH1"), "gone": (str(tmp_path / "*/resp.csv"), "missing")}).orderBy("idx").collect()
    assert [(r.series_id, r.idx, r.ecg, r.resp, r.gone) for r in rows] == [("02", i, i + 0.5, i + 0.5 if i < 3 else None, None) for i in range(5)]


def test_sound_blocks(spark, tmp_path):
    x = (np.sin(np.arange(1000) / 10) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.column_stack([x, -x]).astype("<i2").tobytes())
    blocks = rec.sound(spark, str(tmp_path), block=300).orderBy("start").collect()
    assert [b.start for b in blocks] == [0, 300, 600, 900] and blocks[0].fs == 8000
    assert np.allclose(np.concatenate([b.samples for b in blocks]), x / 32768)
    assert not any(rec.sound(spark, str(tmp_path), left=False).first().samples)


def test_subject_config(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sub-02": {"condition_order": ["RS1", "VIZ"], "trigger_threshold": 3, "trigger_patches": {"add_after_last_s": 2.5, "remove_indices": [1]}}, "7": {"status": "ok"}}))
    rows = {r.series_id: r for r in rec.subject_config(spark, str(tmp_path / "s.json")).collect()}
    assert rows["02"].condition_order == ["RS1", "VIZ"] and rows["02"].trigger_patches.add_after_last_s == 2.5 and rows["07"].status == "ok"


def test_clocks(spark):
    df = spark.createDataFrame([("01:30",), ("90",), ("1:00:05",), ("x",), (None,)], "c string")
    assert [r.s for r in df.select(S.clock_seconds("c").alias("s")).collect()] == [90, 90, 3605, None, None]
    assert df.select(S.clock_text(S.clock_seconds("c")).alias("t")).first().t == "01:30"


def test_result_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("02", "AUD", 1, 0.5), ("02", "VIZ", 2, 0.25), ("03", "AUD", 3, 1.0)], "subject string, condition string, w int, value double")
    at = str(tmp_path / "t")
    rec.write_results(df, at, ["subject", "condition"])
    rec.write_results(df.limit(0), at, ["subject", "condition"])  # ignored: the table is there
    schema = "w int, value double, extra string, subject string, condition string"
    back = rec.results(spark, at, schema, F.col("subject") == "02")
    assert sorted((r.condition, r.w, r.extra) for r in back.collect()) == [("AUD", 1, None), ("VIZ", 2, None)]
    assert "PartitionFilters: [isnotnull(subject" in back._jdf.queryExecution().executedPlan().toString()
    rec.write_results(df.filter("w = 1").withColumn("value", F.lit(9.0)), at, ["subject", "condition"], overwrite=True)
    assert sorted(r.value for r in rec.results(spark, at, schema).collect()) == [0.25, 1.0, 9.0]
    rec.write_documents(df, str(tmp_path / "j"), ["subject"])
    assert rec.read_documents(spark, str(tmp_path / "j"), "subject string", "condition string, w int, value double").count() == 3


def test_equal_files(spark, tmp_path):
    for name, data in (("a/1", b"x"), ("b/1", b"x"), ("b/2", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert sorted((r.path[-3:], r.first) for r in rec.first_of_equal_files(spark, str(tmp_path)).collect()) == [("a/1", True), ("b/1", False), ("b/2", True)]


def test_first_of_equal_rows(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (None, None), (4, ""), (None, "b"), (4, "")], "id int, text string")
    found = sorted((r.id is None, r.id or 0, r.sha256 is None, r.first) for r in rec.first_of_equal(df, F.col("text"), "id").collect())
    assert found == [(False, 1, False, True), (False, 2, True, True), (False, 3, False, False), (False, 4, False, True), (False, 4, False, True), (True, 0, False, True), (True, 0, True, False)]
    assert rec.first_of_equal(df.limit(0), F.col("text"), "id").count() == 0


def png(pixels):
    h, w, c = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_a_folder_of_pictures_gives_a_row_per_file(spark, tmp_path):
    rng = np.random.default_rng(5)
    colour, grey = rng.integers(0, 256, (9, 12, 3), dtype=np.uint8), rng.integers(0, 256, (16, 16, 1), dtype=np.uint8)
    for name, data in (("a.png", png(colour)), ("b.png", png(grey)), ("c.png", png(np.full((4, 4, 1), 200, np.uint8))), ("d.png", b"no picture")):
        (tmp_path / name).write_bytes(data)
    frames = rec.pictures(spark, str(tmp_path))
    first = {(r.y, r.px): r for r in frames.filter("clip LIKE '%a.png'").collect()}
    assert len(first) == 108 and all([first[y, x].red, first[y, x].green, first[y, x].blue] == colour[y, x].tolist() for y in range(9) for x in range(12))
    assert first[2, 3].v == colour[2, 3] @ np.array([299, 587, 114]) / 1000
    thin = {(r.y, r.px): r.v for r in rec.pictures(spark, str(tmp_path), 5).filter("clip LIKE '%b.png'").collect()}
    assert set(thin) == {(y, x) for y in range(4) for x in range(4)} and abs(thin[1, 2] - grey[5, 10, 0]) < 1e-9
    found = {r.clip[-5:]: r.dimension for r in fr.dark_dimension(frames).collect()}

    def dimension(v):
        sizes = np.arange(1, min(v.shape) // 2 + 1)
        y, x = np.nonzero(v < 128)
        return -np.polyfit(np.log(sizes), np.log([len(set(zip(y // s, x // s))) for s in sizes]), 1)[0]

    assert set(found) == {"a.png", "b.png", "c.png"} and found["c.png"] is None
    assert abs(found["b.png"] - dimension(grey[:, :, 0])) < 1e-9 and abs(found["a.png"] - dimension(colour @ np.array([299, 587, 114]) / 1000)) < 1e-9
    assert rec.pictures(spark, str(tmp_path)).limit(0).count() == 0 and fr.dark_dimension(frames.limit(0)).count() == 0


def test_annotated_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,condition_names\n1,a\n2,\n3,b\n")
    assert [r.time_s for r in rec.annotated(spark, str(tmp_path / "a.csv"), 2.0).orderBy("idx").collect()] == [0, 0.5, 1]


def test_triggers_from_start_to_segments(spark):
    high = [10, 11, 30, 31, 32, 50, 70, 71, 90, 110]
    df = spark.range(120).select(F.lit(1).alias("series_id"), F.col("id").alias("idx"), F.col("id").isin(high).cast("double").alias("x"))
    ends = A.last_of_runs(df, F.col("x") > 0.5).select("series_id", "idx")
    assert sorted(r.idx for r in ends.collect()) == [11, 32, 50, 71, 90, 110]
    assert sorted(r.idx for r in A.merged_triggers(ends, 20).collect()) == [11, 32, 71, 110]
    labels = A.annotated(ends, ends.select("series_id").distinct().withColumn("conditions", F.array(F.lit("A"), F.lit("B"))))
    assert {r.label: r.idx for r in labels.orderBy("idx").collect()} == {"AUDIO_SYNC": 32, "A_start": 50, "A_stop": 71, "B_start": 90, "B_stop": 110}
    pieces = A.segments(labels)
    assert A.sliced(df, pieces).groupBy("condition").count().collect() and A.sliced(df, pieces, closed="both").count() == A.sliced(df, pieces).count() + 2
    assert A.annotated(ends.limit(3), ends.select("series_id").distinct().withColumn("conditions", F.array(F.lit("A"), F.lit("B")))).count() == 0


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 1.0, 7), (1, 9.0, 8), (2, 1.0, 9)], "series_id int, t_s double, tag int")
    right = spark.createDataFrame([(1, 0.5, 10.0), (1, 1.5, 20.0), (1, 3.0, 30.0)], "series_id int, t_s double, value double")
    assert {r.tag: r.value for r in A.nearest(left, right, 0.6).collect()} == {7: 10.0, 8: None, 9: None}


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    at = str(tmp_path / "in")
    events.coalesce(1).orderBy("ts").write.parquet(at)
    read = lambda: spark.readStream.schema(events.schema).parquet(at)

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    w = run(streams.sliding_features(read(), "1 hour", "1 day", "12 hours", ["event_type"], [F.count("*").alias("n"), F.avg("value").alias("m")]), "features")
    assert w.count() > 0
    assert run(streams.without_repeats(read(), "40 days", ["user_id", "event_type"]), "firsts").count() == events.select("user_id", "event_type").distinct().count()
    signal = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([0, 5, 5, 0, 5, 0])], "key string, idx long, x double")
    signal.coalesce(1).write.parquet(str(tmp_path / "s"))
    r = run(streams.trigger_runs(spark.readStream.schema(signal.schema).parquet(str(tmp_path / "s")), 1.0, "key"), "runs")
    assert sorted((x["first"], x["last"]) for x in r.collect()) == [(1, 2), (4, 4)]
