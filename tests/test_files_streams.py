"""Files, contracts and the streaming forms."""

import math
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.sources import files
from sonolith.streaming import events


def test_absent_table_has_no_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.LongType())])
    assert files.read_table(spark, f"{tmp_path}/none", schema).count() == 0
    spark.range(3).select(F.col("id").alias("x")).write.parquet(f"{tmp_path}/t")
    assert files.read_table(spark, f"{tmp_path}/t", schema).count() == 3
    assert files.is_complete(spark, f"{tmp_path}/t") and not files.is_complete(spark, f"{tmp_path}/none")


def test_stamps_survive_parquet(spark, tmp_path):
    files.stamp(spark.range(2), "id", "grid", "z30").write.parquet(f"{tmp_path}/s")
    df = spark.read.parquet(f"{tmp_path}/s")
    assert files.require_stamp(df, "id", "grid", "z30").count() == 2
    with pytest.raises(ValueError, match="grid"):
        files.require_stamp(df, "id", "grid", "z12")


def test_delimited_and_counts(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "t.tsv").write_text("a\tn\nx y\t3\n")
    assert files.read_delimited(spark, f"{tmp_path}/t.tsv", schema).collect() == [("x y", 3)]
    (tmp_path / "c.json").write_text('{"a": "x", "n": 3}\n')
    assert files.read_counts(spark, f"{tmp_path}/c.json", schema).collect() == [("x", 3)]


def test_traces(spark):
    trace = {"address": "~a1", "start": 100.0, "rows": [[0, 1.5, 2.5, "ground", 10], [5.5, 1.6, 2.6, 1200, None]]}
    df = spark.createDataFrame([(json.dumps(trace),)], "content string")
    got = files.traces(df).orderBy("point").collect()
    assert [(r.t, r.altitude_ft, r.on_ground, r.speed_kt) for r in got] == [(100.0, None, True, 10.0), (105.5, 1200.0, False, None)]


def test_dynamic_partitions_and_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v long, p string")
    files.write_partitions(df, f"{tmp_path}/d", ["p"])
    files.write_partitions(spark.createDataFrame([(9, "b")], "v long, p string"), f"{tmp_path}/d", ["p"])
    assert sorted((r.v, r.p) for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [(1, "a"), (9, "b")]
    a = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k long, v double")
    assert files.merge_tables(a, a.where("k = 2"), ["k"], "v").count() == 2
    with pytest.raises(Exception, match="two runs differ"):
        files.merge_tables(a, a.withColumn("v", F.lit(1.0)), ["k"], "v").collect()


def test_streams_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [("a", 0, False), ("a", 100, True), ("a", 500, True), ("a", 600, False), ("b", 50, False), ("a", 700, False), ("a", 100_000, False)]
    df = spark.createDataFrame(rows, "k string, s long, r boolean").select("k", F.timestamp_seconds(F.col("s") + 6000).alias("t"), "r")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def run(out, name, mode="append"):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    counts = run(events.tumbling_counts(read(), "t", ["k"], "10 minutes", "1 minute"), "w")
    assert sorted((r.k, r.start.timestamp(), r.n) for r in counts) == [("a", 6000.0, 3), ("a", 6600.0, 2), ("b", 6000.0, 1)]
    ended = run(events.rest_sessions(read(), "k", "t", "r", 300.0), "s")
    assert [(r.k, r.start_s, r.stop_s, r.rows) for r in ended] == [("a", 6000.0, 6500.0, 3)]
    assert len(run(events.once(read(), "t", ["k", "t"], "1 minute"), "o")) == len(rows)
    q = events.accumulate(read().withColumn("v", F.lit(2.0)), ["k"], "v", f"{tmp_path}/sums", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert {r.k: (r.sum, r.n) for r in events.total(spark, f"{tmp_path}/sums", ["k"]).collect()} == {"a": (12.0, 6), "b": (2.0, 1)}
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_opl_and_members(spark):
    line = "n5 v1 Tpower=generator,name=W%f6%rth%20%a%2c%b%3d%c%25%,x x8 y50"
    df = spark.createDataFrame([(line,), ("n6 v1 T x1 y2",), ("n7",)], "value string")
    got = [r.t for r in df.select(files.opl_tags(F.col("value")).alias("t")).collect()]
    assert got == [{"power": "generator", "name": "Wörth a,b=c%"}, {}, {}]
    texts = spark.createDataFrame([("a", "é" * 50, False), ("b", "gone" * 50, True), ("c", "", False)], "name string, text string, bad boolean")
    read = {r.name: (r.content, r.fault) for r in files.read_members(files.compress(texts, "name", "text", "bad")).collect()}
    assert read == {"a": ("é" * 50, None), "b": (None, "corrupt"), "c": ("", None)}


def test_what_is_written_is_deleted(spark):
    from sonolith.session import discard, materialize, release

    import os

    a, b = materialize(spark.range(5), "a"), materialize(spark.range(6), "b")
    paths = [x.__dict__["_sonolith_path"] for x in (a, b)]
    discard(a, None)
    assert [os.path.exists(p) for p in paths] == [False, True] and b.count() == 6
    release(spark)
    assert not os.path.exists(paths[1])


def test_road_emission_terms(spark):
    """Warmth, slope and junctions of single vehicles, by hand: 10.6 degrees below 20 add 0.85 dB to a car's rolling."""
    from sonolith.functions import emission as e

    one = spark.range(1)

    def bands(category, speed=70.0, slope=0.0, circle=False, at=None, celsius=20.0, electric=0.0):
        args = [F.lit(speed), F.lit(slope), F.lit(circle), F.lit(at).cast("double"), F.lit(celsius), F.lit(0.0), F.lit(electric)]
        return one.select(e.vehicle_energy(category, *args).alias("x")).first().x

    rolling = bands("light", electric=1.0)
    assert [round(10 * math.log10(x), 6) for x in rolling] == list(e.ROLLING_A["light"])
    assert abs(10 * math.log10(bands("light", electric=1.0, celsius=9.4)[3] / rolling[3]) - 0.848) < 1e-9
    both = bands("light")
    assert abs(10 * math.log10(both[0] - rolling[0]) - 97.9) < 1e-9
    steep = bands("light", slope=20.0)
    assert abs(10 * math.log10((steep[0] - rolling[0]) / (both[0] - rolling[0])) - 10 / 1.5 * 0.7) < 1e-9
    assert abs(10 * math.log10(bands("light", at=50.0, electric=1.0)[2] / rolling[2]) + 2.25) < 1e-9
    car, moto = (10 * math.log10(one.select(e.a_energy(F.array(*[F.lit(x) for x in bands(c)])).alias("x")).first().x) for c in ("light", "moto"))
    assert abs(moto - car - 3.8) < 1e-9
