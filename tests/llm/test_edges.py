"""Operators on texts and entities on tables with nulls in every column, ties, and columns named like their own."""

from pyspark.sql import functions as F

from sonolith.llm.fusion import FusedField, fuse
from sonolith.llm.matching import match
from sonolith.llm.packing import pack
from sonolith.llm.residue import find_residue
from sonolith.llm.tokens import encode_texts


def test_fusion(spark):
    df = spark.createDataFrame(
        [(1, "k", None, None, None), (2, "k", None, None, None), (3, None, None, None, None), (4, "t", "a", None, 5.0), (5, "t", "a", None, 5.0)],
        "id long, ref string, source string, at timestamp, v double",
    ).withColumns({"records": F.lit("old"), "group_id": F.lit("old"), "trust": F.lit(1)})
    trust = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "source string, trust int")
    field = FusedField("v", F.col("v") > 0, 1)
    for authority in ("trust", "evidence"):
        out = fuse(df, F.col("ref"), "id", F.col("source"), "at", trust, [field], authority)
        got = sorted((r.group_id, r.records, r.source_record, r.v, r.v_record) for r in out.collect())
        assert got == [(1, 2, 0, None, 0), (4, 2, 4, 5.0, 4)]


def test_matching(spark):
    r = spark.createDataFrame(
        [(None,) * 8, (1, None, 50.0, 8.0, None, None, None, None), (1, None, 50.0, 8.0, None, None, None, None)],
        "record_id long, key string, lat double, lon double, hub double, power double, farm string, maker string",
    ).withColumns({"rule": F.lit("old"), "cell": F.lit("old"), "unit_id": F.lit(7)})
    u = spark.createDataFrame(
        [(None,) * 8, (5, 50.0, 8.0, None, None, None, None, None)],
        "unit_id long, lat double, lon double, hub double, power double, farm string, maker string, gone boolean",
    ).withColumns({"m": F.lit("old"), "record_id": F.lit(7)})
    assert {(x.record_id, x.unit_id) for x in match(r, u).collect()} == {(1, 5)}


def test_packing(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (None, 2), (2, None), (3, -4)], "id long, n int").withColumn("container_id", F.lit(9))
    got = sorted((r.id or 0, r.units, r.container_id is None) for r in pack(df, "id", "n", 4).collect())
    assert got == [(0, 2, False), (1, 3, False), (1, 3, False), (2, 0, True), (3, 0, True)]


def test_texts(spark):
    rows = [(None, None), (None, "a road"), (1, "503 Service Unavailable"), (1, "503 Service Unavailable"), (2, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("old"), "residue": F.lit("old"), "ids": F.lit("old")})
    got = sorted((r.doc_id or 0, r.residue) for r in find_residue(df).collect())
    assert got == [(0, False), (0, False), (1, True), (1, True), (2, False)]
    lengths = sorted(len(r.ids) for r in encode_texts(df).collect())
    assert lengths[:2] == [0, 2] and lengths[-1] >= 60_000
