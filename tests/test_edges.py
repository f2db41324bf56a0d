"""Core operators on tables with nulls in every column, repeated rows, and columns named like their own."""

from pyspark.sql import functions as F

from sonolith.operators.badrows import Field, parse_records
from sonolith.operators.fill import Level, fill_from_groups
from sonolith.operators.nearby import pairs_within


def test_fill(spark):
    df = spark.createDataFrame(
        [(1, "x", 1.0, "a"), (1, "x", 1.0, "a"), (None, None, None, None), (2, "x", None, "b")],
        "id long, k string, v double, level string",
    )
    names = ("value", "value_filled", "value_level", "value_support")
    for name in names:
        df = df.withColumn(name, F.lit("old"))
    levels = [Level("k", ("k",), 2), Level("all", (), 1)]
    out = fill_from_groups(df, {"v": F.col("v")}, F.col("v").isNotNull(), levels)
    got = sorted((r.id or 0, r.value, r.value_level, r.value_support) for r in out.collect())
    assert got == [(0, 1.0, "all", 2), (1, 1.0, None, 0), (1, 1.0, None, 0), (2, 1.0, "k", 2)]


def test_nearby(spark):
    kind = "id long, lat double, lon double, strip string, block int, x string, side int, w int, salt int"
    rows = [(1, 1.0, 1.0, "s", 1, "x", 1, 1, 1), (1, 1.0, 1.0, None, None, None, None, None, None), (None, 1.0, 1.0, "s", 1, "x", 1, 1, 1), (2, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = pairs_within(df, df, 10.0, "id", "id").collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 1)] * 4  # each repeated row pairs with each


def test_parse(spark):
    df = spark.createDataFrame([(None, None), (1, "x,5"), (1, "x,5")], "a long, raw string").withColumn("n", F.lit("old"))
    out = parse_records(df, "raw", (Field("t"), Field("n", 1, 9)))
    got = sorted((r.a or 0, r.t or "", r.n or 0, r.reason or "") for r in out.collect())
    assert got == [(0, "", 0, "column_count"), (1, "x", 5.0, ""), (1, "x", 5.0, "")]
