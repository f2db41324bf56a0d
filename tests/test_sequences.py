"""Sequence operators on small tracks made by hand."""

from pyspark.sql import functions as F

from sonolith.operators import kept, sequences


def track(spark, rows):
    """(t, speed, resting) of one address."""
    return spark.createDataFrame([("a", *r) for r in rows], "k string, t long, v double, r boolean")


def test_a_rest_of_exactly_the_limit_splits(spark):
    rows = [(0, 90.0, False), (100, 20.0, True), (400, 50.0, True), (500, 90.0, False), (600, 90.0, False)]
    out = sequences.rotations(track(spark, rows), ["k"], "t", "r", F.col("v") <= 30, 300)
    got = sorted((r.rotation, r.t) for r in out.collect())
    assert got == [(1, 0), (1, 100), (1, 400), (2, 100), (2, 400), (2, 500), (2, 600)]  # it owns its take-off roll
    out = sequences.rotations(track(spark, rows), ["k"], "t", "r", F.col("v") <= 30, 301)
    assert {r.rotation for r in out.collect()} == {1}


def test_a_rest_before_moving_or_at_the_end_never_splits(spark):
    rows = [(0, 0.0, True), (900, 0.0, True), (1000, 90.0, False), (1100, 0.0, True), (9000, 0.0, True)]
    out = sequences.rotations(track(spark, rows), ["k"], "t", "r", F.col("v") <= 30, 300)
    assert {r.rotation for r in out.collect()} == {1}


def test_secondary_only_within_reach(spark):
    df = spark.createDataFrame(
        [("a", 10, False, 1.0), ("a", 11, True, 1.0), ("a", 12, True, 1.0), ("a", 13, True, -1.0), ("b", 11, True, 1.0), ("a", 20, False, -1.0), ("a", 20, True, 1.0)],
        "k string, t long, s boolean, v double",
    )
    out = sequences.secondary_only(df, ["k"], "t", "s", F.col("v") > 0, 1)
    assert sorted((r.k, r.t, r.s) for r in out.collect()) == [("a", 10, False), ("a", 12, True), ("a", 20, False), ("a", 20, True), ("b", 11, True)]


def test_hysteresis_and_tail(spark):
    df = track(spark, [(i, v, False) for i, v in enumerate([1.0, 9.0, 6.0, 4.0, 6.0, 8.5])])
    out = sequences.hysteresis(df, ["k"], ["t"], F.col("v") >= 8, F.col("v") < 5, "h").orderBy("t")
    assert [r.h for r in out.collect()] == [False, True, True, False, False, True]
    out = sequences.cut_tail(df, ["k"], ["t"], F.col("v") < 5)
    assert out.count() == 0  # the first one is bad already
    assert sequences.cut_tail(df, ["k"], ["t"], F.col("v") > 8.9).count() == 1


def test_sustained_needs_the_run(spark):
    df = track(spark, [(i, float(v), False) for i, v in enumerate([1, 1, 0, 1, 1, 1])])
    out = sequences.sustained(df, ["k"], ["t"], F.col("v") == 1, 3, "x").orderBy("t")
    assert [r.x for r in out.collect()] == [False] * 3 + [True] * 3


def test_jumps_are_judged_by_what_was_kept(spark):
    df = track(spark, [(0, 0.0, False), (1, 100.0, False), (2, 110.0, False), (3, 5.0, False), (50, 200.0, False)])
    out = kept.drop_jumps(df, ["k"], "t", "v", 50.0, 10.0)
    assert sorted(r.t for r in out.collect()) == [0, 3, 50]


def test_simplify_keeps_corners(spark):
    df = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0.1), (2, 0), (2, 5), (2, 5)])], "k string, t long, x double, y double")
    out = kept.simplify(df, ["k"], "t", "x", "y", 0.5)
    assert sorted(r.t for r in out.collect()) == [0, 2, 4] or sorted(r.t for r in out.collect()) == [0, 2, 3, 4]


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(1, "a", "x", 2.0), (1, "a", "y", 1.0), (1, "b", "y", 1.5), (1, "b", "x", 9.0)], "g long, a string, b string, d double")
    out = kept.greedy_pairs(df, "g", "a", "b", "d")
    assert sorted((r.a, r.b) for r in out.collect()) == [("a", "y"), ("b", "x")]


def test_empty_tracks(spark):
    df = track(spark, [])
    assert sequences.rotations(df, ["k"], "t", "r", F.col("v") <= 30, 300).count() == 0
    assert kept.drop_jumps(df, ["k"], "t", "v", 50.0, 10.0).count() == 0
