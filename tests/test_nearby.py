"""Near points: the sweep against all pairs, at the poles, around the 180th meridian and with a hot place."""

import math
import random

import pytest

from sonolith.operators.nearby import EARTH_RADIUS_M, pairs_within
from sonolith.operators.ranges import distance_join, interpolate, interval_join, merge_intervals
from pyspark.sql import functions as F


def gap(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def places(seed, n, spread):
    r = random.Random(seed)
    centres = [(0, 179.99), (0, -179.99), (89.99, 10), (-89.995, -70), (51, 7), (78, 359.99), (78, 0.01)]
    out = []
    for i in range(n):
        la, lo = r.choice(centres)
        lat = max(-90.0, min(90.0, la + r.gauss(0, spread)))
        out.append((i, lat, lo + r.gauss(0, spread) * (40 if abs(la) > 80 else 1)))
    return out


@pytest.mark.parametrize(("seed", "radius"), [(1, 3000.0), (2, 300.0), (3, 60_000.0)])
def test_all_pairs(spark, seed, radius):
    a, b = places(seed, 250, radius / 50_000), places(seed + 10, 250, radius / 50_000)
    odd = [(900, None, 1.0), (901, 1.0, None), (902, 91.0, 1.0), (903, math.nan, 1.0), (904, 1.0, math.inf)]
    kind = "id long, lat double, lon double"
    left, right = spark.createDataFrame(a + odd, kind), spark.createDataFrame(b + odd, kind)
    want = sorted((x[0], y[0]) for x in a for y in b if gap(x, y) <= radius)
    got = pairs_within(left, right, radius, "id", "id")
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == want and want
    got = pairs_within(left, right, radius, "id", "id", block_rows=10)
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == want
    named = right.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    got = distance_join(left, named, radius, right_at=("rlat", "rlon"))
    assert sorted((r.id, r.rid) for r in got.collect()) == want


def test_hot_place_and_empty(spark):
    kind = "id long, lat double, lon double"
    left = spark.createDataFrame([(i, 50.0, 8.0) for i in range(3000)], kind)
    right = spark.createDataFrame([(i, 50.0, 8.0 + i / 1e6) for i in range(40)], kind)
    assert pairs_within(left, right, 100.0, "id", "id", block_rows=100).count() == 3000 * 40
    assert pairs_within(left, right.limit(0), 100.0, "id", "id").count() == 0
    assert pairs_within(left.limit(0), right, 100.0, "id", "id").count() == 0


def test_interval_join_and_merge(spark):
    spans = spark.createDataFrame([("k", 0, 10), ("k", 5, 20), ("k", 20, 25), ("k", 30, 31), ("m", 1, 2)], "k string, a long, b long")
    merged = merge_intervals(spans, ["k"], "a", "b").collect()
    assert sorted((r.k, r.a, r.b) for r in merged) == [("k", 0, 25), ("k", 30, 31), ("m", 1, 2)]
    at = spark.createDataFrame([("k", 25), ("k", 26), ("m", 25)], "k string, t long")
    hit = interval_join(at, merge_intervals(spans, ["k"], "a", "b"), ["k"], F.col("t"), F.col("a"), F.col("b"), 7, "semi")
    assert [(r.k, r.t) for r in hit.collect()] == [("k", 25)]


def test_interpolation(spark):
    known = spark.createDataFrame([("k", 10, 1.0), ("k", 20, 3.0)], "k string, t long, v double")
    probes = spark.createDataFrame([("k", 5), ("k", 15), ("k", 20), ("k", 99), ("x", 1)], "k string, t long")
    got = {(r.k, r.t): r.o for r in interpolate(probes, known, ["k"], "t", "v", "o").collect()}
    assert got == {("k", 5): 1.0, ("k", 15): 2.0, ("k", 20): 3.0, ("k", 99): 3.0, ("x", 1): None}


@pytest.mark.parametrize(("lefts", "rights"), [(3, 4000), (4000, 3), (900, 900)])
def test_hot_places_of_either_side_are_dealt_to_several_tasks(spark, lefts, rights):
    """Thousands of points in one place: every pair once, and no task gives more than a part of them."""

    def points(n, name):
        return spark.range(n).select(F.col("id").alias(name), (F.lit(50.0) + F.col("id") * 1e-9).alias("lat"), F.lit(8.0).alias("lon"))

    out = pairs_within(points(lefts, "a"), points(rights, "b"), 100.0, "a", "b", block_rows=100)
    parts = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in parts) == lefts * rights == out.select("left_id", "right_id").distinct().count()
    assert max(r.n for r in parts) < 0.5 * lefts * rights
