"""Queries of problem 3: points near other points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.operators.nearby import EARTH_RADIUS_M, pairs_within
from sonolith.sources import table


def near_runways(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of a turbine record and a runway point at most 3 km apart, with the distance."""
    turbines, points = table(spark, folder, "turbines"), table(spark, folder, "runway_points")
    return pairs_within(turbines, points, 3000.0, "record_id", "point_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_runways(spark, folder).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("point_id"))


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest runway point of each record that has one within 3 km; the smaller id on a tie (to the millimetre)."""
    mm = F.floor(F.col("distance_m") * 1000 + 0.5).cast("long")
    best = near_runways(spark, folder).groupBy("left_id").agg(
        F.min(F.struct(mm.alias("mm"), F.col("right_id").alias("id"))).alias("b"), F.count(F.lit(1)).alias("points")
    )
    return best.select(
        F.col("left_id").alias("record_id"), F.col("b.id").alias("point_id"), F.col("b.mm").alias("mm"), "points"
    )


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest}

_PAIRS = f"""with pairs as (select record_id, point_id, 2 * {EARTH_RADIUS_M} * asin(sqrt(least(1.0,
    pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(p.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))) as d
    from turbines t, runway_points p where abs(t.lat) <= 90 and abs(p.lat) <= 90 and abs(t.lat - p.lat) < 0.03
    and not isnan(t.lat) and not isnan(t.lon) and not isnan(p.lat) and not isnan(p.lon))"""

SQL = {
    "p3_found": f"{_PAIRS} select record_id, point_id from pairs where d <= 3000",
    "p3_nearest": f"""{_PAIRS}, near as (select *, cast(floor(d * 1000 + 0.5) as bigint) as mm from pairs where d <= 3000)
        select record_id, arg_min(point_id, {{'a': mm, 'b': point_id}}) as point_id, min(mm) as mm, count(*) as points from near group by record_id""",
}
