"""Noise at many receivers: distance-bounded joins, level sums, contributors, ranking, selection. Receivers are the
turbine records with a usable position, pieces the runway points; a piece's power, layer and period derive from its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.geo import cell_of, distance_m, has_place, local_metres, tile, wrap_lon
from sonolith.functions.levels import a_weighted, air_absorption_db_per_m, energy, lden_energy, level, rounded
from sonolith.operators import grouping, ranges, selection
from sonolith.operators.graphs import inside, ring_area
from sonolith.operators.nearby import pairs_within
from sonolith.sources import table

REACH_M = 12_000.0


def receivers(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turbines").where(has_place(F.col("lat"), F.col("lon")))
    return t.select("record_id", "lat", "lon", "country_iso", "farm", "power_kw")


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "runway_points").where(has_place(F.col("lat"), F.col("lon")))
    return p.select(
        "point_id", "airport", "kind", "seq", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
        (F.col("point_id") % 30 + 70).cast("double").alias("power_db"),
        (F.col("point_id") % 6).cast("int").alias("layer"), (F.col("point_id") % 3).cast("int").alias("period"),
    )


def heard(spark: SparkSession, folder: str) -> DataFrame:
    """Each receiver with each piece within reach and the piece's free-field level there (to the thousandth of a dB)."""
    near = pairs_within(
        receivers(spark, folder), pieces(spark, folder), REACH_M, "record_id", "point_id", right_at=("p_lat", "p_lon")
    ).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("point_id"), "distance_m")
    joined = near.join(pieces(spark, folder).drop("p_lat", "p_lon"), "point_id")
    spread = F.col("power_db") - 20 * F.log10(F.greatest(F.col("distance_m"), F.lit(1.0))) - 11
    return joined.withColumn("level_db", rounded(spread, 3))


def J28_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Number of pieces within reach and the distance of the nearest, by receiver."""
    return heard(spark, folder).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("pieces"), rounded(F.min("distance_m"), 2).alias("nearest_m")
    )


def P11_loud_enough(spark: SparkSession, folder: str) -> DataFrame:
    h = heard(spark, folder).where((F.col("level_db") >= 10) & (F.col("distance_m") <= 8000))
    return h.select("record_id", "point_id", "level_db")


def A2_total_level(spark: SparkSession, folder: str) -> DataFrame:
    out = grouping.sum_levels(heard(spark, folder), ["record_id"], "level_db")
    return out.select("record_id", rounded(F.col("level_db"), 3).alias("level_db"))


def A3_lden(spark: SparkSession, folder: str) -> DataFrame:
    out = grouping.lden_by(heard(spark, folder), ["record_id", "layer"], "level_db", "period")
    return out.select("record_id", "layer", rounded(F.col("lden_db"), 3).alias("lden_db"))


def _contributors(spark: SparkSession, folder: str) -> DataFrame:
    """Energy (Lden) of each aerodrome at each receiver, in whole millionths, with its nearest piece and their number."""
    h = heard(spark, folder)
    parts = [F.when(F.col("period") == p, energy(F.col("level_db"))).otherwise(0.0) for p in range(3)]
    whole = F.floor(lden_energy(*parts) * 1e6 + 0.5).cast("long")
    return h.withColumn("__e", whole).groupBy("record_id", "airport").agg(
        F.sum("__e").alias("e"), F.min(F.struct("distance_m", "point_id")).alias("near"), F.count(F.lit(1)).alias("n")
    )


def A17_contributors(spark: SparkSession, folder: str) -> DataFrame:
    c = _contributors(spark, folder)
    return c.select("record_id", "airport", "e", F.col("near.point_id").alias("nearest"), "n")


def lden_top3(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: the three loudest contributors at each receiver with their Lden and share of the whole."""
    c = grouping.shares(_contributors(spark, folder), ["record_id"], "e")
    top = selection.top_k(c, ["record_id"], [F.desc("e"), F.col("airport")], 3)
    return top.select(
        "record_id", "rank", "airport", rounded(level(F.col("e") / 1e6), 3).alias("lden_db"), rounded(F.col("share")).alias("share")
    )


def A20_rest_row(spark: SparkSession, folder: str) -> DataFrame:
    return grouping.top_with_rest(_contributors(spark, folder), ["record_id"], "airport", "e", 1)


def A22_whole_percents(spark: SparkSession, folder: str) -> DataFrame:
    """Contributors' shares as whole percents that add up to 100."""
    c = grouping.shares(_contributors(spark, folder), ["record_id"], "e").where(F.col("share").isNotNull())
    out = grouping.whole_percents(c.withColumn("share", rounded(F.col("share"), 6)), ["record_id"], "share", "airport")
    return out.select("record_id", "airport", "percent")


def T7_until_omitted(spark: SparkSession, folder: str) -> DataFrame:
    """The fewest loudest pieces of each receiver that leave out at most 2.33 % of what they give."""
    h = heard(spark, folder).withColumn("bound", F.floor(energy(F.col("level_db")) * 1e6 + 0.5))
    return selection.until_omitted(h, ["record_id"], "bound", "point_id", 0.0233).select("record_id", "point_id")


def T6_by_direction(spark: SparkSession, folder: str) -> DataFrame:
    """The loudest piece of each layer, then the loudest of these until a tenth of the energy is left."""
    h = heard(spark, folder).withColumn("e", F.floor(energy(F.col("level_db")) * 1e6 + 0.5))
    out = selection.best_then_prefix(h, ["record_id"], "layer", "e", "point_id", 0.1)
    return out.select("record_id", "layer", "point_id")


def T8_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """Energy of each receiver estimated from draws in proportion to the bound, loud pieces for certain: 4 draws, doubled
    up to 64 until two standard errors are within 0.05 dB."""
    h = heard(spark, folder).withColumn("bound", F.pow(F.lit(10.0), F.col("power_db") / 10) / F.col("distance_m"))
    h = h.withColumn("value", energy(F.col("level_db")))
    return selection.estimate_until(h, ["record_id"], "bound", "value", "point_id", 10**0.005 - 1, 4, 64)


def T3_loudest(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred loudest pairs of all."""
    h = heard(spark, folder).orderBy(F.desc("level_db"), "record_id", "point_id")
    return h.limit(100).select("record_id", "point_id", "level_db")


def P22_second_loudest(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("level_db"), F.col("point_id")]
    return selection.top_k(heard(spark, folder), ["record_id"], order, 2).where("rank = 2").select("record_id", "point_id")


def A48_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces by period for each kind, as columns."""
    h = heard(spark, folder).withColumn("kind", F.coalesce("kind", F.lit("none")))
    return h.groupBy("kind").agg(
        *[F.count(F.when(F.col("period") == p, 1)).alias(n) for p, n in enumerate(("day", "evening", "night"))]
    )


def D10_reception(spark: SparkSession, folder: str) -> DataFrame:
    """Level at 1 kHz with the absorption of air at 10 degrees and 70 %."""
    h = heard(spark, folder)
    loss = air_absorption_db_per_m(1000.0, F.lit(10.0), F.lit(70.0)) * F.col("distance_m")
    best = h.groupBy("record_id").agg(F.max(F.col("level_db") - loss).alias("x"))
    return best.select("record_id", rounded(F.col("x"), 3).alias("level_db"))


def D11_absorption(spark: SparkSession, folder: str) -> DataFrame:
    """Absorption of the octave bands by temperature and humidity, dB a kilometre."""
    grid = spark.range(0, 8 * 5 * 9).select(
        (63 * F.pow(F.lit(2.0), F.col("id") % 8)).alias("hz"),
        (F.floor(F.col("id") / 8) % 5 * 10 - 10).cast("double").alias("celsius"),
        (F.floor(F.col("id") / 40) * 10 + 10).cast("double").alias("humidity"),
    )
    x = air_absorption_db_per_m(F.col("hz"), F.col("celsius"), F.col("humidity")) * 1000
    return grid.select("hz", "celsius", "humidity", rounded(x, 3).alias("db_km"))


def A4_a_weighting(spark: SparkSession, folder: str) -> DataFrame:
    """A-weighted level of the first eight values of each vector, read as band levels 50 + 10 x, as its SQL has it
    (see A4_a_weighting_all)."""
    bands = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 10 + 50)
    out = table(spark, folder, "embeddings").select("vec_id", level(a_weighted(bands)).alias("x"))
    return out.select("vec_id", rounded(F.col("x"), 3).alias("level_dba"))


def A4_a_weighting_all(spark: SparkSession, folder: str) -> DataFrame:
    """A-weighted level of each eight values of each vector, read as band levels 50 + 10 x."""
    bands = F.transform("embedding", lambda x: x.cast("double") * 10 + 50)
    parts = F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 8).cast("int"))
    e = table(spark, folder, "embeddings").where(F.size("embedding") > 0).select("vec_id", bands.alias("b"), F.explode(parts).alias("part"))
    x = level(a_weighted(F.slice("b", F.col("part") * 8 + 1, F.lit(8))))
    return e.select("vec_id", "part", rounded(x, 3).alias("level_dba"))


def J13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest record within 5 km of each runway point; the smaller id on a tie (to the millimetre)."""
    near = pairs_within(pieces(spark, folder), receivers(spark, folder), 5000.0, "point_id", "record_id", ("p_lat", "p_lon"))
    near = near.withColumn("mm", F.floor(F.col("distance_m") * 1000 + 0.5))
    best = ranges.nearest_within(near, "left_id", [F.col("mm"), F.col("right_id")], ["right_id"])
    return best.select(F.col("left_id").alias("point_id"), F.col("right_id").alias("record_id"))


def J29_reach_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds are heard within 8 km, other points within 3 km: each class is joined in its own radius."""
    r, p = receivers(spark, folder), pieces(spark, folder)
    far = F.coalesce(F.col("kind") == "threshold", F.lit(False))
    parts = [
        pairs_within(r, p.where(c), m, "record_id", "point_id", right_at=("p_lat", "p_lon"))
        for c, m in ((far, 8000.0), (~far, 3000.0))
    ]
    return parts[0].unionByName(parts[1]).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("point_id"))


def J42_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Records within 500 m of each record, itself included: their number and rated power."""
    r = receivers(spark, folder)
    near = pairs_within(r, r, 500.0, "record_id", "record_id")
    power = F.when(F.col("power_kw").between(1, 20000), F.col("power_kw")).otherwise(0.0)
    weights = r.select(F.col("record_id").alias("right_id"), power.alias("w"))
    out = near.join(weights, "right_id").groupBy("left_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    return out.select(F.col("left_id").alias("record_id"), "n", rounded(F.col("w"), 2).alias("power_kw"))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "register_units").select("unit_id", "latitude", "longitude", "capacity_mw")


def J14_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Units with a record within 100 m whose power lies within a tenth of theirs."""
    also = F.abs(F.col("power_kw") - F.col("capacity_mw") * 1000) <= 0.1 * F.col("power_kw")
    r = receivers(spark, folder).select("lat", "lon", "power_kw")
    out = ranges.distance_join(_units(spark, folder), r, 100.0, ("latitude", "longitude"), ("lat", "lon"), "semi", also)
    return out.select("unit_id")


def J23_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Units without any record within 300 m."""
    r = receivers(spark, folder).select("lat", "lon")
    return ranges.distance_join(
        _units(spark, folder), r, 300.0, ("latitude", "longitude"), ("lat", "lon"), "anti"
    ).select("unit_id")


def J25_highest(spark: SparkSession, folder: str) -> DataFrame:
    """The highest number of a runway point within 5 km of each record, -1 without one."""
    r, p = receivers(spark, folder), pieces(spark, folder)
    near = pairs_within(r, p, 5000.0, "record_id", "point_id", right_at=("p_lat", "p_lon"))
    top = near.join(p.select(F.col("point_id").alias("right_id"), "seq"), "right_id").groupBy("left_id").agg(F.max("seq").alias("s"))
    out = r.join(top.withColumnRenamed("left_id", "record_id"), "record_id", "left")
    return out.select("record_id", F.coalesce("s", F.lit(-1)).alias("tier"))


def _outlines(spark: SparkSession, folder: str) -> DataFrame:
    """A box around each aerodrome's points, as a ring. Longitudes are turned to within half a turn of the aerodrome's
    first point, so x1 may lie beyond 180; `whole` says that no point was turned and that the box is under 5 degrees."""
    p = pieces(spark, folder)
    p = p.join(p.groupBy("airport").agg(F.min(F.struct("point_id", "p_lon"))["p_lon"].alias("from")), "airport")
    turned = F.col("p_lon") + 360.0 * F.round((F.col("from") - F.col("p_lon")) / 360.0)
    p = p.groupBy("airport").agg(
        (F.min(turned) - 0.05).alias("x0"), (F.max(turned) + 0.05).alias("x1"),
        (F.min("p_lat") - 0.05).alias("y0"), (F.max("p_lat") + 0.05).alias("y1"), F.bool_and(turned == F.col("p_lon")).alias("whole"),
    ).withColumn("whole", F.expr("whole and x1 - x0 < 5 and y1 - y0 < 5"))
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners])
    return p.withColumn("ring", ring)


def J20_inside_all(spark: SparkSession, folder: str) -> DataFrame:
    """Records inside an aerodrome's outline: cells of a degree, modulo 360, that its box meets, then the ray test with
    the record turned to the box."""
    o = _outlines(spark, folder)
    xs = F.transform(F.sequence(F.floor("x0").cast("int"), F.floor("x1").cast("int")), lambda c: F.pmod(c, F.lit(360)))
    o = o.withColumn("cx", F.explode(F.array_distinct(xs)))
    o = o.withColumn("cy", F.explode(F.sequence(F.floor("y0").cast("int"), F.floor("y1").cast("int"))))
    r = receivers(spark, folder).withColumn("cx", F.pmod(F.floor("lon"), F.lit(360)).cast("int"))
    hit = r.withColumn("cy", F.floor("lat").cast("int")).join(o.select("airport", "x0", "ring", "cx", "cy"), ["cx", "cy"])
    lon = F.col("lon") - 360.0 * F.floor((F.col("lon") - F.col("x0")) / 360.0)
    return hit.where(inside(lon, F.col("lat"), F.col("ring"))).select("record_id", "airport")


def J20_inside(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: longitudes as written, without the aerodromes across the 180th meridian (see J20_inside_all)."""
    o = _outlines(spark, folder).where("whole")
    spans = [F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))) for a, b in (("x0", "x1"), ("y0", "y1"))]
    o = o.withColumn("cx", spans[0]).withColumn("cy", spans[1]).select("airport", "ring", "cx", "cy")
    r = receivers(spark, folder).withColumn("cx", F.floor("lon").cast("int")).withColumn("cy", F.floor("lat").cast("int"))
    hit = r.join(o, ["cx", "cy"]).where(inside(F.col("lon"), F.col("lat"), F.col("ring")))
    return hit.select("record_id", "airport")


def S30_area_all(spark: SparkSession, folder: str) -> DataFrame:
    return _outlines(spark, folder).select("airport", rounded(ring_area(F.col("ring"))).alias("area"))


def S30_area(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: without the aerodromes across the 180th meridian (see S30_area_all)."""
    return _outlines(spark, folder).where("whole").select("airport", rounded(ring_area(F.col("ring"))).alias("area"))


def J7_squares_all(spark: SparkSession, folder: str) -> DataFrame:
    """The zoom-9 squares that each aerodrome's box meets, their columns modulo 512."""
    o, (_, ay), (_, by) = _outlines(spark, folder), tile(F.col("y1"), F.col("x0"), 9), tile(F.col("y0"), F.col("x1"), 9)
    ax, bx = (F.floor((F.col(x) + 180.0) / 360.0 * 512).cast("int") for x in ("x0", "x1"))
    xs = F.array_distinct(F.transform(F.sequence(ax, bx), lambda c: F.pmod(c, F.lit(512))))
    o = o.select("airport", F.explode(xs).alias("x"), ay.alias("ay"), by.alias("by"))
    return o.select("airport", "x", F.explode(F.sequence("ay", "by")).alias("y"))


def J7_squares(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: without the aerodromes across the 180th meridian (see J7_squares_all)."""
    o = _outlines(spark, folder).where("whole")
    (ax, ay), (bx, by) = tile(F.col("y1"), F.col("x0"), 9), tile(F.col("y0"), F.col("x1"), 9)
    o = o.select("airport", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).where("bx >= ax")
    o = o.withColumn("x", F.explode(F.sequence("ax", "bx"))).withColumn("y", F.explode(F.sequence("ay", "by")))
    return o.select("airport", "x", "y")


def F_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Records by zoom-12 tile and the zoom-9 square that stores it."""
    x, y = tile(F.col("lat"), F.col("lon"), 12)
    t = receivers(spark, folder).select(x.alias("x"), y.alias("y"))
    return t.groupBy("x", "y", F.shiftright("x", 3).alias("sx"), F.shiftright("y", 3).alias("sy")).agg(
        F.count(F.lit(1)).alias("n")
    )


def F_local_frame(spark: SparkSession, folder: str) -> DataFrame:
    """East and north of each runway point from its aerodrome's first point, in metres."""
    p = pieces(spark, folder)
    first = p.groupBy("airport").agg(F.min(F.struct("point_id", "p_lat", "p_lon")).alias("o"))
    j = p.join(first, "airport")
    east, north = local_metres(F.col("p_lat"), F.col("p_lon"), F.col("o.p_lat"), F.col("o.p_lon"))
    return j.select("point_id", rounded(east, 2).alias("east"), rounded(north, 2).alias("north"))


def F_wrap(spark: SparkSession, folder: str) -> DataFrame:
    p = pieces(spark, folder)
    return p.select("point_id", rounded(wrap_lon(F.col("p_lon") + 200.0), 7).alias("lon"))


def J38_same_place(spark: SparkSession, folder: str) -> DataFrame:
    """Runway points drawn twice: the nearest other point within 30 m."""
    p = pieces(spark, folder)
    near = pairs_within(p, p, 30.0, "point_id", "point_id", ("p_lat", "p_lon"), ("p_lat", "p_lon"))
    near = near.where("left_id <> right_id").withColumn("mm", F.floor(F.col("distance_m") * 1000 + 0.5))
    best = ranges.nearest_within(near, "left_id", [F.col("mm"), F.col("right_id")], ["right_id"])
    return best.select(F.col("left_id").alias("point_id"), F.col("right_id").alias("twin"))


def F_octants(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest piece by compass octant of each receiver, in whole metres."""
    h = heard(spark, folder).select("record_id", "point_id", "distance_m")
    at = h.join(receivers(spark, folder).select("record_id", "lat", "lon"), "record_id")
    at = at.join(pieces(spark, folder).select("point_id", "p_lat", "p_lon"), "point_id")
    east, north = local_metres(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    octant = F.floor(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)) / 45).cast("int")
    return at.groupBy("record_id", octant.alias("octant")).agg(F.floor(F.min("distance_m")).alias("nearest_m"))


QUERIES = {
    q.__name__: q
    for q in (
        lden_top3, J28_pairs, P11_loud_enough, A2_total_level, A3_lden, A17_contributors, A20_rest_row, A22_whole_percents,
        T7_until_omitted, T6_by_direction, T8_sampled, T3_loudest, P22_second_loudest, A48_by_kind, D10_reception,
        D11_absorption, A4_a_weighting, A4_a_weighting_all, J13_nearest, J29_reach_classes, J42_neighbours, J14_copies, J23_unmatched,
        J25_highest, J20_inside, J20_inside_all, S30_area, S30_area_all, J7_squares, J7_squares_all, F_tiles, F_local_frame, F_wrap, J38_same_place, F_octants,
    )
}


def _gap(a: str, b: str, c: str, d: str) -> str:
    return (
        f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({a} - {c}) / 2), 2) + "
        f"cos(radians({a})) * cos(radians({c})) * pow(sin(radians({b} - {d}) / 2), 2))))"
    )


def _floor(x: str, places: int = 3) -> str:
    return f"floor(({x}) * {10**places}.0 + 0.5) / {10**places}.0"


_RP = """with r as (select record_id, lat, lon, power_kw from turbines where abs(lat) <= 90 and not isnan(lat) and lon is not null and not isnan(lon)),
    p as (select point_id, airport, kind, seq, lat as p_lat, lon as p_lon, (point_id % 30 + 70)::double as power_db, (point_id % 6)::int as layer,
    (point_id % 3)::int as period from runway_points where abs(lat) <= 90 and not isnan(lat) and lon is not null and not isnan(lon))"""
_H = f"""{_RP}, near as (select *, {_gap('lat', 'lon', 'p_lat', 'p_lon')} as d from r, p where abs(lat - p_lat) < 0.11),
    h as (select *, d as distance_m, {_floor('power_db - 20 * log10(greatest(d, 1.0)) - 11')} as level_db from near where d <= 12000)"""
_E = "exp(level_db * (ln(10) / 10))"
_W = "(case period when 0 then 0.5 when 1 then 4 / 24.0 * pow(10, 0.5) else 8 / 24.0 * 10 end)"
_C = f"""{_H}, c as (select record_id, airport, sum(cast(floor({_E} * {_W} * 1e6 + 0.5) as bigint))::bigint as e, arg_min(point_id, {{'a': d, 'b': point_id}}) as nearest, count(*) as n
    from h group by record_id, airport)"""
_ABS = """(8.686 * f * f * (1.84e-11 * sqrt(w) + pow(w, -2.5) * (0.01275 * exp(-2239.1 / t) / (o + f * f / o) + 0.1068 * exp(-3352.0 / t) / (n + f * f / n))))"""


def _air(source: str) -> str:
    """Columns f (Hz), c (Celsius) and hum (percent) with the terms of the absorption."""
    return f"""(select *, (24 + 4.04e4 * h * (0.02 + h) / (0.391 + h)) as o, pow(w, -0.5) * (9 + 280 * h * exp(-4.170 * (pow(w, -1 / 3.0) - 1))) as n
        from (select *, c + 273.15 as t, (c + 273.15) / 293.15 as w, hum * pow(10, -6.8346 * pow(273.16 / (c + 273.15), 1.261) + 4.6151) as h from ({source})))"""


_BOX = f"""{_RP}, o as (select airport, min(p_lon) - 0.05 as x0, max(p_lon) + 0.05 as x1, min(p_lat) - 0.05 as y0, max(p_lat) + 0.05 as y1 from p group by airport
    having x1 - x0 < 5 and y1 - y0 < 5)"""


def _tile(lat: str, lon: str, zoom: int) -> tuple[str, str]:
    n = 2**zoom
    x = f"(({lon} + 180.0) / 360.0 * {n})"
    phi = f"radians(greatest(least({lat}, 85.0511), -85.0511))"
    y = f"((1 - asinh(tan({phi})) / pi()) / 2 * {n})"
    return f"cast(floor({x} - {n} * floor({x} / {n})) as int)", f"greatest(least(cast(floor({y}) as int), {n - 1}), 0)"


def _metres(lat: str, lon: str, lat0: str, lon0: str) -> tuple[str, str]:
    w = f"(1 - 0.00669437999014 * pow(sin(radians({lat0})), 2))"
    dx = f"({lon} - {lon0} + 180.0 - 360.0 * floor(({lon} - {lon0} + 180.0) / 360.0) - 180.0)"
    return (
        f"(radians({dx}) * 6378137.0 / sqrt({w}) * cos(radians({lat0})))",
        f"(radians({lat} - {lat0}) * 6378137.0 * (1 - 0.00669437999014) / pow({w}, 1.5))",
    )


_EN = _metres("p_lat", "p_lon", "o.p_lat", "o.p_lon")
_OCT = _metres("p_lat", "p_lon", "lat", "lon")
SQL = {
    "J28_pairs": f"{_H} select record_id, count(*) as pieces, {_floor('min(d)', 2)} as nearest_m from h group by record_id",
    "P11_loud_enough": f"{_H} select record_id, point_id, level_db from h where level_db >= 10 and d <= 8000",
    "A2_total_level": f"{_H} select record_id, {_floor(f'10 * log10(sum({_E}))')} as level_db from h group by record_id",
    "A3_lden": f"{_H} select record_id, layer, {_floor(f'10 * log10(sum({_E} * {_W}))')} as lden_db from h group by record_id, layer",
    "A17_contributors": f"{_C} select * from c",
    "lden_top3": f"""{_C}, s as (select *, e / nullif(sum(e) over (partition by record_id), 0) as share, row_number() over (partition by record_id order by e desc, airport) as rank from c)
        select record_id, rank, airport, {_floor('10 * log10(nullif(e, 0) / 1e6)')} as lden_db, {_floor('share', 4)} as share from s where rank <= 3""",
    "A20_rest_row": f"""{_C}, k as (select *, row_number() over (partition by record_id order by e desc, airport) as k from c)
        select record_id, case when k <= 1 then airport else 'rest' end as row, sum(e)::bigint as e, count(*) as members from k group by 1, 2""",
    "A22_whole_percents": f"""{_C}, s as (select *, {_floor('e / nullif(sum(e) over (partition by record_id), 0)', 6)} as share from c),
        f as (select *, floor(share * 100) as b, share * 100 - floor(share * 100) as rest from s where share is not null),
        k as (select *, 100 - sum(b) over (partition by record_id) as l, row_number() over (partition by record_id order by rest desc, airport) as k from f)
        select record_id, airport, cast(b + case when k <= l then 1 else 0 end as int) as percent from k""",
    "T7_until_omitted": f"""{_H}, b as (select record_id, point_id, floor({_E} * 1e6 + 0.5) as x from h), w as (select *, sum(x) over (partition by record_id) as t,
        coalesce(sum(x) over (partition by record_id order by x desc, point_id rows between unbounded preceding and 1 preceding), 0) as a from b)
        select record_id, point_id from w where t - a > 0.0233 * a""",
    "T6_by_direction": f"""{_H}, b as (select record_id, layer, point_id, floor({_E} * 1e6 + 0.5) as x from h qualify row_number() over (partition by record_id, layer order by x desc, point_id) = 1),
        w as (select *, sum(x) over (partition by record_id) as t, coalesce(sum(x) over (partition by record_id order by x desc, point_id rows between unbounded preceding and 1 preceding), 0) as a from b)
        select record_id, layer, point_id from w where t - a > 0.1 * t""",
    "T3_loudest": f"{_H} select record_id, point_id, level_db from h order by level_db desc, record_id, point_id limit 100",
    "P22_second_loudest": f"{_H} select record_id, point_id from h qualify row_number() over (partition by record_id order by level_db desc, point_id) = 2",
    "A48_by_kind": f"""{_H} select coalesce(kind, 'none') as kind, count(*) filter (where period = 0) as day, count(*) filter (where period = 1) as evening,
        count(*) filter (where period = 2) as night from h group by 1""",
    "D10_reception": f"""{_H} select record_id, {_floor(f'max(level_db - {_ABS} * d)')} as level_db from h, {_air('select 1000.0::double as f, 10.0::double as c, 70.0::double as hum')} group by record_id""",
    "D11_absorption": f"""select f as hz, c as celsius, hum as humidity, {_floor(f'{_ABS} * 1000')} as db_km from
        {_air('select 63 * pow(2.0, a)::double as f, (b * 10 - 10)::double as c, (d * 10 + 10)::double as hum from range(8) x(a), range(5) y(b), range(9) z(d)')}""",
    "A4_a_weighting": f"""select vec_id, {_floor("10 * log10(" + " + ".join(f"exp((embedding[{i + 1}]::double * 10 + 50 + {w}) * (ln(10) / 10))" for i, w in enumerate((-26.2, -16.1, -8.6, -3.2, 0.0, 1.2, 1.0, -1.1))) + ")")} as level_dba from embeddings""",
    "J13_nearest": f"""{_RP}, n as (select *, {_gap('lat', 'lon', 'p_lat', 'p_lon')} as d from r, p where abs(lat - p_lat) < 0.05)
        select point_id, arg_min(record_id, {{'a': floor(d * 1000 + 0.5), 'b': record_id}}) as record_id from n where d <= 5000 group by point_id""",
    "J29_reach_classes": f"""{_RP}, n as (select *, {_gap('lat', 'lon', 'p_lat', 'p_lon')} as d from r, p where abs(lat - p_lat) < 0.08)
        select record_id, point_id from n where d <= case when kind = 'threshold' then 8000 else 3000 end""",
    "J42_neighbours": f"""{_RP}, n as (select a.record_id, b.power_kw, {_gap('a.lat', 'a.lon', 'b.lat', 'b.lon')} as d from r a, r b where abs(a.lat - b.lat) < 0.005)
        select record_id, count(*) as n, {_floor("sum(case when power_kw between 1 and 20000 then power_kw else 0 end)", 2)} as power_kw from n where d <= 500 group by record_id""",
    "J14_copies": f"""{_RP} select unit_id from register_units u where exists (select 1 from r where {_gap('u.latitude', 'u.longitude', 'r.lat', 'r.lon')} <= 100
        and abs(r.power_kw - u.capacity_mw * 1000) <= 0.1 * r.power_kw)""",
    "J23_unmatched": f"{_RP} select unit_id from register_units u where not exists (select 1 from r where {_gap('u.latitude', 'u.longitude', 'r.lat', 'r.lon')} <= 300)",
    "J25_highest": f"""{_RP}, n as (select record_id, seq, {_gap('lat', 'lon', 'p_lat', 'p_lon')} as d from r, p where abs(lat - p_lat) < 0.05),
        t as (select record_id, max(seq) as s from n where d <= 5000 group by record_id) select record_id, coalesce(s, -1) as tier from r left join t using (record_id)""",
    "J20_inside": f"{_BOX} select record_id, airport from r join o on lon > x0 and lon < x1 and lat > y0 and lat < y1",
    "S30_area": f"{_BOX} select airport, {_floor('(x1 - x0) * (y1 - y0)', 4)} as area from o",
    "J7_squares": f"""{_BOX}, t as (select airport, {_tile('y1', 'x0', 9)[0]} as ax, {_tile('y1', 'x0', 9)[1]} as ay, {_tile('y0', 'x1', 9)[0]} as bx, {_tile('y0', 'x1', 9)[1]} as b_y from o)
        select airport, unnest(range(ax, bx + 1))::int as x, y from (select *, unnest(range(ay, b_y + 1))::int as y from t where bx >= ax)""",
    "F_tiles": f"""{_RP}, t as (select {_tile('lat', 'lon', 12)[0]} as x, {_tile('lat', 'lon', 12)[1]} as y from r) select x, y, x >> 3 as sx, y >> 3 as sy, count(*) as n from t group by x, y""",
    "F_local_frame": f"""{_RP}, o as (select airport, min(point_id) as point_id from p group by airport), q as (select o.airport, p.p_lat, p.p_lon from o join p using (point_id))
        select p.point_id, {_floor(_EN[0].replace('(p_', '(p.p_').replace('(radians(p_', '(radians(p.p_').replace(' p_', ' p.p_'), 2)} as east, {_floor(_EN[1].replace('(p_', '(p.p_'), 2)} as north from p join q o using (airport)""",
    "F_wrap": f"{_RP} select point_id, {_floor('(p_lon + 380.0) - 360.0 * floor((p_lon + 380.0) / 360.0) - 180.0', 7)} as lon from p",
    "J38_same_place": f"""{_RP}, n as (select a.point_id, b.point_id as twin, {_gap('a.p_lat', 'a.p_lon', 'b.p_lat', 'b.p_lon')} as d from p a, p b where a.point_id <> b.point_id and abs(a.p_lat - b.p_lat) < 0.001)
        select point_id, arg_min(twin, {{'a': floor(d * 1000 + 0.5), 'b': twin}}) as twin from n where d <= 30 group by point_id""",
    "F_octants": f"""{_H}, a as (select record_id, d, degrees(atan2({_OCT[0]}, {_OCT[1]})) as b from h)
        select record_id, cast(floor((b - 360.0 * floor(b / 360.0)) / 45) as int) as octant, cast(floor(min(d)) as bigint) as nearest_m from a group by 1, 2""",
}
