"""Range, overlap and matching joins, predicates on fixes, and progressive answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.levels import rounded
from sonolith.operators import graphs, kept, meetings, ranges
from sonolith.operators.nearby import pairs_within
from sonolith.plans.noise import pieces, receivers
from sonolith.plans.tracks import fixes
from sonolith.sources import table


def P1_sane(spark: SparkSession, folder: str) -> DataFrame:
    """Turbine positions that a fix could have: finite, on the globe, not 0 and 0, with a height in range if it has one."""
    t = table(spark, folder, "turbines")
    place = F.abs("lat").between(0, 90) & F.abs("lon").between(0, 180) & ~F.isnan("lat") & ~F.isnan("lon")
    height = F.coalesce(F.col("hub_m").between(-600, 21000) & ~F.isnan("hub_m"), F.lit(True))
    return t.where(place & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & height).select("record_id")


def P2_keepable(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbours at least 10 kt apart, in time order, with a change a second below the state's cap."""
    w = Window.partitionBy("address").orderBy("t", "id")
    f = fixes(spark, folder).withColumn("t0", F.lag("t").over(w)).withColumn("s0", F.lag("speed").over(w))
    dt, ds = F.col("t") - F.col("t0"), F.abs(F.col("speed") - F.col("s0"))
    cap = F.when(F.col("resting"), 0.05).otherwise(0.2)
    return f.where((dt > 0) & (ds >= 10) & (ds <= cap * dt)).select("id")


def P4_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Aerodromes whose box touches a box of a list of scopes."""
    scopes = F.split(F.lit("-130,20,-60,50;-10,35,30,60"), ";")
    boxes = F.transform(scopes, lambda s: F.transform(F.split(s, ","), lambda x: x.cast("double")))
    p = pieces(spark, folder).groupBy("airport").agg(
        F.min("p_lon").alias("x0"), F.min("p_lat").alias("y0"), F.max("p_lon").alias("x1"), F.max("p_lat").alias("y1")
    )
    meets = F.exists(boxes, lambda b: (F.col("x0") <= b[2]) & (F.col("x1") >= b[0]) & (F.col("y0") <= b[3]) & (F.col("y1") >= b[1]))
    return p.where(meets).select("airport")


def J3_echoes(spark: SparkSession, folder: str) -> DataFrame:
    """Secondary fixes that follow a primary vehicle: within 30 minutes and 40 kt of one of its fixes, in at least four
    different hours. The pairs of fixes are counted where they meet, as they outnumber the fixes by far."""
    f = fixes(spark, folder).select("secondary", F.col("address").alias("key"), "t", F.col("speed").alias("v"))
    met = meetings.met_often(f.where("secondary"), f.where(~F.col("secondary")), 1800, 40.0, 3600, 4)
    return met.toDF("echo", "address", "hours")


def J8_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Steps between neighbouring fixes (hours, kt) cut at the edges of squares of 24 h, with the piece's share."""
    w = Window.partitionBy("address").orderBy("t", "id")
    f = fixes(spark, folder).withColumn("a", F.lag("t").over(w) / 3600.0).withColumn("b", F.col("t") / 3600.0)
    f = f.where("b > a")
    lo, hi = F.floor(F.col("a") / 24).cast("int"), F.floor(F.col("b") / 24).cast("int")
    f = f.withColumn("square", F.explode(F.sequence(lo, hi)))
    part = F.least(F.col("b"), (F.col("square") + 1) * 24.0) - F.greatest(F.col("a"), F.col("square") * 24.0)
    return f.where(part > 0).select("id", "square", rounded(part / (F.col("b") - F.col("a")), 6).alias("share"))


def J10_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Legs (orders of a customer, 40 days long) over lines (months): clipped overlaps, scaled to the leg where they sum
    to more than its length."""
    o = table(spark, folder, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1995-01-01")).alias("a"))
    legs = o.withColumn("b", F.col("a") + 40)
    lines = spark.range(0, 120).select(F.col("id").alias("line"), (F.col("id") * 25).alias("c"), (F.col("id") * 25 + 35).alias("d"))
    spread = lines.withColumn("k", F.explode(F.sequence(F.floor(F.col("c") / 50), F.floor(F.col("d") / 50))))
    probes = legs.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / 50), F.floor(F.col("b") / 50))))
    j = probes.join(spread, "k").dropDuplicates(["o_orderkey", "line"])
    over = F.least("b", "d") - F.greatest("a", "c")
    j = j.withColumn("over", over).where("over > 0").withColumn("sum", F.sum("over").over(Window.partitionBy("o_orderkey")))
    scale = F.when(F.col("sum") > 40, F.lit(40.0) / F.col("sum")).otherwise(1.0)
    return j.groupBy("line").agg(rounded(F.sum(F.floor(F.col("over") * scale * 1000 + 0.5)) / 1000, 3).alias("length"))


def J26_paired(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one pairs of records and register units at most 300 m apart, nearest first. Pairs are grouped by the
    components that they form, so that each group is small and walked alone."""
    units = table(spark, folder, "register_units").select("unit_id", "latitude", "longitude")
    near = pairs_within(receivers(spark, folder), units, 300.0, "record_id", "unit_id", right_at=("latitude", "longitude"))
    near = near.select(F.col("left_id").alias("record_id"), F.col("right_id").alias("unit_id"), "distance_m")
    parts = graphs.components(near.select(F.col("record_id").alias("a"), F.col("unit_id").alias("b")))
    grouped = near.join(parts.withColumnRenamed("node", "record_id"), "record_id")
    out = kept.greedy_pairs(grouped, "component", "record_id", "unit_id", "distance_m")
    return out.select("record_id", "unit_id")


def J12_fitting(spark: SparkSession, folder: str) -> DataFrame:
    """The runway end that fits a low point best: nearest threshold within 10 km, by distance and then by number."""
    ends = pieces(spark, folder).where("kind = 'threshold'").select(F.col("point_id").alias("end_id"), "p_lat", "p_lon")
    j = ranges.distance_join(receivers(spark, folder).select("record_id", "lat", "lon"), ends, 10000.0, right_at=("p_lat", "p_lon"))
    metre = F.floor(F.col("distance_m") + 0.5)
    return ranges.nearest_within(j, "record_id", [metre, F.col("end_id")], ["end_id"])


def rings(spark: SparkSession, folder: str, steps: tuple[float, ...] = (3000.0, 6000.0, 12000.0)):
    """Progressive answers: for each ring a complete answer of what lies within it; the last isn't partial."""
    for i, radius in enumerate(steps):
        near = pairs_within(receivers(spark, folder), pieces(spark, folder), radius, "record_id", "point_id", right_at=("p_lat", "p_lon"))
        counts = near.groupBy(F.col("left_id").alias("record_id")).agg(F.count(F.lit(1)).alias("pieces"))
        yield counts.select(F.lit(i).alias("ring"), F.lit(i + 1 < len(steps)).alias("partial"), "record_id", "pieces")


def X1_rings(spark: SparkSession, folder: str) -> DataFrame:
    """All answers of the rings together."""
    out = None
    for answer in rings(spark, folder):
        out = answer if out is None else out.unionByName(answer)
    return out


QUERIES = {q.__name__: q for q in (P1_sane, P2_keepable, P4_scope, J3_echoes, J8_cut, J10_overlap, J12_fitting, J26_paired, X1_rings)}

_F = """with f as (select user_id as address, cast(floor(epoch(ts)) as bigint) as t, value as speed, event_id % 4 = 0 as secondary,
    event_type in ('signup', 'error') as resting, event_id as id from events)"""
_W = "over (partition by address order by t, id)"
_PLACES = """with r as (select record_id, lat, lon from turbines where abs(lat) <= 90 and not isnan(lat) and lon is not null and not isnan(lon)),
    p as (select point_id, airport, kind, lat as p_lat, lon as p_lon from runway_points where abs(lat) <= 90 and not isnan(lat) and lon is not null and not isnan(lon)),
    n as (select *, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - p_lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(lon - p_lon) / 2), 2)))) as d
    from r, p where abs(lat - p_lat) < 0.11)"""
SQL = {
    "P1_sane": """select record_id from turbines where abs(lat) <= 90 and abs(lon) <= 180 and not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0)
        and coalesce(hub_m between -600 and 21000 and not isnan(hub_m), true)""",
    "P2_keepable": f"""{_F}, p as (select *, lag(t) {_W} as t0, lag(speed) {_W} as s0 from f) select id from p where t > t0 and abs(speed - s0) >= 10
        and abs(speed - s0) <= case when resting then 0.05::double else 0.2::double end * (t - t0)""",
    "P4_scope": f"""{_PLACES}, b as (select airport, min(p_lon) as x0, min(p_lat) as y0, max(p_lon) as x1, max(p_lat) as y1 from p group by 1)
        select airport from b where (x0 <= -60 and x1 >= -130 and y0 <= 50 and y1 >= 20) or (x0 <= 30 and x1 >= -10 and y0 <= 60 and y1 >= 35)""",
    "J3_echoes": f"""{_F} select a.address as echo, b.address, count(distinct a.t // 3600) as hours from f a join f b on a.secondary and not b.secondary and a.address <> b.address
        and abs(a.t - b.t) <= 1800 and abs(a.speed - b.speed) <= 40 group by 1, 2 having count(distinct a.t // 3600) >= 4""",
    "J8_cut": f"""{_F}, s as (select id, lag(t) {_W} / 3600.0::double as a, t / 3600.0::double as b from f), k as (select *, unnest(range(cast(floor(a / 24) as bigint), cast(floor(b / 24) as bigint) + 1)) as square from s where b > a and b - a < 240),
        p as (select *, least(b, (square + 1) * 24.0) - greatest(a, square * 24.0) as part from k) select id, square::int as square, floor(part / (b - a) * 1000000 + 0.5) / 1000000 as share from p where part > 0""",
    "J10_overlap": """with l as (select o_orderkey, date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as a from orders), m as (select x as line, x * 25 as c, x * 25 + 35 as d from range(120) t(x)),
        j as (select o_orderkey, line, least(a + 40, d) - greatest(a, c) as o from l join m on least(a + 40, d) - greatest(a, c) > 0), s as (select *, sum(o) over (partition by o_orderkey) as t from j)
        select line, floor(sum(floor(o * case when t > 40 then 40.0::double / t else 1 end * 1000 + 0.5)) / 1000 * 1000 + 0.5) / 1000 as length from s group by line""",
    "J12_fitting": f"{_PLACES} select record_id, arg_min(point_id, {{'a': floor(d + 0.5), 'b': point_id}}) as end_id from n where d <= 10000 and kind = 'threshold' group by 1",
    "X1_rings": " union all ".join(
        f"select {i} as ring, {i < 2} as partial, record_id, count(*) as pieces from ({_PLACES} select record_id from n where d <= {m}) group by record_id" for i, m in enumerate((3000, 6000, 12000))),
}
