"""Emission and bounds of sources, stencils and distances on rasters, stretches and ends of tracks, and trees of roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions import emission as e
from sonolith.functions.geo import distance_m
from sonolith.functions.levels import A_WEIGHT_DB, level, rounded
from sonolith.operators import graphs, grids, ranges, selection, sequences
from sonolith.plans.noise import _floor, _gap, _H, heard, receivers
from sonolith.plans.tracks import fixes
from sonolith.sources import table

#: Absorption of air at 10 degrees and 70 % (dB a km, ISO 9613-1) of the octave bands 63 Hz - 8 kHz.
AIR_DB_KM = (0.1, 0.4, 1.0, 1.9, 3.7, 9.7, 32.8, 117.0)
SIDE = 128


def D1_road(spark: SparkSession, folder: str) -> DataFrame:
    """Sound power of a metre of each piece by octave band, from its counts and speeds (heavy vehicles 80 at most), with
    slope and junction from its number, at 10 degrees and 5 % electric cars."""
    d = table(spark, folder, "display")
    speed = F.coalesce("speed_kmh", F.lit(50.0))
    heavy = F.least(speed, F.lit(80.0))
    flows = {c: (F.col(f"aadt_{c}") / 24, heavy if c in ("medium", "heavy") else speed) for c in e.CATEGORIES}
    number = F.coalesce("piece_no", F.lit(0))
    conditions = [
        (number % 9 - 4) * 2.0, number % 2 == 1, (F.col("piece_id") % 300).cast("double"), F.lit(10.0),
        F.coalesce("surface_corr_db", F.lit(0.0)), F.lit(0.05),
    ]
    bands = d.select("piece_id", F.posexplode(e.road_energy(flows, *conditions)).alias("band", "x"))
    return bands.where("x > 0").select("piece_id", "band", rounded(level(F.col("x")), 3).alias("level_db"))


def D7_power(spark: SparkSession, folder: str) -> DataFrame:
    """Sound power (dB(A)) of turbines, and of units read as solar farms of two hectares, as substations and as works."""
    t = table(spark, folder, "turbines").select(
        F.lit("wind").alias("kind"), F.col("record_id").alias("id"), e.turbine_dba(F.when(F.col("power_kw") <= 8000, F.col("power_kw"))).alias("x")
    )
    u, mw = table(spark, folder, "register_units"), F.col("capacity_mw")
    kinds = {
        "solar": e.solar_dba(mw, F.lit(20_000.0)),
        "substation": e.substation_dba(F.coalesce(F.when((mw > 0) & ~F.isnan(mw), mw), F.lit(2.0))),
        "works": e.area_law_dba(F.lit(60.0), F.coalesce(F.when(~F.isnan(mw), mw), F.lit(0.0)) * 50_000, 500_000),
    }
    for kind, x in kinds.items():
        t = t.unionByName(u.select(F.lit(kind).alias("kind"), F.col("unit_id").alias("id"), x.alias("x")))
    return t.select("kind", "id", rounded(F.col("x"), 3).alias("dba"))


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of receiver and piece with the exact bound and a cheap ceiling of it, in thousandths of a decibel."""
    h = heard(spark, folder)
    bands = e.spectrum_energy(F.col("power_db"), e.TURBINE_SPECTRUM)
    exact = level(e.bound_energy(bands, F.col("distance_m"), AIR_DB_KM))
    ceiling = F.col("power_db") + e.LARGEST_GAIN_DB - e.divergence_db(F.col("distance_m"))
    return h.withColumn("bound", F.floor(exact * 1000 + 0.5)).withColumn("ceiling", F.floor(ceiling * 1000 + 0.5) + 1)


def D9_bound(spark: SparkSession, folder: str) -> DataFrame:
    """What each receiver hears at most of its loudest piece, and how many pieces may reach 40 dB."""
    b = _bounds(spark, folder).groupBy("record_id").agg(F.max("bound").alias("b"), F.count(F.when(F.col("bound") >= 40_000, 1)).alias("loud"))
    return b.select("record_id", (F.col("b") / 1000).alias("bound_db"), "loud")


def T4_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The three pieces of the largest bound at each receiver by the threshold rule: the bounds of the three best
    ceilings give a threshold, and only pieces whose ceiling reaches it are evaluated."""
    b = _bounds(spark, folder)
    best = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("ceiling"), "point_id"))
    least = F.min(F.when(F.col("place") <= 3, F.col("bound"))).over(Window.partitionBy("record_id"))
    held = b.withColumn("place", best).withColumn("least", least).where(F.col("ceiling") >= F.col("least"))
    top = selection.top_k(held, ["record_id"], [F.desc("bound"), F.col("point_id")], 3)
    return top.select("record_id", "rank", "point_id", "bound")


def _raster(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a raster by key, 128 columns wide."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(F.floor(key / SIDE).cast("int").alias("x"), (key % SIDE).cast("int").alias("y"), F.col("o_totalprice").alias("v"))


def A52_stencil(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over 7 x 7 nodes, the outer ones half weighted, where all are known."""
    cents = _raster(spark, folder).withColumn("v", F.floor(F.col("v") * 100 + 0.5).cast("double"))  # whole, so that sums are exact
    out = grids.stencil(cents, "x", "y", "v", (1, 2, 2, 2, 2, 2, 1))
    return out.where("mean is not null").select("x", "y", (F.floor(F.col("mean") + 0.5) / 100).alias("mean"))


def A53_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Steps to the nearest missing node (a price of 480,000 or more) or out of the raster, up to 7."""
    out = grids.distance_to_missing(_raster(spark, folder), "x", "y", F.col("v") < 480_000, 6)
    return out.select("x", "y", rounded(F.col("distance"), 4).alias("distance"))


def J44_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches on the ground as landings and take-offs with the legs of each: it lands when a moving fix came before,
    takes off when one follows; with both, legs up to the slowest are the landing's; with neither, the fastest leg's
    flag (an id that three divides) says."""
    f = sequences.runs(fixes(spark, folder), ["address"], ["t", "id"], F.col("resting"))
    flag = F.col("id") % 3 == 0
    s = f.groupBy("address", "run").agg(
        F.max("resting").alias("rests"), F.min(F.struct("t", "id")).alias("a"), F.count(F.lit(1)).alias("legs"),
        F.min_by(F.struct("t", "id"), F.struct("speed", "t", "id")).alias("slowest"), F.max_by(flag, F.struct("speed", "t", "id")).alias("flag"),
    )
    w = Window.partitionBy("address").orderBy("a")
    s = s.withColumn("before", F.coalesce(F.max((~F.col("rests")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    s = s.withColumn("after", F.coalesce(F.max((~F.col("rests")).cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) == 1)
    s = s.where("rests")
    early = f.join(s.select("address", "run", "slowest"), ["address", "run"]).groupBy("address", "run").agg(
        F.count(F.when(F.struct("t", "id") <= F.col("slowest"), 1)).alias("early")
    )
    neither = ~F.col("before") & ~F.col("after")
    landing = F.when(F.col("before") & F.col("after"), F.col("early")).when(F.col("before") | (neither & ~F.col("flag")), F.col("legs")).otherwise(F.lit(0))
    out = s.join(early, ["address", "run"]).withColumn("landing", landing)
    return out.select("address", F.col("a.id").alias("first_id"), "before", "after", F.col("landing").cast("long").alias("landing"), (F.col("legs") - F.col("landing")).alias("take_off"))


def W20_low_ends(spark: SparkSession, folder: str) -> DataFrame:
    """The first and the last moving fix of each stretch in the air, where slow (below 150): its low ends."""
    f = sequences.runs(fixes(spark, folder), ["address"], ["t", "id"], F.col("resting"))
    at = F.struct("t", "id", "speed")
    ends = f.where(~F.col("resting")).groupBy("address", "run").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(True).alias("start")), F.struct(F.col("b").alias("at"), F.lit(False).alias("start"))))
    return ends.select("address", sides.alias("s")).where("s.at.speed < 150").select("address", F.col("s.at.id").alias("id"), F.col("s.start").alias("start"))


def J24_low_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Hub heights that are guesses (of ids that three divides) and above three metres are held to three where a unit
    within 100 m has a capacity between 0.4 and 2.5 of the record's power."""
    t = table(spark, folder, "turbines").where(F.col("hub_m") > 3)
    u = table(spark, folder, "register_units").select(F.col("latitude").alias("u_lat"), F.col("longitude").alias("u_lon"), "capacity_mw")
    ratio = F.col("power_kw") / F.nullif(F.col("capacity_mw") * 1000, F.lit(0.0))
    guessed = t.where(F.col("record_id") % 3 == 0)
    low = ranges.distance_join(guessed, u, 100.0, ("lat", "lon"), ("u_lat", "u_lon"), "semi", ratio.between(0.4, 2.5)).select("record_id", F.lit(3.0).alias("low"))
    return t.join(low, "record_id", "left").select("record_id", F.coalesce("low", "hub_m").alias("height_m"))


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    """Points of each runway in order with the next one, the way to it and the way so far (whole centimetres)."""
    p = table(spark, folder, "runway_points").where(F.col("lat").between(-90, 90) & F.col("lon").isNotNull() & F.col("runway").isNotNull())
    w = Window.partitionBy("airport", "runway").orderBy("seq", "point_id")
    nxt = F.lead(F.struct("point_id", "lat", "lon")).over(w)
    p = p.withColumn("next", nxt)
    step = F.floor(distance_m(F.col("lat"), F.col("lon"), F.col("next.lat"), F.col("next.lon")) * 100 + 0.5)
    p = p.withColumn("step", step).withColumn("at", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return p


def J18_junctions(spark: SparkSession, folder: str) -> DataFrame:
    """The way along its runway from the middle of each step to the nearest threshold less than 1 km away."""
    w = Window.partitionBy("airport", "runway").orderBy("seq", "point_id")
    met = F.when(F.col("kind") == "threshold", F.col("at"))
    c = _chain(spark, folder).withColumn("back", F.last(met, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("ahead", F.first(met, True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("next is not null")
    middle = F.col("at") + F.col("step") / 2
    near = F.least(middle - F.col("back"), F.col("ahead") - middle)
    return c.withColumn("near", near).where("near < 100000").select("point_id", F.col("near").cast("double").alias("cm"))


def G1_service_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest ways from each point of the runways to a threshold; what reaches none is rooted at its busiest point."""
    c = _chain(spark, folder).where("next is not null")
    edges = c.select(F.col("point_id").alias("a"), F.col("next.point_id").alias("b"), F.greatest(F.col("step") / 100, F.lit(1.0)).alias("length"))
    drains = table(spark, folder, "runway_points").where("kind = 'threshold'").select(F.col("point_id").alias("node"))
    return graphs.service_tree(edges, drains)


QUERIES = {
    q.__name__: q
    for q in (D1_road, D7_power, D9_bound, T4_threshold, A52_stencil, A53_distance, J44_stretches, W20_low_ends, J24_low_profile, J18_junctions, G1_service_tree)
}


def _values() -> str:
    rows = []
    for c in e.CATEGORIES:
        for i in range(8):
            a, b = (e.ROLLING_A[c][i], e.ROLLING_B[c][i]) if c in e.ROLLING_A else (None, None)
            rows.append(f"('{c}', {i}, {a if a is not None else 'null'}, {b if b is not None else 'null'}, {e.PROPULSION_A[c][i]}, {e.PROPULSION_B[c][i]}, {A_WEIGHT_DB[i]})")
    return f"(values {', '.join(rows)}) as c(cat, band, ar, br, ap, bp, aw)"


def _case(pick) -> str:
    return "case cat " + " ".join(f"when '{c}' then case when circle then {pick(c, 1)} else {pick(c, 0)} end" for c in e.CATEGORIES) + " end"


_P10 = "pow(10.0, ({}) / 10)"
_BANDS = ", ".join(f"({i}, {s}, {w}, {a})" for i, (s, w, a) in enumerate(zip(e.TURBINE_SPECTRUM, A_WEIGHT_DB, AIR_DB_KM, strict=True)))
_BOUND = f"""{_H}, b as (select * from (values {_BANDS}) as b(band, s, w, a)), total as (select 10 * log10(sum({_P10.format('s + w')})) as whole from b),
    x as (select record_id, h.point_id, floor(10 * log10(sum({_P10.format('s - whole + power_db + w - a * d / 1000')})
        * {_P10.format('18.0 - (20 * log10(greatest(d, 1.0)) + 11)')}) * 1000 + 0.5)::bigint as bound from h cross join b cross join total group by record_id, h.point_id, d, power_db)"""
_F = "f as (select user_id as address, epoch_us(ts) // 1000000 as t, value as speed, event_type in ('signup', 'error') as resting, event_id as id from events)"
_RUNS = f"""{_F}, k as (select *, row_number() over (partition by address order by t, id) - row_number() over (partition by address, resting order by t, id) as g from f),
    q as (select *, min(t * 1000000000 + id) over (partition by address, resting, g) as run from k)"""
_RASTER = "r as (select cast(floor(o_orderkey / 128) as int) as x, cast(o_orderkey % 128 as int) as y, o_totalprice as v from orders)"
_CHAIN = f"""p as (select * from runway_points where lat between -90 and 90 and lon is not null and not isnan(lon) and runway is not null),
    n as (select *, lead(lat) over w as b_lat, lead(lon) over w as b_lon, lead(point_id) over w as next from p window w as (partition by airport, runway order by seq, point_id)),
    m as (select *, floor({_gap('lat', 'lon', 'b_lat', 'b_lon')} * 100 + 0.5)::bigint as step from n),
    c as (select *, coalesce(sum(step) over (partition by airport, runway order by seq, point_id rows between unbounded preceding and 1 preceding), 0) as so_far from m)"""

SQL = {
    "D1_road": f"""with c as (select * from {_values()}),
        f as (select piece_id, (coalesce(piece_no, 0) % 9 - 4) * 2.0 as slope, coalesce(piece_no, 0) % 2 = 1 as circle, greatest(1 - (piece_id % 300) / 100.0, 0.0) as fade,
            coalesce(surface_corr_db, 0.0) as surf, unnest(['light', 'medium', 'heavy', 'moto']) as cat,
            unnest([aadt_light / 24, aadt_medium / 24, aadt_heavy / 24, aadt_moto / 24]) as q,
            unnest([coalesce(speed_kmh, 50.0), least(coalesce(speed_kmh, 50.0), 80.0), least(coalesce(speed_kmh, 50.0), 80.0), coalesce(speed_kmh, 50.0)]) as v from display),
        g as (select *, greatest(v, 20.0) as lv, log10(greatest(v, 20.0) / 70) as lr, (greatest(v, 20.0) - 70) / 70 as rel,
            {_case(lambda c, k: e.JUNCTION_DB[c][k][0])} * fade as jr, {_case(lambda c, k: e.JUNCTION_DB[c][k][1])} * fade as jp from f where q > 0 and v > 0),
        k as (select *, case cat when 'light' then case when slope < -6 then least(-slope, 12.0) - 6 when slope > 2 then (least(slope, 12.0) - 2) / 1.5 * lv / 100 else 0 end
            when 'medium' then case when slope < -4 then (least(-slope, 12.0) - 4) / 0.7 * (lv - 20) / 100 when slope > 0 then least(slope, 12.0) * lv / 100 else 0 end
            when 'heavy' then case when slope < -4 then (least(-slope, 12.0) - 4) / 0.5 * (lv - 10) / 100 when slope > 0 then least(slope, 12.0) / 0.8 * lv / 100 else 0 end else 0 end as grad from g),
        s as (select k.piece_id, sum(({_P10.format("l.ap + l.bp * rel + fade * case when circle then 3.1 else 5.5 end")} + {_P10.format("l.ar + l.br * lr + fade * case when circle then -4.4 else -4.5 end")})
            * {_P10.format("l.aw")}) / sum({_P10.format("o.ap + o.bp * rel")} * {_P10.format("o.aw")}) * {_P10.format("3.8 - 0.9 * any_value(fade)")} as scale
            from k join c l on l.cat = 'light' join c o on o.cat = 'moto' and o.band = l.band where k.cat = 'moto' group by k.piece_id),
        b as (select k.piece_id, c.band, q / (1000 * v) * (case k.cat when 'light' then 0.95 when 'moto' then scale else 1 end * {_P10.format("ap + bp * rel + grad + jp")}
            + case when k.cat = 'moto' then 0 else {_P10.format("ar + br * lr + jr + surf + case k.cat when 'light' then 0.8 else 0.4 end")} end) as x
            from k join c on c.cat = k.cat left join s on s.piece_id = k.piece_id)
        select piece_id, band::int as band, {_floor('10 * log10(sum(x))')} as level_db from b group by 1, 2""",
    "D7_power": f"""with w as (select record_id, case when power_kw <= 8000 and not isnan(power_kw) then power_kw end as kw from turbines),
        u as (select unit_id, case when not isnan(capacity_mw) then capacity_mw end as mw from register_units),
        x as (select 'wind' as kind, record_id as id, coalesce(case when kw > 0 then case when floor(kw) >= 5000 then 106.5 when floor(kw) >= 3000 then 106.0
            when floor(kw) >= 2001 then 105.0 when floor(kw) >= 1000 then 104.0 else 98.0 end end, 105.0) - 2.14 as x from w
        union all select 'solar', unit_id, 88.0 + 10 * log10(greatest(coalesce(case when mw > 0 then mw end, 2 * 0.55), 1e-6)) - 5.0 from u
        union all select 'substation', unit_id, case when coalesce(case when mw > 0 then mw end, 2.0) <= 0.2 then 64.0 else 74.0 + 14.0 * log10(coalesce(case when mw > 0 then mw end, 2.0)) end from u
        union all select 'works', unit_id, 60.0 + 10 * log10(greatest(least(coalesce(mw, 0.0) * 50000, 500000.0), 100.0) / 10000) from u)
        select kind, id, {_floor('x')} as dba from x""",
    "D9_bound": f"{_BOUND} select record_id, max(bound) / 1000 as bound_db, count(*) filter (where bound >= 40000) as loud from x group by record_id",
    "T4_threshold": f"""{_BOUND}, t as (select *, row_number() over (partition by record_id order by bound desc, point_id) as rank from x)
        select record_id, rank::int as rank, point_id, bound from t where rank <= 3""",
    "A52_stencil": f"""with {_RASTER}, o as (select i, case when abs(i) = 3 then 1 else 2 end as w from range(-3, 4) as t(i)),
        s as (select r.x + a.i as x, r.y + b.i as y, sum(floor(v * 100 + 0.5) * a.w * b.w) / 144 as m, count(*) as n from r cross join o a cross join o b group by 1, 2)
        select s.x::int as x, s.y::int as y, floor(m + 0.5) / 100 as mean from s join r using (x, y) where n = 49""",
    "A53_distance": f"""with {_RASTER}, o as (select i from range(-6, 7) as t(i)),
        s as (select r.x + a.i as x, r.y + b.i as y, min(greatest(abs(a.i), abs(b.i)) - least(abs(a.i), abs(b.i)) + least(abs(a.i), abs(b.i)) * sqrt(2.0)) as d from r cross join o a cross join o b where not v < 480000 group by 1, 2),
        z as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from r)
        select r.x, r.y, {_floor('least(coalesce(d, 7.0), 7.0, least(r.x - x0, x1 - r.x, r.y - y0, y1 - r.y) + 1.0)', 4)} as distance from r cross join z left join s on s.x = r.x and s.y = r.y""",
    "J44_stretches": f"""with {_RUNS}, s as (select address, run, bool_or(resting) as rests, count(*) as legs, arg_min(t * 1000000000 + id, {{'a': speed, 'b': t, 'c': id}}) as slowest,
            arg_max(id % 3 = 0, {{'a': speed, 'b': t, 'c': id}}) as flag from q group by address, run),
        b as (select *, coalesce(max((not rests)::int) over (partition by address order by run rows between unbounded preceding and 1 preceding), 0) = 1 as before,
            coalesce(max((not rests)::int) over (partition by address order by run rows between 1 following and unbounded following), 0) = 1 as after from s),
        y as (select q.address, q.run, count(*) filter (where q.t * 1000000000 + q.id <= b.slowest) as early, arg_min(q.id, q.t * 1000000000 + q.id) as first_id from q join b using (address, run) group by 1, 2),
        l as (select b.*, first_id, case when before and after then early when before or (not before and not after and not flag) then legs else 0 end as landing from b join y using (address, run) where rests)
        select address, first_id, before, after, landing::bigint as landing, (legs - landing)::bigint as take_off from l""",
    "W20_low_ends": f"""with {_RUNS}, e as (select address, arg_min(id, {{'a': t, 'b': id}}) as a, arg_min(speed, {{'a': t, 'b': id}}) as av, arg_max(id, {{'a': t, 'b': id}}) as b, arg_max(speed, {{'a': t, 'b': id}}) as bv
            from q where not resting group by address, run)
        select address, a as id, true as start from e where av < 150 union all select address, b, false from e where bv < 150""",
    "J24_low_profile": f"""with t as (select * from turbines where hub_m > 3 and not isnan(hub_m) or isnan(hub_m)), r as (select record_id from t join register_units u on abs(t.lat - u.latitude) < 0.002
        where record_id % 3 = 0 and t.lat between -90 and 90 and u.latitude between -90 and 90 and {_gap('t.lat', 't.lon', 'u.latitude', 'u.longitude')} <= 100
        and power_kw / nullif(capacity_mw * 1000, 0) between 0.4 and 2.5)
        select record_id, case when record_id in (select record_id from r) then 3.0 else hub_m end as height_m from t""",
    "J18_junctions": f"""with {_CHAIN}, j as (select airport, runway, so_far from c where kind = 'threshold')
        select point_id, min(abs(c.so_far + c.step / 2.0 - j.so_far))::double as cm from c join j using (airport, runway) where next is not null group by point_id having min(abs(c.so_far + c.step / 2.0 - j.so_far)) < 100000""",
}
