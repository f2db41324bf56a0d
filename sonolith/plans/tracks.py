"""Trajectory queries over the events table: a user is a vehicle, a value its speed (kt), signup and error rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.levels import period_of_hour, rounded, seconds_in
from sonolith.operators import grouping, kept, ranges, sequences
from sonolith.sources import table

RESTING = ("signup", "error")


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    """address, t (seconds), speed, secondary, resting, id. Equal times of an address are told apart by id."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("address"),
        F.unix_seconds("ts").alias("t"),
        F.col("value").alias("speed"),
        (F.col("event_id") % 4 == 0).alias("secondary"),
        F.col("event_type").isin(*RESTING).alias("resting"),
        F.col("event_id").alias("id"),
        "ts",
    )


def J2_merge_providers(spark: SparkSession, folder: str) -> DataFrame:
    """The secondary provider adds only what lies more than an hour from every sane primary fix."""
    sane = F.col("speed").between(5, 450)
    out = sequences.secondary_only(fixes(spark, folder), ["address"], "t", "secondary", sane, 3600)
    return out.select("address", "t", "id", "secondary")


def J1_provider_union(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of either provider with the number of fixes of each."""
    f = fixes(spark, folder)
    a = f.where(~F.col("secondary")).groupBy("address").agg(F.count(F.lit(1)).alias("p"))
    b = f.where("secondary").groupBy("address").agg(F.count(F.lit(1)).alias("s"))
    zero = F.lit(0).cast("long")
    return a.join(b, "address", "full").select(
        "address", F.coalesce("p", zero).alias("primary_fixes"), F.coalesce("s", zero).alias("secondary_fixes")
    )


def W1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbours within the gap budget of the busier state (moving 12 h, resting 2 h), dt above 0."""
    w = Window.partitionBy("address").orderBy("t", "id")
    f = fixes(spark, folder).withColumn("t0", F.lag("t").over(w)).withColumn("r0", F.lag("resting").over(w))
    budget = F.when(F.col("resting") & F.col("r0"), 7200).otherwise(43200)
    dt = F.col("t") - F.col("t0")
    return f.where((dt > 0) & (dt <= budget)).select("address", "id", "t0", "t", dt.alias("dt"))


def W3_rotations(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions closed by a rest of six hours; a session begins at the last slow fix of the rest."""
    out = sequences.rotations(_unique(spark, folder), ["address"], "t", "resting", F.col("speed") <= 30, 21600)
    return out.groupBy("address", "rotation").agg(
        F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("fixes")
    )


def _unique(spark: SparkSession, folder: str) -> DataFrame:
    return grouping.keep_once(fixes(spark, folder), ["address", "t"], [F.col("id")])


def W5_resting_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least three resting fixes."""
    f = sequences.sustained(fixes(spark, folder), ["address"], ["t", "id"], F.col("resting"), 3, "parked")
    return f.where("parked").select("address", "id")


def W6_hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    """Cruise from 300 kt on, until below 200 kt; resting fixes don't reset it."""
    moving = ~F.col("resting")
    out = sequences.hysteresis(
        fixes(spark, folder), ["address"], ["t", "id"], moving & (F.col("speed") >= 300), moving & (F.col("speed") < 200)
    )
    return out.select("address", "id", "high")


def W7_moving_median(spark: SparkSession, folder: str) -> DataFrame:
    out = sequences.moving_upper_median(fixes(spark, folder), ["address"], ["t", "id"], "speed", 5, "median")
    return out.select("id", "median")


def W8_secant(spark: SparkSession, folder: str) -> DataFrame:
    """Change of speed an hour over +-12 h, where known fixes span at least an hour."""
    out = sequences.secant_rate(_unique(spark, folder), ["address"], "t", "speed", 43200, 3600, "rate")
    return out.select("id", rounded(F.col("rate") * 3600).alias("rate"))


def W9_cut_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes before the first one above 480 kt."""
    out = sequences.cut_tail(fixes(spark, folder), ["address"], ["t", "id"], F.col("speed") > 480)
    return out.select("address", "id")


def W11_short_lows(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of resting fixes between two moving ones that are less than a day apart are dropped."""
    keys, order = ["address"], ["t", "id"]
    f = sequences.runs(fixes(spark, folder), keys, order, F.col("resting"))
    ends = f.groupBy("address", "run").agg(F.max("resting").alias("low"), F.min("t").alias("a"), F.max("t").alias("b"))
    w = Window.partitionBy("address").orderBy("run")
    ends = ends.withColumn("before", F.lag("b").over(w)).withColumn("after", F.lead("a").over(w))
    drop = ends.where(F.col("low") & (F.col("after") - F.col("before") < 86400)).select("address", "run")
    return f.join(drop, ["address", "run"], "left_anti").select("address", "id")


def W12_drop_jumps(spark: SparkSession, folder: str) -> DataFrame:
    """A fix more than 400 kt from the last kept one within a day is dropped; what is kept decides on the next."""
    f = _unique(spark, folder).select("address", "t", "speed", "id")
    return kept.drop_jumps(f, ["address"], "t", "speed", 400.0, 86400.0).select("address", "id")


def W13_mend(spark: SparkSession, folder: str) -> DataFrame:
    f = fixes(spark, folder).withColumn("known", F.when(F.col("speed") < 400, F.col("speed")))
    out = sequences.fill_between(f, ["address"], ["t", "id"], "known", "mended")
    return out.select("id", rounded(F.col("mended")).alias("mended"))


def W14_merge_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Times covered by primary fixes, each +-3 h, as merged intervals."""
    f = fixes(spark, folder).where(~F.col("secondary"))
    spans = f.select("address", (F.col("t") - 10800).alias("a"), (F.col("t") + 10800).alias("b"))
    return ranges.merge_intervals(spans, ["address"], "a", "b")


def W16_carry_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A vehicle's sign (known on one fix in three) carried on, only where it changes."""
    sign = F.when(F.col("id") % 3 == 0, F.concat(F.lit("S"), (F.col("id") % 7).cast("string")))
    out = sequences.carry_changes(fixes(spark, folder).withColumn("sign", sign), ["address"], ["t", "id"], "sign")
    return out.select("address", "id", "sign")


def W18_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of fixes, broken at gaps of more than a day."""
    w = Window.partitionBy("address").orderBy("t", "id")
    out = sequences.break_chains(
        fixes(spark, folder), ["address"], ["t", "id"], F.col("t") - F.lag("t").over(w) > 86400
    )
    return out.groupBy("address", "chain").agg(F.count(F.lit(1)).alias("fixes"), F.max("t").alias("last"))


def W19_simplify(spark: SparkSession, folder: str) -> DataFrame:
    f = _unique(spark, folder).select("address", "t", (F.col("t") / 3600.0).alias("x"), F.col("speed").alias("y"), "id")
    return kept.simplify(f, ["address"], "t", "x", "y", 60.0).select("address", "id")


def J5_interpolate(spark: SparkSession, folder: str) -> DataFrame:
    """Speed of secondary fixes as the primary ones around them have it."""
    f = _unique(spark, folder)
    probes = f.where("secondary").select("address", "t", "id")
    known = f.where(~F.col("secondary")).select("address", "t", "speed")
    out = ranges.interpolate(probes, known, ["address"], "t", "speed", "offset")
    return out.select("id", rounded(F.col("offset"), 3).alias("offset"))


def J4_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Secondary fixes outside every joined pair of primary fixes (at most six hours apart)."""
    f = fixes(spark, folder)
    w = Window.partitionBy("address").orderBy("t", "id")
    pairs = f.where(~F.col("secondary")).withColumn("a", F.lag("t").over(w)).where(F.col("t") - F.col("a") <= 21600)
    spans = pairs.select("address", "a", F.col("t").alias("b"))
    probes = f.where("secondary").select("address", "t", "id")
    return ranges.interval_join(
        probes, spans, ["address"], F.col("t"), F.col("a"), F.col("b"), 86400, "anti"
    ).select("address", "id")


def A13_regional(spark: SparkSession, folder: str) -> DataFrame:
    """Offset by hour of day: median of each vehicle's median, from two vehicles on."""
    f = fixes(spark, folder).withColumn("hour", F.hour("ts")).select("hour", "address", "speed")
    return grouping.median_of_medians(f, ["hour"], "address", "speed")


def A14_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Upper and averaged median side by side."""
    return fixes(spark, folder).groupBy("address").agg(
        grouping.upper_median("speed").alias("upper"), rounded(F.percentile("speed", 0.5)).alias("middle")
    )


def A26_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Days with fewer vehicles in an hour than half of the hour's median over the days."""
    f = fixes(spark, folder)
    per = f.groupBy(F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour")).agg(F.countDistinct("address").alias("n"))
    usual = per.groupBy("hour").agg(F.percentile("n", 0.5).alias("m"))
    hours = per.select("day").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    grid = hours.join(F.broadcast(usual), "hour").join(per, ["day", "hour"], "left")  # 24 rows at most
    low = F.coalesce("n", F.lit(0)) < F.col("m") * 0.5
    return grid.groupBy("day").agg(F.bool_or(low).alias("partial"), F.sum(F.when(low, 1).otherwise(0)).alias("hours"))


def A46_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return fixes(spark, folder).groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour")).agg(
        F.countDistinct("address").alias("vehicles"), F.count(F.lit(1)).alias("fixes")
    )


def A7_count_once(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicles by day and speed box: once each, at 1/30 with a primary fix there, else at 1/20."""
    f = fixes(spark, folder).withColumn("day", F.to_date("ts").cast("string")).withColumn("box", F.floor(F.col("speed") / 100))
    out = grouping.count_once(f, ["day", "box"], "address", F.col("secondary"), F.lit(1 / 30), F.lit(1 / 20))
    return out.select("day", "box", rounded(F.col("weighted")).alias("weighted"), "things")


def A8_loudest_moment(spark: SparkSession, folder: str) -> DataFrame:
    """Each vehicle of a day counts at its peak, in nested thresholds."""
    peak = fixes(spark, folder).groupBy(F.to_date("ts").cast("string").alias("day"), "address").agg(F.max("speed").alias("p"))
    return peak.groupBy("day").agg(
        *[F.sum(F.when(F.col("p") >= x, 1).otherwise(0)).alias(f"over_{x}") for x in (100, 200, 300)]
    )


def A25_frequented(spark: SparkSession, folder: str) -> DataFrame:
    """Speed cells seen by at least ten vehicles on at least three days."""
    f = fixes(spark, folder).withColumn("cell", F.floor(F.col("speed") / 10)).withColumn("day", F.to_date("ts").cast("string"))
    out = f.groupBy("cell").agg(F.countDistinct("address").alias("vehicles"), F.countDistinct("day").alias("days"))
    return out.where("vehicles >= 10 and days >= 3")


def F_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes by period of the day, and the seconds of the three hours after each that fall into the evening."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    evening = seconds_in(second, second + 10800, 19, 23)
    return fixes(spark, folder).groupBy(period_of_hour(F.hour("ts")).alias("period")).agg(
        F.count(F.lit(1)).alias("fixes"), F.sum(evening).alias("evening_s")
    )


def X4_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes of an address within the last day before each, and whether a budget of five holds."""
    w = Window.partitionBy("address").orderBy("t").rangeBetween(-86400, 0)
    f = fixes(spark, folder).withColumn("recent", F.count(F.lit(1)).over(w))
    return f.select("id", "recent", (F.col("recent") <= 5).alias("allowed"))


def X7_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


QUERIES = {
    q.__name__: q
    for q in (
        J1_provider_union, J2_merge_providers, J4_covered, J5_interpolate, W1_segments, W3_rotations, W5_resting_runs,
        W6_hysteresis, W7_moving_median, W8_secant, W9_cut_tail, W11_short_lows, W12_drop_jumps, W13_mend,
        W14_merge_intervals, W16_carry_changes, W18_chains, W19_simplify, A7_count_once, A8_loudest_moment, A13_regional,
        A14_medians, A25_frequented, A26_coverage, A46_hourly, F_periods, X4_budget, X7_tumbling,
    )
}

_F = """with f as (select user_id as address, cast(floor(epoch(ts)) as bigint) as t, value as speed, event_id % 4 = 0 as secondary,
    event_type in ('signup', 'error') as resting, event_id as id, ts from events),
    u as (select * from f qualify row_number() over (partition by address, t order by id) = 1)"""
_W = "over (partition by address order by t, id)"
_R4 = "floor(({}) * 10000 + 0.5) / 10000"

SQL = {
    "J1_provider_union": f"""{_F} select address, count(*) filter (where not secondary) as primary_fixes,
        count(*) filter (where secondary) as secondary_fixes from f group by address""",
    "J2_merge_providers": f"""{_F} select address, t, id, secondary from f where not secondary or (speed between 5 and 450
        and not exists (select 1 from f p where p.address = f.address and not p.secondary and p.speed between 5 and 450 and abs(p.t - f.t) <= 3600))""",
    "J4_covered": f"""{_F}, p as (select address, lag(t) {_W} as a, t as b from f where not secondary)
        select address, id from f where secondary and not exists (select 1 from p where p.address = f.address and p.b - p.a <= 21600 and f.t between p.a and p.b)""",
    "J5_interpolate": f"""{_F}, k as (select * from u where not secondary),
        n as (select s.id, s.t, (select {{'t': k.t, 'v': k.speed}} from k where k.address = s.address and k.t <= s.t order by k.t desc limit 1) as a,
        (select {{'t': k.t, 'v': k.speed}} from k where k.address = s.address and k.t >= s.t order by k.t limit 1) as b from u s where s.secondary)
        select id, floor(coalesce(a.v + (b.v - a.v) * coalesce((t - a.t) / nullif(b.t - a.t, 0.0), 0.0), a.v, b.v) * 1000 + 0.5) / 1000 as "offset" from n""",
    "W1_segments": f"""{_F}, p as (select *, lag(t) {_W} as t0, lag(resting) {_W} as r0 from f)
        select address, id, t0, t, t - t0 as dt from p where t > t0 and t - t0 <= case when resting and r0 then 7200 else 43200 end""",
    "W3_rotations": f"""{_F}, o as (select *, row_number() over (partition by address order by t) as i,
        row_number() over (partition by address order by t) - row_number() over (partition by address, resting order by t) as g from u),
        r as (select address, resting, g, min(i) as a, max(i) as b, max(t) - min(t) as d, max(case when speed <= 30 then i end) as s from o group by all),
        c as (select r.address, r.a, r.b, coalesce(r.s, r.a) as begin, row_number() over (partition by r.address order by r.a) as k from r where resting and d >= 21600
        and exists (select 1 from o where o.address = r.address and not o.resting and o.i < r.a) and exists (select 1 from o where o.address = r.address and o.i > r.b)),
        n as (select o.address, o.t, coalesce((select max(k) from c where c.address = o.address and c.b < o.i), 0) + 1 as rotation from o
        union all select o.address, o.t, c.k + 1 from o join c on c.address = o.address and o.i between c.begin and c.b)
        select address, rotation, min(t) as start, max(t) as stop, count(*) as fixes from n group by address, rotation having count(*) >= 2""",
    "W5_resting_runs": f"""{_F}, r as (select *, row_number() {_W} - row_number() over (partition by address, resting order by t, id) as g from f)
        select address, id from r qualify resting and count(*) over (partition by address, resting, g) >= 3""",
    "W6_hysteresis": f"""{_F} select address, id, coalesce(last_value(case when not resting and speed >= 300 then true when not resting and speed < 200 then false end ignore nulls)
        over (partition by address order by t, id rows between unbounded preceding and current row), false) as high from f""",
    "W7_moving_median": f"""{_F}, l as (select id, list_sort(list(speed) over (partition by address order by t, id rows between 5 preceding and 5 following)) as s from f)
        select id, s[len(s) // 2 + 1] as median from l""",
    "W8_secant": f"""{_F}, w as (select id, first_value(t) over k as a, last_value(t) over k as b, first_value(speed) over k as x, last_value(speed) over k as y from u
        window k as (partition by address order by t range between 43200 preceding and 43200 following))
        select id, case when b - a >= 3600 then {_R4.format("(y - x) / (b - a) * 3600")} end as rate from w""",
    "W9_cut_tail": f"{_F} select address, id from f qualify max(case when speed > 480 then 1 else 0 end) over (partition by address order by t, id rows between unbounded preceding and current row) = 0",
    "W11_short_lows": f"""{_F}, r as (select *, row_number() {_W} - row_number() over (partition by address, resting order by t, id) as g from f),
        e as (select address, resting, g, min(t) as a, max(t) as b, min((t, id)) as o from r group by all),
        n as (select *, lag(b) over (partition by address order by o) as pb, lead(a) over (partition by address order by o) as na from e)
        select r.address, r.id from r join n using (address, resting, g) where not (resting and coalesce(na - pb < 86400, false))""",
    "W13_mend": f"""{_F}, k as (select *, case when speed < 400 then speed end as v from f), n as (select id, v, lag(v) {_W} as a, lead(v) {_W} as b from k)
        select id, {_R4.format("coalesce(v, (a + b) / 2, a, b)")} as mended from n""",
    "W14_merge_intervals": f"""{_F}, s as (select address, t - 10800 as a, t + 10800 as b from f where not secondary),
        m as (select *, case when a <= max(b) over (partition by address order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from s),
        i as (select *, sum(n) over (partition by address order by a, b rows between unbounded preceding and current row) as g from m)
        select address, min(a) as a, max(b) as b from i group by address, g""",
    "W16_carry_changes": f"""{_F}, s as (select *, last_value(case when id % 3 = 0 then 'S' || (id % 7) end ignore nulls)
        over (partition by address order by t, id rows between unbounded preceding and current row) as sign from f)
        select address, id, sign from s qualify sign is not null and sign is distinct from lag(sign) {_W}""",
    "W18_chains": f"""{_F}, b as (select *, case when t - lag(t) {_W} <= 86400 then 0 else 1 end as n from f),
        c as (select *, sum(n) over (partition by address order by t, id rows between unbounded preceding and current row) as chain from b)
        select address, chain::bigint as chain, count(*) as fixes, max(t) as last from c group by address, chain""",
    "A7_count_once": f"""{_F}, p as (select cast(cast(ts as date) as varchar) as day, cast(floor(speed / 100) as bigint) as box, address,
        case when bool_or(not secondary) then 1 / 30.0 else 1 / 20.0 end as w from f group by 1, 2, 3)
        select day, box, {_R4.format("sum(w::double)")} as weighted, count(*) as things from p group by day, box""",
    "A8_loudest_moment": f"""{_F}, p as (select cast(cast(ts as date) as varchar) as day, address, max(speed) as p from f group by 1, 2)
        select day, {", ".join(f"count(*) filter (where p >= {x}) as over_{x}" for x in (100, 200, 300))} from p group by day""",
    "A13_regional": f"""{_F}, m as (select hour(ts) as hour, address, list_sort(list(speed)) as s from f group by 1, 2),
        n as (select hour, list_sort(list(s[len(s) // 2 + 1])) as s, count(*) as members from m group by hour)
        select hour, s[len(s) // 2 + 1] as median, members from n where members >= 2""",
    "A14_medians": f"""{_F}, m as (select address, list_sort(list(speed)) as s, quantile_cont(speed, 0.5) as q from f group by address)
        select address, s[len(s) // 2 + 1] as upper, {_R4.format("q")} as middle from m""",
    "A25_frequented": f"""{_F} select cast(floor(speed / 10) as bigint) as cell, count(distinct address) as vehicles, count(distinct cast(cast(ts as date) as varchar)) as days
        from f group by 1 having count(distinct address) >= 10 and count(distinct cast(cast(ts as date) as varchar)) >= 3""",
    "A26_coverage": f"""{_F}, p as (select cast(cast(ts as date) as varchar) as day, hour(ts) as hour, count(distinct address) as n from f group by 1, 2),
        m as (select hour, quantile_cont(n, 0.5) as m from p group by hour),
        g as (select d.day, coalesce(p.n, 0) < m.m * 0.5 as low from (select distinct day from p) d cross join m left join p on p.day = d.day and p.hour = m.hour)
        select day, bool_or(low) as partial, count(*) filter (where low) as hours from g group by day""",
    "A46_hourly": f"{_F} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(distinct address) as vehicles, count(*) as fixes from f group by 1",
    "F_periods": f"""{_F}, s as (select case when hour(ts) between 7 and 18 then 0 when hour(ts) between 19 and 22 then 1 else 2 end as period,
        hour(ts) * 3600 + minute(ts) * 60 + second(ts) as s from f)
        select period, count(*) as fixes, sum(greatest(least(s + 10800, 23 * 3600) - greatest(s, 19 * 3600), 0))::bigint as evening_s from s group by period""",
    "X4_budget": f"""{_F}, c as (select id, count(*) over (partition by address order by t range between 86400 preceding and current row) as recent from f)
        select id, recent, recent <= 5 as allowed from c""",
    "X7_tumbling": "select cast(floor(epoch(ts) / 21600) * 21600 as bigint) as start_s, event_type, count(*) as n from events group by 1, 2",
}
