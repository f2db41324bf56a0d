"""Smaller operators: bands, windows, lookups with fallbacks, predicates, unified registers, answer lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.curves import between_settings, log_interpolated, merged_runs, share_with_pass
from sonolith.functions.levels import energy, rounded
from sonolith.functions.text import bare_name
from sonolith.operators import graphs, grouping, ranges, selection, sequences
from sonolith.operators.nearby import pairs_within
from sonolith.plans.noise import SQL as NOISE_SQL
from sonolith.plans.noise import J20_inside, J20_inside_all, lden_top3, pieces, receivers
from sonolith.plans.repair import load_register
from sonolith.plans.tracks import fixes
from sonolith.sources import table


def A1_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Energy by period and band: the first 24 values of each vector read as three periods of eight levels, as its SQL
    has it (see A1_bands_all)."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 24)).alias("i", "x"))
    total = F.sum(energy(F.col("x").cast("double") * 10))
    return e.groupBy("label", F.floor(F.col("i") / 8).alias("period"), (F.col("i") % 8).alias("band")).agg(
        rounded(total, 3).alias("energy")
    )


def A1_bands_all(spark: SparkSession, folder: str) -> DataFrame:
    """Energy by period and band: all values of each vector read as periods of eight levels."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    total = F.sum(energy(F.col("x").cast("double") * 10))
    return e.groupBy("label", F.floor(F.col("i") / 8).alias("period"), (F.col("i") % 8).alias("band")).agg(
        rounded(total, 3).alias("energy")
    )


def A5_box_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums, mean and spread of a box in one pass."""
    price = F.col("l_extendedprice") / 1000
    return table(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), rounded(F.avg(price), 3).alias("mean"),
        rounded(F.stddev_pop(price), 3).alias("spread"), F.max("l_quantity").alias("top"),
    )


def A19_joined_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces as rows of a list: by name, else by reference, else by way; their vehicles and pieces."""
    d = table(spark, folder, "display").withColumn("aadt", F.floor(F.col("aadt_light") * 10 + 0.5).cast("long"))
    key = F.coalesce(bare_name(F.col("road_name")), bare_name(F.col("road_ref")), F.col("osm_id").cast("string"))
    return d.groupBy("country_iso", key.alias("row")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("aadt").alias("tenths"))


def A29_movements(spark: SparkSession, folder: str) -> DataFrame:
    """Mean orders a day by priority and month, over the month's days with orders."""
    o = table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    days = o.groupBy("month").agg(F.countDistinct(F.to_date("o_orderdate")).alias("days"))
    n = o.groupBy("month", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.join(days, "month").select("month", "o_orderpriority", "days", rounded(F.col("n") / F.col("days")).alias("a_day"))


def A38_states(spark: SparkSession, folder: str) -> DataFrame:
    """Discount states in ten bins with their mean and the share up to each, by return flag."""
    l = table(spark, folder, "lineitem").withColumn("bin", F.least(F.floor(F.col("l_discount") * 100 + 0.5).cast("int"), F.lit(9)))
    n = l.groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"))
    w = Window.partitionBy("l_returnflag")
    upto = F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)
    return n.select("l_returnflag", "bin", rounded(F.col("m")).alias("mean"), rounded(upto).alias("up_to"))


def A45_sampled_days(spark: SparkSession, folder: str) -> DataFrame:
    f = fixes(spark, folder).withColumn("month", F.date_format("ts", "yyyy-MM"))
    n = f.groupBy("month", "secondary").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.count(F.lit(1)).alias("n"))
    return n.select("month", "secondary", "days", rounded(F.try_divide("n", "days")).alias("rate"))


def W4_last_slow(spark: SparkSession, folder: str) -> DataFrame:
    """The last slow fix of each resting run, by time."""
    f = sequences.runs(fixes(spark, folder), ["address"], ["t", "id"], F.col("resting")).where("resting")
    slow = F.max(F.when(F.col("speed") <= 30, F.struct("t", "id")))
    return f.groupBy("address", "run").agg(slow.alias("s")).where("s is not null").select("address", F.col("s.id").alias("id"))


def W10_three_in_a_row(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes that begin three falling steps of more than 20 kt."""
    w = Window.partitionBy("address").orderBy("t", "id")
    drops = [F.lead("speed", i).over(w) - F.lead("speed", i + 1).over(w) > 20 for i in (1, 2)]
    f = fixes(spark, folder).withColumn("x", (F.col("speed") - F.lead("speed", 1).over(w) > 20) & drops[0] & drops[1])
    return f.where("x").select("id")


def W15_interleaved(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("address").orderBy("t", "secondary", "id")
    return fixes(spark, folder).select("id", F.row_number().over(w).alias("place"))


def W17_first_sign_all(spark: SparkSession, folder: str, known: str = "true") -> DataFrame:
    """The first sign known on each day."""
    f = fixes(spark, folder).where(known).withColumn("day", F.to_date("ts").cast("string"))
    first = F.min(F.struct("t", "id"))
    return f.groupBy("address", "day").agg(first.alias("f")).select("address", "day", (F.col("f.id") % 7).alias("sign"))


def W17_first_sign(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: a sign is known of every third fix (see W17_first_sign_all)."""
    return W17_first_sign_all(spark, folder, "id % 3 = 0")


def W21_half_way(spark: SparkSession, folder: str) -> DataFrame:
    """The line of each order at which half of its quantity is reached."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    run = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    l = table(spark, folder, "lineitem").withColumn("run", run).withColumn("whole", whole).where("run * 2 >= whole")
    return l.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"))


def W23_slope(spark: SparkSession, folder: str) -> DataFrame:
    """Slope along an order: price by the quantity so far, over one line on either side."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    at = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    l = table(spark, folder, "lineitem").withColumn("at", at)
    dz = F.coalesce(F.lead("l_extendedprice").over(w), F.col("l_extendedprice")) - F.coalesce(F.lag("l_extendedprice").over(w), F.col("l_extendedprice"))
    dx = F.coalesce(F.lead("at").over(w), F.col("at")) - F.coalesce(F.lag("at").over(w), F.col("at"))
    return l.select("l_orderkey", "l_linenumber", rounded(F.try_divide(dz, dx), 3).alias("slope"))


def W24_acceleration(spark: SparkSession, folder: str) -> DataFrame:
    """Change of speed an hour between the neighbours of each fix."""
    w = Window.partitionBy("address").orderBy("t", "id")
    dv, dt = F.lead("speed").over(w) - F.lag("speed").over(w), F.lead("t").over(w) - F.lag("t").over(w)
    return fixes(spark, folder).select("id", rounded(F.try_divide(dv * 3600, dt), 3).alias("rate"))


def W26_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest order of each priority of a customer, of these the newest three."""
    o = grouping.keep_once(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    top = selection.top_k(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return top.select("o_custkey", "rank", "o_orderkey")


def W27_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes along a line at equal angles as seen from one unit beside it: five a part."""
    a, b = F.atan(-F.col("p_size") / 10.0), F.atan(F.col("p_size") / 5.0)
    angles = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: a + (b - a) * (i + 0.5) / 5)
    p = table(spark, folder, "part").select("p_partkey", F.posexplode(angles).alias("node", "angle"))
    return p.select("p_partkey", "node", rounded(F.tan("angle")).alias("at"))


def T5_fastest(spark: SparkSession, folder: str) -> DataFrame:
    f = fixes(spark, folder).groupBy("address").agg(F.max("speed").alias("peak"))
    return f.orderBy(F.desc("peak"), "address").limit(10)


def T11_distinguishable(spark: SparkSession, folder: str) -> DataFrame:
    """The first two of each nation's customers by balance that differ in their segment."""
    c = grouping.keep_once(table(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")])
    return selection.top_k(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 2).select("c_nationkey", "rank", "c_custkey")


def T13_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Median size, lightest and heaviest member of each type."""
    order = F.struct("p_size", "p_partkey")
    return table(spark, folder, "part").groupBy("p_type").agg(
        rounded(F.percentile("p_size", 0.5), 1).alias("middle"), F.min_by("p_partkey", order).alias("least"), F.max_by("p_partkey", order).alias("most")
    )


def U7_merged_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists of names by key: the later one wins, the second list's on a tie."""
    o = table(spark, folder, "orders")
    day = F.datediff("o_orderdate", F.lit("1995-01-01"))
    a = o.where("o_orderkey % 2 = 0").select("o_custkey", day.alias("day"), F.lit(0).alias("account"), "o_orderkey")
    b = o.where("o_orderkey % 2 = 1").select("o_custkey", day.alias("day"), F.lit(1).alias("account"), "o_orderkey")
    out = grouping.keep_once(a.unionByName(b), ["o_custkey"], [F.desc("day"), F.desc("account"), F.desc("o_orderkey")])
    return out.select("o_custkey", "account", "o_orderkey")


def J6_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Speeds less the median of their hour of the day; hours of fewer than ten vehicles have no offset."""
    f = fixes(spark, folder).withColumn("hour", F.hour("ts"))
    m = grouping.median_of_medians(f.select("hour", "address", "speed"), ["hour"], "address", "speed", 10).select("hour", "median")
    j = f.join(F.broadcast(m), "hour", "left")  # 24 rows at most
    return j.select("id", rounded(F.col("speed") - F.coalesce("median", F.lit(0.0)), 3).alias("v"))


def J9_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The highest floor of a band that a value reaches."""
    floors = F.array(*[F.lit(float(x)) for x in (0, 5, 12, 20, 33, 45)])
    reached = F.filter(floors, lambda x: x <= F.col("l_quantity"))
    return table(spark, folder, "lineitem").groupBy(F.element_at(reached, -1).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _near_farm(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "register_units")
    near = pairs_within(units, receivers(spark, folder).where("farm is not null"), 300.0, "unit_id", "record_id", ("latitude", "longitude"))
    near = near.withColumn("mm", F.floor(F.col("distance_m") * 1000 + 0.5))
    best = ranges.nearest_within(near, "left_id", [F.col("mm"), F.col("right_id")], ["right_id"])
    farms = receivers(spark, folder).select(F.col("record_id").alias("right_id"), "farm")
    return best.join(farms, "right_id").select(F.col("left_id").alias("unit_id"), "farm")


def J11_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A unit's farm: its own label, else that of the nearest record within 300 m, else a name of its place."""
    units = table(spark, folder, "register_units").join(_near_farm(spark, folder), "unit_id", "left")
    place = F.concat_ws(" ", F.floor("latitude").cast("string"), F.floor("longitude").cast("string"))
    return units.select("unit_id", F.coalesce("farm_label", "farm", place).alias("farm"))


def J15_same_name(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces with another way of that name and count (a semi join on two keys, counted instead of paired)."""
    d = table(spark, folder, "display").where("road_name is not null").withColumn("n", F.floor(F.col("aadt_light") / 10 + 0.5))
    ways = d.groupBy("road_name", "n").agg(F.countDistinct("osm_id").alias("ways")).where("ways > 1")
    return d.join(ways, ["road_name", "n"], "left_semi").select("piece_id")


def J27_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Records without a dismantled unit within 150 m."""
    gone = table(spark, folder, "register_units").where("lower(unit_status) = 'dismantled'").select("latitude", "longitude")
    return ranges.distance_join(receivers(spark, folder), gone, 150.0, right_at=("latitude", "longitude"), how="anti").select("record_id")


def J36_country(spark: SparkSession, folder: str) -> DataFrame:
    """The country of each unit: that of the nearest runway point within 20 km, else none."""
    units, points = table(spark, folder, "register_units"), table(spark, folder, "runway_points")
    near = pairs_within(units, points, 20_000.0, "unit_id", "point_id", ("latitude", "longitude"))
    near = near.withColumn("mm", F.floor(F.col("distance_m") * 1000 + 0.5))
    best = ranges.nearest_within(near, "left_id", [F.col("mm"), F.col("right_id")], ["right_id"])
    named = best.join(points.select(F.col("point_id").alias("right_id"), "country_iso"), "right_id")
    out = units.select("unit_id").join(named.select(F.col("left_id").alias("unit_id"), "country_iso"), "unit_id", "left")
    return out.select("unit_id", F.coalesce("country_iso", F.lit("none")).alias("country"))


def J41_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Runway points with a mark whether a record stands within 2 km."""
    p = pieces(spark, folder).select("point_id", "p_lat", "p_lon")
    r = receivers(spark, folder).select("lat", "lon")
    near = ranges.distance_join(p, r, 2000.0, ("p_lat", "p_lon"), ("lat", "lon"), "semi").select("point_id", F.lit(True).alias("n"))
    return p.join(near, "point_id", "left").select("point_id", F.coalesce("n", F.lit(False)).alias("near"))


def J43_witnesses(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicle days seen by a primary fix once, others by the first secondary fix."""
    f = fixes(spark, folder).withColumn("day", F.to_date("ts").cast("string"))
    seen = f.where(~F.col("secondary")).groupBy("address", "day").agg(F.min("id").alias("id"))
    other = f.where("secondary").groupBy("address", "day").agg(F.min("id").alias("id")).join(seen, ["address", "day"], "left_anti")
    return seen.withColumn("witness", F.lit("primary")).unionByName(other.withColumn("witness", F.lit("secondary")))


def P13_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose property k is even and above ten, read as tags."""
    tags = F.from_json("props", "map<string,string>")
    e = table(spark, folder, "events").withColumn("tags", tags)
    k = F.element_at("tags", "k").try_cast("int")
    good = F.exists(F.map_keys("tags"), lambda x: x == "k") & (k % 2 == 0) & (k > 10)
    return e.where(good).select("event_id")


def P20_safe_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison that fails on what is no number: heights of at least 100."""
    hub = F.col("hub_m")
    return table(spark, folder, "turbines").where(~F.isnan(hub) & (hub >= 100) & (hub < 1000)).select("record_id")


def S13_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that a table of counts has to keep, with the number of rows against each."""
    t = table(spark, folder, "traffic")
    rules = {
        "aadt is negative": F.col("aadt") < 0, "group is unknown": ~F.col("road_group").isin(0, 1, 2),
        "received before counted": F.to_date("received_at") < F.col("counted_on"), "station lies on no way": F.col("osm_id").isNull(),
    }
    counts = t.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in rules])
    return counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.rows")


def S27_registers(spark: SparkSession, folder: str) -> DataFrame:
    """Three registers in one schema: known height (m) and power (kW) by source."""
    t = table(spark, folder, "turbines").select(F.lit("records").alias("register"), F.col("hub_m").alias("hub"), F.col("power_kw").alias("power"))
    u = table(spark, folder, "register_units").select(
        F.lit("units"), F.col("hub_height_m"), F.when(F.col("capacity_mw") < 20, F.col("capacity_mw") * 1000).otherwise(F.col("capacity_mw"))
    )
    l = load_register(spark, folder).where("reason is null").select(F.lit("lines"), "altura_buje", "potencia_uni")
    all_ = t.union(u).union(l)
    hub, power = [F.when(~F.isnan(c) & F.col(c).between(a, b), F.col(c)) for c, a, b in (("hub", 10, 250), ("power", 1, 20000))]
    return all_.groupBy("register").agg(
        F.count(F.lit(1)).alias("rows"), F.count(hub).alias("hubs"), F.count(power).alias("powers"), rounded(F.avg(hub), 2).alias("mean_hub")
    )


def S29_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of rest in cells of two hours and 50 kt."""
    f = fixes(spark, folder)
    share = F.avg(F.col("resting").cast("double"))
    return f.groupBy(F.floor(F.hour("ts") / 2).alias("x"), F.floor(F.col("speed") / 50).alias("y")).agg(rounded(share).alias("share"))


def K11_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The whole answer of each receiver as one JSON line."""
    top = lden_top3(spark, folder)
    rows = F.array_sort(F.collect_list(F.struct("rank", "airport")))
    return top.groupBy("record_id").agg(F.to_json(F.struct(rows.alias("rows"))).alias("line"))


def A16_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that join end to end into runs where exactly two meet, with the length-weighted median of each run."""
    l = table(spark, folder, "lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 100 + F.col("l_orderkey") % 100 + 10_000_000).alias("b"),
        "l_quantity", "l_extendedprice", F.lit("road").alias("joins"),
    ).dropDuplicates(["row"])
    runs = graphs.joined_rows(l, "row", ["a", "b"], "joins")
    return grouping.weighted_median(l.join(runs, "row"), ["run"], "l_extendedprice", "l_quantity", "row")


def J30_crossings(spark: SparkSession, folder: str) -> DataFrame:
    """Rays (customers to a place of their nation) that meet edges (suppliers' walls), in a square of 600 by 600."""

    def line(key: str, a: int, b: int, length: int, names: str) -> list:
        x, y = (F.col(key) * a % 571).cast("double"), (F.col(key) * b % 577).cast("double")
        n = names.split()
        dx, dy = F.col(key) % length - length / 2 + 0.25, F.col(key) * 3 % length - length / 2 + 0.5
        return [x.alias(n[0]), y.alias(n[1]), (x + dx).alias(n[2]), (y + dy).alias(n[3])]

    rays = table(spark, folder, "customer").select("c_custkey", *line("c_custkey", 7919, 104729, 41, "ax ay bx by"))
    edges = table(spark, folder, "supplier").select("s_suppkey", *line("s_suppkey", 6151, 50021, 31, "cx cy dx dy"))
    out = ranges.crossing_join(rays, edges, "c_custkey", "s_suppkey", 25.0)
    return out.select("c_custkey", "s_suppkey", rounded(F.col("share"), 5).alias("share"))


def J22_hosts_all(spark: SparkSession, folder: str, inside: Callable[[SparkSession, str], DataFrame] = J20_inside_all) -> DataFrame:
    """The aerodrome whose outline holds a record, else that of the nearest point within 12 km, else none; the first by
    name where several hold it."""
    held = inside(spark, folder).groupBy("record_id").agg(F.min("airport").alias("a"))
    p = pieces(spark, folder)
    near = pairs_within(receivers(spark, folder), p, 12_000.0, "record_id", "point_id", right_at=("p_lat", "p_lon"))
    near = near.withColumn("mm", F.floor(F.col("distance_m") * 1000 + 0.5))
    best = ranges.nearest_within(near, "left_id", [F.col("mm"), F.col("right_id")], ["right_id"])
    best = best.join(p.select(F.col("point_id").alias("right_id"), F.col("airport").alias("b")), "right_id")
    r = receivers(spark, folder).select("record_id").join(held, "record_id", "left")
    r = r.join(best.select(F.col("left_id").alias("record_id"), "b"), "record_id", "left")
    return r.select("record_id", F.coalesce("a", "b", F.lit("none")).alias("host"))


def J22_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: no outline across the 180th meridian holds a record (see J22_hosts_all)."""
    return J22_hosts_all(spark, folder, J20_inside)


CURVE_M = (61.0, 122.0, 305.0, 610.0, 1219.0, 3048.0)


def D12_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of parts read as passes: a distance by price, a setting by size, between two curves over log distance."""
    d, setting = F.col("p_retailprice") * 2 - 1500, F.col("p_size") * 100.0
    curves = [log_interpolated(F.greatest(d, F.lit(10.0)), CURVE_M, [top - 8.0 * i for i in range(6)]) for top in (95.0, 101.0, 110.0)]
    level = between_settings(setting, (500.0, 2000.0, 4000.0), curves)
    return table(spark, folder, "part").select("p_partkey", rounded(level, 3).alias("level_db"))


def D17_passes_all(spark: SparkSession, folder: str, pieces: str = "true") -> DataFrame:
    """Share of half minutes with a pass, by piece; null where the traffic is."""
    d = table(spark, folder, "display").where(pieces)
    return d.select("piece_id", rounded(share_with_pass(F.col("aadt_light") / 24, F.lit(30.0)), 5).alias("share"))


def D17_passes(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: pieces of the smallest roads only (see D17_passes_all)."""
    return D17_passes_all(spark, folder, "aadt_light < 2000")


def W25_merged_states(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive values of each vector merged while they differ by at most 0.2: the number of runs."""
    runs = merged_runs(F.col("embedding"), 0.2)
    return table(spark, folder, "embeddings").select("vec_id", F.size(runs).alias("runs"))


def F_class_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of eight sizes merged; energy is conserved."""
    e = F.floor(energy(F.col("p_size").cast("double")) * 1000 + 0.5).cast("long")
    return table(spark, folder, "part").groupBy(F.floor(F.col("p_size") / 8).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e).alias("energy")
    )


def A54_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Two values blended in decibels and in energy."""
    a, b, w = F.col("p_size").cast("double"), F.col("p_retailprice") / 30, (F.col("p_partkey") % 10) / 10.0
    db, lin = a * (1 - w) + b * w, 10 * F.log10(energy(a) * (1 - w) + energy(b) * w)
    return table(spark, folder, "part").select("p_partkey", rounded(db, 3).alias("in_db"), rounded(lin, 3).alias("in_energy"))


QUERIES = {
    q.__name__: q
    for q in (
        A1_bands, A1_bands_all, A5_box_sums, A16_runs, A19_joined_rows, A29_movements, A38_states, A45_sampled_days, W4_last_slow, W10_three_in_a_row,
        W15_interleaved, W17_first_sign, W17_first_sign_all, W21_half_way, W23_slope, W24_acceleration, W26_history, W27_nodes, T5_fastest,
        T11_distinguishable, T13_classes, U7_merged_lists, J6_offsets, J9_bands, J11_fallback, J15_same_name, J27_removed,
        J36_country, J41_flagged, J43_witnesses, P13_tags, P20_safe_numbers, S13_checks, S27_registers, S29_shares, K11_lines,
        J22_hosts, J22_hosts_all, J30_crossings, D12_curves, D17_passes, D17_passes_all, W25_merged_states, F_class_energy, A54_blend,
    )
}


def _r(x: str, places: int = 4) -> str:
    return f"floor(({x}) * {10**places}.0 + 0.5) / {10**places}.0"


def _gap(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({a} - {c}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({b} - {d}) / 2), 2))))"


_F = """with f as (select user_id as address, cast(floor(epoch(ts)) as bigint) as t, value as speed, event_id % 4 = 0 as secondary,
    event_type in ('signup', 'error') as resting, event_id as id, ts, cast(cast(ts as date) as varchar) as day from events)"""
_W = "over (partition by address order by t, id)"
_L = "(partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_R = "with r as (select * from turbines where abs(lat) <= 90 and not isnan(lat) and lon is not null and not isnan(lon))"
_M = (61.0, 122.0, 305.0, 610.0, 1219.0, 3048.0)


def _curve(top: float) -> str:
    parts = [f"({top - 8.0 * i}::double - 8 * (log10(d) - log10({_M[i]}::double)) / (log10({_M[i + 1]}::double) - log10({_M[i]}::double)))" for i in range(5)]
    return "case " + " ".join(f"when d < {_M[i + 1]} then {parts[i]}" for i in range(4)) + f" else {parts[4]} end"


def _line(key: str, a: int, b: int, n: int, names: str) -> str:
    x, y, p, q = names.split()
    u, v = f"({key} * {a} % 571)::double", f"({key} * {b} % 577)::double"
    return f"{u} as {x}, {v} as {y}, {u} + {key} % {n} - {n / 2}::double + 0.25::double as {p}, {v} + {key} * 3 % {n} - {n / 2}::double + 0.5::double as {q}"


SQL = {
    "J30_crossings": f"""with r as (select c_custkey, {_line("c_custkey", 7919, 104729, 41, "ax ay bx b_y")} from customer), e as (select s_suppkey, {_line("s_suppkey", 6151, 50021, 31, "cx cy dx dy")} from supplier),
        k as (select c_custkey, s_suppkey, nullif((bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx), 0) as det, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) as t, ((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) as u from r, e)
        select c_custkey, s_suppkey, {_r('t / det', 5)} as share from k where t / det between 0 and 1 and u / det between 0 and 1""",
    "J22_hosts": f"""with held as (select record_id, min(airport) as a from ({NOISE_SQL["J20_inside"]}) group by 1), n as (select record_id, point_id, airport, {_gap('t.lat', 't.lon', 'p.lat', 'p.lon')} as d
        from turbines t, runway_points p where abs(t.lat - p.lat) < 0.11 and abs(t.lat) <= 90 and abs(p.lat) <= 90 and t.lon is not null and p.lon is not null),
        b as (select record_id, arg_min(airport, {{'a': floor(d * 1000 + 0.5), 'b': point_id}}) as b from n where d <= 12000 group by 1)
        select record_id, coalesce(a, b, 'none') as host from (select record_id from turbines where abs(lat) <= 90 and lon is not null) left join held using (record_id) left join b using (record_id)""",
    "D12_curves": f"""with p as (select p_partkey, greatest(p_retailprice * 2 - 1500, 10.0) as d, p_size * 100.0::double as s from part), c as (select p_partkey, s, {_curve(95.0)} as a, {_curve(101.0)} as b, {_curve(110.0)} as c from p)
        select p_partkey, {_r('case when s < 2000 then a + (b - a) * (s - 500) / 1500 else b + (c - b) * (s - 2000) / 2000 end', 3)} as level_db from c""",
    "D17_passes": f"select piece_id, {_r('1 - exp(-(aadt_light / 24) * 30.0::double / 3600)', 5)} as share from display where aadt_light < 2000",
    "F_class_energy": "select cast(floor(p_size / 8) as bigint) as class, count(*) as n, sum(cast(floor(exp(p_size::double * (ln(10) / 10)) * 1000 + 0.5) as bigint))::bigint as energy from part group by 1",
    "A54_blend": f"""with p as (select p_partkey, p_size::double as a, p_retailprice / 30 as b, (p_partkey % 10) / 10.0::double as w from part) select p_partkey, {_r('a * (1 - w) + b * w', 3)} as in_db,
        {_r('10 * log10(exp(a * (ln(10) / 10)) * (1 - w) + exp(b * (ln(10) / 10)) * w)', 3)} as in_energy from p""",
    "A1_bands": f"""with e as (select label, unnest(embedding[1:24])::double as x, generate_subscripts(embedding[1:24], 1) - 1 as i from embeddings)
        select label, cast(floor(i / 8) as bigint) as period, cast(i % 8 as int) as band, {_r('sum(exp(x * 10 * (ln(10) / 10)))', 3)} as energy from e group by 1, 2, 3""",
    "A5_box_sums": f"""select l_suppkey, l_returnflag, count(*) as n, sum(l_quantity) as quantity, {_r('avg(l_extendedprice / 1000)', 3)} as mean,
        {_r('stddev_pop(l_extendedprice / 1000)', 3)} as spread, max(l_quantity) as top from lineitem group by 1, 2""",
    "A19_joined_rows": """select country_iso, coalesce(nullif(lower(trim(road_name)), ''), nullif(lower(trim(road_ref)), ''), osm_id::varchar) as row, count(*) as pieces,
        sum(cast(floor(aadt_light * 10 + 0.5) as bigint))::bigint as tenths from display group by 1, 2""",
    "A29_movements": f"""with o as (select *, strftime(o_orderdate, '%Y-%m') as month from orders), d as (select month, count(distinct cast(o_orderdate as date)) as days from o group by 1)
        select month, o_orderpriority, any_value(days) as days, {_r('count(*) / any_value(days)')} as a_day from o join d using (month) group by 1, 2""",
    "A38_states": f"""with n as (select l_returnflag, least(cast(floor(l_discount * 100 + 0.5) as int), 9) as bin, count(*) as n, avg(l_quantity) as m from lineitem group by 1, 2)
        select l_returnflag, bin, {_r('m')} as mean, {_r('sum(n) over (partition by l_returnflag order by bin) / sum(n) over (partition by l_returnflag)')} as up_to from n""",
    "A45_sampled_days": f"{_F} select strftime(ts, '%Y-%m') as month, secondary, count(distinct day) as days, {_r('count(*) / count(distinct day)')} as rate from f group by 1, 2",
    "W4_last_slow": f"""{_F}, r as (select *, row_number() {_W} - row_number() over (partition by address, resting order by t, id) as g from f)
        select address, arg_max(id, {{'a': t, 'b': id}}) as id from r where resting and speed <= 30 group by address, g""",
    "W10_three_in_a_row": f"""{_F}, n as (select id, speed, lead(speed, 1) {_W} as a, lead(speed, 2) {_W} as b, lead(speed, 3) {_W} as c from f)
        select id from n where speed - a > 20 and a - b > 20 and b - c > 20""",
    "W15_interleaved": f"{_F} select id, row_number() over (partition by address order by t, secondary, id) as place from f",
    "W17_first_sign": f"{_F} select address, day, arg_min(id, {{'a': t, 'b': id}}) % 7 as sign from f where id % 3 = 0 group by 1, 2",
    "W21_half_way": """with c as (select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and current row) as r,
        sum(l_quantity) over (partition by l_orderkey) as w from lineitem) select l_orderkey, min(l_linenumber) as line from c where r * 2 >= w group by 1""",
    "W23_slope": f"""with a as (select *, sum(l_quantity) over {_L[:-1]} rows between unbounded preceding and current row) as pos from lineitem)
        select l_orderkey, l_linenumber, {_r(f'(coalesce(lead(l_extendedprice) over {_L}, l_extendedprice) - coalesce(lag(l_extendedprice) over {_L}, l_extendedprice)) / nullif(coalesce(lead(pos) over {_L}, pos) - coalesce(lag(pos) over {_L}, pos), 0)', 3)} as slope from a""",
    "W24_acceleration": f"{_F} select id, {_r(f'(lead(speed) {_W} - lag(speed) {_W}) * 3600 / nullif(lead(t) {_W} - lag(t) {_W}, 0)', 3)} as rate from f",
    "W26_history": """with o as (select * from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1),
        k as (select o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank, o_orderkey from o) select * from k where rank <= 3""",
    "W27_nodes": f"""select p_partkey, i::int as node, {_r('tan(atan(-p_size / 10.0::double) + (atan(p_size / 5.0::double) - atan(-p_size / 10.0::double)) * (i + 0.5::double) / 5)')} as at from part, range(5) t(i)""",
    "T5_fastest": f"{_F} select address, max(speed) as peak from f group by 1 order by peak desc, address limit 10",
    "T11_distinguishable": """with c as (select * from customer qualify row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) = 1),
        k as (select c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank, c_custkey from c) select * from k where rank <= 2""",
    "T13_classes": f"""select p_type, {_r('quantile_cont(p_size, 0.5)', 1)} as middle, arg_min(p_partkey, {{'a': p_size, 'b': p_partkey}}) as least, arg_max(p_partkey, {{'a': p_size, 'b': p_partkey}}) as most from part group by 1""",
    "U7_merged_lists": """select o_custkey, (o_orderkey % 2)::int as account, o_orderkey from orders
        qualify row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc, o_orderkey % 2 desc, o_orderkey desc) = 1""",
    "J6_offsets": f"""{_F}, m as (select hour(ts) as hour, address, list_sort(list(speed)) as s from f group by 1, 2), n as (select hour, list_sort(list(s[len(s) // 2 + 1])) as s from m group by 1 having count(*) >= 10)
        select id, {_r('speed - coalesce(s[len(s) // 2 + 1], 0)', 3)} as v from f left join n on n.hour = hour(f.ts)""",
    "J9_bands": "select list_last(list_filter([0, 5, 12, 20, 33, 45]::double[], lambda x: x <= l_quantity)) as band, count(*) as n from lineitem group by 1",
    "J11_fallback": f"""{_R}, n as (select unit_id, record_id, farm, {_gap('lat', 'lon', 'latitude', 'longitude')} as d from register_units, r where abs(lat - latitude) < 0.004 and farm is not null),
        b as (select unit_id, arg_min(farm, {{'a': floor(d * 1000 + 0.5), 'b': record_id}}) as farm from n where d <= 300 group by 1)
        select unit_id, coalesce(farm_label, farm, floor(latitude)::bigint || ' ' || floor(longitude)::bigint) as farm from register_units left join b using (unit_id)""",
    "J15_same_name": """with d as (select *, floor(aadt_light / 10 + 0.5) as n from display where road_name is not null) select piece_id from d a
        where exists (select 1 from d b where b.road_name = a.road_name and b.n = a.n and b.osm_id <> a.osm_id)""",
    "J27_removed": f"""{_R} select record_id from r where not exists (select 1 from register_units u where lower(unit_status) = 'dismantled' and {_gap('lat', 'lon', 'latitude', 'longitude')} <= 150)""",
    "J36_country": f"""with n as (select unit_id, point_id, country_iso, {_gap('latitude', 'longitude', 'lat', 'lon')} as d from register_units, runway_points where abs(lat - latitude) < 0.2 and abs(lat) <= 90 and lon is not null),
        b as (select unit_id, arg_min(country_iso, {{'a': floor(d * 1000 + 0.5), 'b': point_id}}) as c from n where d <= 20000 group by 1) select unit_id, coalesce(c, 'none') as country from register_units left join b using (unit_id)""",
    "J41_flagged": f"""{_R}, p as (select point_id, lat as p_lat, lon as p_lon from runway_points where abs(lat) <= 90 and lon is not null)
        select point_id, exists (select 1 from r where {_gap('lat', 'lon', 'p_lat', 'p_lon')} <= 2000) as near from p""",
    "J43_witnesses": f"""{_F} select address, day, case when bool_or(not secondary) then min(id) filter (where not secondary) else min(id) end as id,
        case when bool_or(not secondary) then 'primary' else 'secondary' end as witness from f group by 1, 2""",
    "P13_tags": "select event_id from events where try_cast(props ->> 'k' as int) % 2 = 0 and try_cast(props ->> 'k' as int) > 10",
    "P20_safe_numbers": "select record_id from turbines where not isnan(hub_m) and hub_m >= 100 and hub_m < 1000",
    "S13_checks": """select 'aadt is negative' as rule, count(*) filter (where aadt < 0) as rows from traffic union all select 'group is unknown', count(*) filter (where road_group not in (0, 1, 2)) from traffic
        union all select 'received before counted', count(*) filter (where cast(received_at as date) < counted_on) from traffic union all select 'station lies on no way', count(*) filter (where osm_id is null) from traffic""",
    "S29_shares": f"{_F} select cast(floor(hour(ts) / 2) as bigint) as x, cast(floor(speed / 50) as bigint) as y, {_r('avg(resting::int::double)')} as share from f group by 1, 2",
}
