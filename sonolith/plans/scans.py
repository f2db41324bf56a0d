"""Readers and writers on files that the query itself writes to the shared folder, predicates, lookups and text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.functions.geo import tile
from sonolith.plans.noise import _H, _RP, _tile, heard, pieces, receivers
from sonolith.plans.tracks import fixes
from sonolith.session import shared_dir
from sonolith.sources import files, table


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def S1_ipc(spark: SparkSession, folder: str) -> DataFrame:
    """Events through Arrow IPC streams, two of the columns decoded."""
    path = _path(spark, "ipc")
    files.pack_ipc(table(spark, folder, "events").select("event_id", "user_id", "value")).write.parquet(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    return files.read_ipc(spark.read.parquet(path), schema)


def S2_squares(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written by status, one partition read back: the others aren't listed."""
    path = _path(spark, "orders")
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.write_partitions(o, path, ["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


def S3_stamped(spark: SparkSession, folder: str) -> DataFrame:
    """A table whose stamp is checked before it is read."""
    path = _path(spark, "nation")
    files.stamp(table(spark, folder, "nation"), "n_nationkey", "grid", "z30").write.parquet(path)
    return files.require_stamp(spark.read.parquet(path), "n_nationkey", "grid", "z30").select("n_nationkey", "n_name")


def S6_scoped(spark: SparkSession, folder: str, in_scope: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Positions in scope, by a predicate that the caller gives: it reaches the scan as a pushed filter."""
    in_scope = in_scope or (lambda lat, lon: lat.between(40, 55) & lon.between(-10, 20))
    return table(spark, folder, "turbines").where(in_scope(F.col("lat"), F.col("lon"))).select("record_id", "lat", "lon")


def S7_ground_legs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbours that both rest."""
    w = Window.partitionBy("address").orderBy("t", "id")
    f = fixes(spark, folder).withColumn("from_id", F.lag("id").over(w)).withColumn("before", F.lag("resting").over(w))
    return f.where("resting and before").select("address", "from_id", F.col("id").alias("to_id"))


def _archive(spark: SparkSession, folder: str) -> DataFrame:
    """Members of an archive read back: a gzipped trace an address, each seventh cut short."""
    path = _path(spark, "archive")
    row = F.array(F.col("t").cast("string"), F.lit("50.0"), F.lit("8.0"), F.when(F.col("resting"), "ground").otherwise("1000"), F.col("speed").cast("string"))
    f = fixes(spark, folder).withColumn("r", F.struct("t", "id", row.alias("row")))
    whole = f.groupBy("address").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]).alias("rows"))
    text = F.to_json(F.struct(F.col("address").cast("string").alias("address"), F.lit(0.0).alias("start"), "rows"))
    members = whole.select(F.col("address").cast("string").alias("address"), text.alias("text"), (F.col("address") % 7 == 0).alias("bad"))
    files.compress(members, "address", "text", "bad").write.parquet(path)
    return files.read_members(spark.read.parquet(path))


def S8_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    """The members of an archive that are corrupt."""
    return _archive(spark, folder).where("fault is not null").select(F.col("name").cast("long").alias("address"), "fault")


def S10_traces(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes of the intact members, by address: their number, those on the ground, the highest speed."""
    t = files.traces(_archive(spark, folder).where("fault is null"))
    return t.groupBy(F.col("address").cast("long").alias("address")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("on_ground"), 1)).alias("ground"), F.max("speed_kt").alias("fastest")
    )


def S11_export(spark: SparkSession, folder: str) -> DataFrame:
    """The export of each day: the first whole one (F); where there is none, the intact alternative (P) if it is the only
    one; days of neither have none."""
    o = table(spark, folder, "orders").groupBy("o_orderdate").agg(
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("whole"),
        F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("other"),
        F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("others"),
    )
    pick = F.coalesce("whole", F.when(F.col("others") == 1, F.col("other")))
    return o.select("o_orderdate", pick.alias("o_orderkey")).where("o_orderkey is not null")


def S12_delimited(spark: SparkSession, folder: str) -> DataFrame:
    """Customers through tab-separated text in a declared schema."""
    path = _path(spark, "customer")
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.write.csv(path, sep="\t", header=True)
    return files.read_delimited(spark, path, c.schema)


def S16_heights(spark: SparkSession, folder: str) -> DataFrame:
    """The height of the node nearest to each event; a void is an error."""
    grid = table(spark, folder, "orders").select((F.col("o_orderkey")).alias("node"), F.col("o_totalprice").alias("v"))
    probes = table(spark, folder, "events").select("event_id", F.floor(F.col("event_id") + 0.4).alias("node"))
    j = probes.join(grid, "node", "left")
    return j.select("event_id", F.coalesce("v", F.raise_error(F.lit("void")).cast("double")).alias("height_m"))


def S17_water(spark: SparkSession, folder: str) -> DataFrame:
    """The share of water of each receiver's cell of a quarter degree, none where no cell is known."""
    water = pieces(spark, folder).groupBy(F.floor(F.col("p_lat") * 4).alias("i"), F.floor(F.col("p_lon") * 4).alias("j")).agg(
        F.least(F.count(F.lit(1)) / 100, F.lit(1.0)).alias("share")
    )
    r = receivers(spark, folder).withColumn("i", F.floor(F.col("lat") * 4)).withColumn("j", F.floor(F.col("lon") * 4))
    return r.join(water, ["i", "j"], "left").select("record_id", F.coalesce("share", F.lit(0.0)).alias("share"))


def S20_held(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the wanted tiles (of the receivers) are held (have a runway point), at zoom 9."""
    rx, ry = tile(F.col("lat"), F.col("lon"), 9)
    px, py = tile(F.col("p_lat"), F.col("p_lon"), 9)
    wanted = receivers(spark, folder).select(rx.alias("x"), ry.alias("y")).distinct()
    held = pieces(spark, folder).select(px.alias("x"), py.alias("y")).distinct()
    return wanted.join(held, ["x", "y"], "left_semi")


def S24_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One address in a table sorted by address: row groups beside it are skipped by their statistics."""
    path = _path(spark, "tracks")
    fixes(spark, folder).select("address", "t", "speed").repartitionByRange("address").sortWithinPartitions("address", "t").write.parquet(path)
    return spark.read.parquet(path).where("address = 7")


def S26_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of an OPL text with a farm tag, lifecycle ones left out."""
    path = _path(spark, "opl")

    def escaped(x: Column) -> Column:
        for c, code in (("%", "%25%"), (" ", "%20%"), (",", "%2c%"), ("=", "%3d%"), ("\t", "%9%"), ("\n", "%a%"), ("ö", "%f6%"), ("é", "%e9%")):
            x = F.replace(x, F.lit(c), F.lit(code))
        return x

    t = table(spark, folder, "turbines").where(F.col("farm").isNotNull() & (F.length(F.trim("farm")) > 0))
    state = F.when(F.col("record_id") % 5 == 0, F.lit("disused:power")).otherwise(F.lit("power"))
    line = F.concat(F.lit("n"), F.col("record_id"), F.lit(" v1 T"), state, F.lit("=generator,name="), escaped(F.col("farm")), F.lit(" x8.0 y50.0"))
    t.select(line.alias("value")).write.text(path)
    tags = files.opl_tags(F.col("value"))
    read = spark.read.text(path).select(F.regexp_extract("value", r"^n(\d+)", 1).cast("long").alias("id"), tags.alias("tags"))
    return read.where("tags['power'] = 'generator'").select("id", F.col("tags")["name"].alias("name"))


def K2_written(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each partition of a table that is complete: its marker is written last."""
    path = _path(spark, "parts")
    files.write_partitions(table(spark, folder, "part").select("p_partkey", "p_size"), path, ["p_size"])
    if not files.is_complete(spark, path):
        raise ValueError("the table is not complete")
    return spark.read.parquet(path).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


def K6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """A report of every decision as JSON lines, read back."""
    path = _path(spark, "audit")
    low = F.col("s_acctbal") < 0
    audit = table(spark, folder, "supplier").select("s_suppkey", F.when(low, "refused").otherwise("taken").alias("decision"), F.when(low, "balance").alias("reason"))
    audit.write.json(path, ignoreNullFields=False)
    return files.read_counts(spark, path, audit.schema)


def K7_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle of two tables is published by a manifest written last, and verified against it on reading."""
    path = _path(spark, "bundle")
    parts = {n: table(spark, folder, n) for n in ("nation", "region")}
    rows = []
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")
        rows.append((name, df.count()))
    spark.createDataFrame(rows, "name string, n long").coalesce(1).write.json(f"{path}/manifest")
    manifest = spark.read.schema("name string, n long").json(f"{path}/manifest")
    counted = None
    for name in parts:
        one = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("found")).withColumn("name", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return manifest.join(counted, "name").select("name", "n", (F.col("n") == F.col("found")).alias("whole"))


def P6_owned(spark: SparkSession, folder: str) -> DataFrame:
    """Runway points copied to the squares around them and owned by one: those of their own square stay."""
    x, y = tile(F.col("p_lat"), F.col("p_lon"), 6)
    p = pieces(spark, folder).select("point_id", x.alias("x"), y.alias("y"))
    halo = p.withColumn("sx", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)))
    return halo.where("sx = x").groupBy("sx").agg(F.count(F.lit(1)).alias("n"))


def P12_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose balance is above the listing floor of 0 dB (an energy above 1)."""
    c = table(spark, folder, "customer")
    return c.where(F.col("c_acctbal") > 1.0).select("c_custkey")


def P14_searchable(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose type is among the values that their brand allows (a small table of rules)."""
    rules = spark.createDataFrame([("Brand#1", "ECONOMY"), ("Brand#2", "STANDARD"), ("Brand#2", "PROMO"), ("Brand#3", "SMALL")], "p_brand string, p_type string")
    return table(spark, folder, "part").join(F.broadcast(rules), ["p_brand", "p_type"], "left_semi").select("p_partkey")


def P16_in_view(spark: SparkSession, folder: str) -> DataFrame:
    """Receivers in a view of 300 to 380 degrees, of whatever copy of the world."""
    r = receivers(spark, folder)
    turned = F.col("lon") + 360 * F.floor((340.0 - F.col("lon")) / 360.0 + 0.5)
    return r.where(turned.between(300, 380)).select("record_id")


def P18_subset(spark: SparkSession, folder: str, wanted: tuple[str, ...] = ("day", "night")) -> DataFrame:
    """A choice of layers: all give the sum as it is, one its own, others are combined from their parts alone."""
    n = F.col("event_id") % 3
    f = table(spark, folder, "events").withColumn("layer", F.when(n == 0, "day").when(n == 1, "evening").otherwise("night"))
    return f.where(F.col("layer").isin(*wanted)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def P21_asked(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces that were asked for stay one by one, the others are one row an aerodrome."""
    p = pieces(spark, folder).withColumn("asked", F.col("kind") == "threshold").where("asked is not null")
    row = F.when(F.col("asked"), F.col("point_id").cast("string")).otherwise(F.lit("rest"))
    return p.groupBy("airport", row.alias("row")).agg(F.count(F.lit(1)).alias("n"), F.max("power_db").alias("loudest"))


def T2_float_order(spark: SparkSession, folder: str) -> DataFrame:
    """A total order of numbers in which unknown comes first and not-a-number last; negative zero is zero."""
    x = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).when(F.col("event_id") % 50 == 1, F.lit(-0.0)).when(F.col("event_id") % 50 == 2, F.lit(None)).otherwise(F.col("value"))
    e = table(spark, folder, "events").select("event_id", "user_id", x.alias("x"))
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("x"), "event_id")
    return e.select("event_id", F.row_number().over(w).cast("long").alias("place"))


def T10_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Two events a user of the highest whole hundred, ties decided by a hash so that they spread over time."""
    e = table(spark, folder, "events")
    order = [F.desc(F.floor(F.col("value") / 100)), F.md5(F.col("event_id").cast("string")), F.col("event_id")]
    w = Window.partitionBy("user_id").orderBy(*order)
    return e.withColumn("place", F.row_number().over(w)).where("place <= 2").select("user_id", "event_id")


def J33_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes of the ten fastest addresses by (address, start)."""
    f = fixes(spark, folder)
    listed = f.groupBy("address").agg(F.max("speed").alias("top"), F.min("t").alias("start")).orderBy(F.desc("top"), "address").limit(10)
    starts = f.groupBy("address").agg(F.min("t").alias("start"))
    track = f.join(starts, "address").select("address", "start", "id")
    return track.join(F.broadcast(listed.select("address", "start")), ["address", "start"]).select("address", "id")


def J39_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the customer that they belong to."""
    e, c = table(spark, folder, "events"), table(spark, folder, "customer")
    return e.join(c, e.user_id == c.c_custkey).select("event_id", "c_name")


def J45_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Parts without those that a line of the largest quantity names."""
    gone = table(spark, folder, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").join(gone, "p_partkey", "left_anti").select("p_partkey")


def J46_owner(spark: SparkSession, folder: str) -> DataFrame:
    """The square (zoom 9) that owns each point: its tile's, in one step."""
    x, y = tile(F.col("p_lat"), F.col("p_lon"), 12)
    return pieces(spark, folder).select("point_id", F.shiftright(x, 3).alias("x9"), F.shiftright(y, 3).alias("y9"))


def F_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the month, a date 40 days on, nights to the year's end, and days since 2020."""
    d = F.to_date("o_orderdate")
    out = table(spark, folder, "orders").select(d.alias("d")).distinct()
    year_end = F.make_date(F.year("d"), F.lit(12), F.lit(31))
    return out.select(
        F.col("d").cast("string").alias("day"), F.day(F.last_day("d")).alias("month_days"), F.date_add("d", 40).cast("string").alias("later"),
        F.datediff(year_end, F.col("d")).alias("nights"), F.datediff(F.col("d"), F.lit("2020-01-01").cast("date")).alias("date_id"),
    )


def F_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on texts: a flight number (three letters, a digit), an interval in minutes, a real date, a length with unit."""
    key = F.col("o_orderkey")
    o = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.substring("o_orderpriority", 3, 3), (key % 10).cast("string")).alias("callsign"),
        F.concat((key % 30).cast("string"), F.when(key % 2 == 0, F.concat(F.lit(":"), (key % 75).cast("string"))).otherwise("")).alias("interval"),
        F.concat(F.lit("2024-"), F.lpad((key % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 33).cast("string"), 2, "0")).alias("date"),
        F.concat((key % 200).cast("string"), F.lit(","), (key % 10).cast("string"), F.when(key % 3 == 0, " m").when(key % 3 == 1, "").otherwise(" ft")).alias("hub"),
    )
    parts = F.split("interval", ":")
    first, second = F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    minutes = F.when(second.isNull(), first).when(second < 60, 60 * first + second).otherwise(0.0)
    hub = F.regexp_extract("hub", r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*(?:m|metres|meters)?\s*$", 1)
    real = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("date").try_cast("date").isNotNull()
    return o.select(
        "o_orderkey", F.col("callsign").rlike("^[A-Za-z]{3}[0-9]").alias("flight_number"), F.when(minutes.between(2, 720), minutes).alias("minutes"),
        real.alias("is_date"), F.replace(F.when(hub != "", hub), F.lit(","), F.lit(".")).cast("double").alias("hub_m"),
    )


def F_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The highest voltage (kV) of a list in a tag, a bare number in volts."""
    key = F.col("p_partkey")
    text = F.concat((key % 400 * 1000).cast("string"), F.lit(";"), (key % 110).cast("string"), F.lit(" kV"), F.when(key % 4 == 0, ";x").otherwise(""))
    tags = F.from_json(F.to_json(F.create_map(F.lit("voltage"), text)), "map<string,string>")
    p = table(spark, folder, "part").select("p_partkey", tags.alias("tags"))
    kv = F.transform(
        F.split(F.col("tags")["voltage"], ";"),
        lambda x: F.when(x.rlike(r"^\s*\d+\s*$"), F.trim(x).try_cast("double") / 1000).when(x.rlike(r"^\s*\d+ kV\s*$"), F.regexp_extract(x, r"(\d+)", 1).try_cast("double")),
    )
    best = F.array_max(F.filter(kv, lambda v: v > 0))
    return p.select("p_partkey", best.alias("kv"))


def F_snap_box(spark: SparkSession, folder: str) -> DataFrame:
    """The box around each aerodrome moved out to a grid of 1, 2 or 5 times a power of ten, at most a quarter of its side."""
    p = pieces(spark, folder).groupBy("airport").agg(F.min("p_lat").alias("s"), F.max("p_lat").alias("n"), F.min("p_lon").alias("w"), F.max("p_lon").alias("e"))
    quarter = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(0.001)) / 4
    decade = F.pow(F.lit(10.0), F.floor(F.log10(quarter)))
    grid = F.when(5 * decade <= quarter * (1 + 1e-9), 5 * decade).when(2 * decade <= quarter * (1 + 1e-9), 2 * decade).otherwise(decade)
    p = p.withColumn("g", grid)

    def down(c: str) -> Column:
        return F.floor(F.floor(F.col(c) / F.col("g") + 1e-9) * F.col("g") * 1e6 + 0.5) / 1e6

    def up(c: str) -> Column:
        return F.floor(F.ceil(F.col(c) / F.col("g") - 1e-9) * F.col("g") * 1e6 + 0.5) / 1e6

    return p.select("airport", down("s").alias("south"), down("w").alias("west"), up("n").alias("north"), up("e").alias("east"))


def X1_ring_by_ring(spark: SparkSession, folder: str) -> DataFrame:
    """Answers ring by ring from one pass: each ring's own sums, then running sums over the rings, so that every answer is
    complete for what it covers and the last one is the whole."""

    ring = F.least(F.floor(F.col("distance_m") / 4000), F.lit(2)).cast("int")
    own = heard(spark, folder).groupBy("record_id", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.max("level_db").alias("loudest"))
    w = Window.partitionBy("record_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
    out = own.select("record_id", "ring", F.sum("n").over(w).alias("pieces"), F.max("loudest").over(w).alias("loudest"))
    return out.withColumn("partial", F.col("ring") < 2)


QUERIES = {
    q.__name__: q
    for q in (
        S1_ipc, S2_squares, S3_stamped, S6_scoped, S7_ground_legs, S8_corrupt, S10_traces, S11_export, S12_delimited, S16_heights, S17_water,
        S20_held, S24_lookup, S26_features, K2_written, K6_audit, K7_bundle, P6_owned, P12_listed, P14_searchable, P16_in_view, P18_subset,
        P21_asked, T2_float_order, T10_spread, J33_listed, J39_sessions, J45_removed, J46_owner, F_dates, F_texts, F_tags, F_snap_box, X1_ring_by_ring,
    )
}

_F = "f as (select user_id as address, epoch_us(ts) // 1000000 as t, value as speed, event_type in ('signup', 'error') as resting, event_id as id from events)"
_KV = "list_transform(string_split(v, ';'), lambda x: case when regexp_full_match(x, '\\s*[0-9]+\\s*') then cast(trim(x) as double) / 1000 when regexp_full_match(x, '\\s*[0-9]+ kV\\s*') then cast(regexp_extract(x, '([0-9]+)', 1) as double) end)"
SQL = {
    "S1_ipc": "select event_id, value from events",
    "S2_squares": "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'",
    "S3_stamped": "select n_nationkey, n_name from nation",
    "S6_scoped": "select record_id, lat, lon from turbines where lat between 40 and 55 and lon between -10 and 20",
    "S7_ground_legs": f"with {_F}, p as (select *, lag(id) over w as from_id, lag(resting) over w as before from f window w as (partition by address order by t, id)) select address, from_id, id as to_id from p where resting and before",
    "S8_corrupt": "select distinct user_id as address, 'corrupt' as fault from events where user_id % 7 = 0",
    "S10_traces": f"with {_F} select address, count(*) as n, count(*) filter (where resting) as ground, max(speed) as fastest from f where address % 7 <> 0 group by address",
    "S11_export": """with d as (select o_orderdate, min(o_orderkey) filter (where o_orderstatus = 'F') as w, min(o_orderkey) filter (where o_orderstatus = 'P') as p,
        count(*) filter (where o_orderstatus = 'P') as n from orders group by 1) select o_orderdate, coalesce(w, case when n = 1 then p end) as o_orderkey from d where coalesce(w, case when n = 1 then p end) is not null""",
    "S12_delimited": "select c_custkey, c_name, c_acctbal from customer",
    "S16_heights": "select event_id, o_totalprice as height_m from events join orders on o_orderkey = event_id",
    "S17_water": f"""{_RP}, s as (select floor(p_lat * 4) as i, floor(p_lon * 4) as j, least(count(*) / 100.0, 1.0) as share from p group by 1, 2)
        select record_id, coalesce(share, 0.0)::double as share from r left join s on s.i = floor(lat * 4) and s.j = floor(lon * 4)""",
    "S20_held": f"{_RP} select distinct {_tile('lat', 'lon', 9)[0]} as x, {_tile('lat', 'lon', 9)[1]} as y from r intersect select {_tile('p_lat', 'p_lon', 9)[0]}, {_tile('p_lat', 'p_lon', 9)[1]} from p",
    "S24_lookup": f"with {_F} select address, t, speed from f where address = 7",
    "S26_features": "select record_id as id, farm as name from turbines where farm is not null and length(trim(farm)) > 0 and record_id % 5 <> 0",
    "K2_written": "select p_size, count(*) as n from part group by 1",
    "K6_audit": "select s_suppkey, case when s_acctbal < 0 then 'refused' else 'taken' end as decision, case when s_acctbal < 0 then 'balance' end as reason from supplier",
    "K7_bundle": "select 'nation' as name, count(*) as n, true as whole from nation union all select 'region', count(*), true from region",
    "P6_owned": f"{_RP} select {_tile('p_lat', 'p_lon', 6)[0]} as sx, count(*) as n from p group by 1",
    "P12_listed": "select c_custkey from customer where c_acctbal > 1",
    "P14_searchable": "select p_partkey from part where (p_brand, p_type) in (('Brand#1', 'ECONOMY'), ('Brand#2', 'STANDARD'), ('Brand#2', 'PROMO'), ('Brand#3', 'SMALL'))",
    "P16_in_view": f"{_RP} select record_id from r where lon + 360 * floor((340.0 - lon) / 360.0 + 0.5) between 300 and 380",
    "P18_subset": "select user_id, count(*) as n, max(value) as top from events where event_id % 3 in (0, 2) group by 1",
    "P21_asked": f"{_RP} select airport, case when kind = 'threshold' then point_id::varchar else 'rest' end as row, count(*) as n, max(power_db) as loudest from p where kind is not null group by 1, 2",
    "T2_float_order": """with e as (select event_id, user_id, case event_id % 50 when 0 then 'nan'::double when 1 then 0.0 when 2 then null else value end as x from events)
        select event_id, row_number() over (partition by user_id order by x nulls first, event_id) as place from e""",
    "T10_spread": "select user_id, event_id from events qualify row_number() over (partition by user_id order by floor(value / 100) desc, md5(event_id::varchar), event_id) <= 2",
    "J33_listed": f"with {_F}, l as (select address, max(speed) as top from f group by 1 order by top desc, address limit 10) select address, id from f where address in (select address from l)",
    "J39_sessions": "select event_id, c_name from events join customer on user_id = c_custkey",
    "J45_removed": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 50)",
    "J46_owner": f"{_RP} select point_id, {_tile('p_lat', 'p_lon', 12)[0]} >> 3 as x9, {_tile('p_lat', 'p_lon', 12)[1]} >> 3 as y9 from p",
    "F_dates": """select distinct o_orderdate::date::varchar as day, day(last_day(o_orderdate::date))::int as month_days, (o_orderdate::date + 40)::date::varchar as later,
        (make_date(year(o_orderdate), 12, 31) - o_orderdate::date)::int as nights, (o_orderdate::date - date '2020-01-01')::int as date_id from orders""",
    "F_texts": """with o as (select o_orderkey as k, substr(o_orderpriority, 3, 3) || (o_orderkey % 10) as callsign, (o_orderkey % 30)::double as a, case when o_orderkey % 2 = 0 then (o_orderkey % 75)::double end as b,
            '2024-' || lpad((o_orderkey % 14)::varchar, 2, '0') || '-' || lpad((o_orderkey % 33)::varchar, 2, '0') as d from orders),
        m as (select *, case when b is null then a when b < 60 then 60 * a + b else 0.0 end as m from o)
        select k as o_orderkey, regexp_matches(callsign, '^[A-Za-z]{3}[0-9]') as flight_number, case when m between 2 and 720 then m end as minutes, try_cast(d as date) is not null as is_date,
        case when k % 3 < 2 then (k % 200) + (k % 10) / 10.0 end as hub_m from m""",
    "F_tags": f"""with p as (select p_partkey, (p_partkey % 400 * 1000) || ';' || (p_partkey % 110) || ' kV' || case when p_partkey % 4 = 0 then ';x' else '' end as v from part)
        select p_partkey, list_max(list_filter({_KV}, lambda x: x > 0)) as kv from p""",
    "F_snap_box": f"""{_RP}, b as (select airport, min(p_lat) as s, max(p_lat) as n, min(p_lon) as w, max(p_lon) as e from p group by 1),
        q as (select *, greatest(n - s, e - w, 0.001) / 4 as quarter from b), d as (select *, pow(10.0, floor(log10(quarter))) as decade from q),
        g as (select *, case when 5 * decade <= quarter * (1 + 1e-9) then 5 * decade when 2 * decade <= quarter * (1 + 1e-9) then 2 * decade else decade end as g from d)
        select airport, floor(floor(s / g + 1e-9) * g * 1e6 + 0.5) / 1e6 as south, floor(floor(w / g + 1e-9) * g * 1e6 + 0.5) / 1e6 as west,
        floor(ceil(n / g - 1e-9) * g * 1e6 + 0.5) / 1e6 as north, floor(ceil(e / g - 1e-9) * g * 1e6 + 0.5) / 1e6 as east from g""",
    "X1_ring_by_ring": f"""{_H}, x as (select record_id, least(floor(d / 4000), 2)::int as ring, floor((power_db - 20 * log10(greatest(d, 1.0)) - 11) * 1000.0 + 0.5) / 1000.0 as l from h),
        o as (select record_id, ring, count(*) as n, max(l) as l from x group by 1, 2)
        select record_id, ring, (sum(n) over w)::bigint as pieces, max(l) over w as loudest, ring < 2 as partial from o window w as (partition by record_id order by ring)""",
}
