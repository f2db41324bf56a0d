"""Relational queries over orders, line items and their dimensions: aggregates, lookups, sets, rasters, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.hashes import fnv1a
from sonolith.functions.levels import interpolate_nodes, loudness_code, loudness_of, p_norm, rounded
from sonolith.functions.text import bare_name, collapse_space
from sonolith.operators import graphs, grids, grouping, selection
from sonolith.sources import files, table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


def _month(column: str):
    return F.date_format(column, "yyyy-MM")


def A6_average_day(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines count for a year of 365 days, others for half a year, by supplier."""
    w = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 365).otherwise(F.col("l_quantity") / 182.5)
    return _lines(spark, folder).groupBy("l_suppkey").agg(rounded(F.sum(w)).alias("per_day"))


def A9_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Nested thresholds: 20 or more includes 40 or more."""
    return _lines(spark, folder).groupBy("l_shipdate").agg(
        *[F.count(F.when(F.col("l_quantity") >= t, 1)).alias(f"q{t}") for t in (10, 20, 40)]
    )


def A10_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    mean = F.try_divide(F.sum(F.col("l_quantity") * F.col("l_discount")), F.sum("l_quantity"))
    return _lines(spark, folder).groupBy("l_partkey").agg(rounded(mean, 6).alias("discount"))


def A11_weighted_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The ship mode of most quantity (line status and return flag) by supplier."""
    lines = _lines(spark, folder).withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return grouping.weighted_mode(lines, ["l_suppkey"], "kind", "l_quantity")


def A12_distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines copied to each square that they meet, counted once."""
    copies = _lines(spark, folder).withColumn("square", F.explode(F.sequence(F.lit(0), (F.col("l_linenumber") % 3).cast("int"))))
    once = copies.dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return once.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))


def A15_run_median(spark: SparkSession, folder: str) -> DataFrame:
    """The quantity-weighted median price of each order."""
    return grouping.weighted_median(
        _lines(spark, folder), ["l_orderkey"], "l_extendedprice", "l_quantity", "l_linenumber"
    )


def A18_two_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The two dearest parts of each supplier, a part once."""
    best = _lines(spark, folder).groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("p"))
    top = selection.top_k(best, ["l_suppkey"], [F.desc("p"), F.col("l_partkey")], 2)
    return top.select("l_suppkey", "rank", "l_partkey", "p")


def A23_density(spark: SparkSession, folder: str) -> DataFrame:
    cell = [(F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")]
    return _lines(spark, folder).groupBy(*cell).agg(F.sum("l_quantity").alias("trips"))


def A24_box_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity in the square of +-2 cells around each cell."""
    return grids.box_sums(A23_density(spark, folder), "x", "y", "trips", 2)


def A43_catchment(spark: SparkSession, folder: str) -> DataFrame:
    """Two-step floating catchment: each origin's trips over the spaces in its window, summed over the window of the
    spaces' cell, at most 1."""
    trips = A23_density(spark, folder)
    spaces = _lines(spark, folder).where("l_linenumber = 1").groupBy(
        (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")
    ).agg(F.count(F.lit(1)).cast("double").alias("spaces"))
    # Spaces around every cell with trips: both tables in one grid of sums.
    both = trips.join(spaces, ["x", "y"], "full").na.fill(0.0, ["trips", "spaces"])
    around = both.join(grids.box_sums(both, "x", "y", "spaces", 1, "reach"), ["x", "y"])
    ratio = around.withColumn("ratio", F.coalesce(F.try_divide("trips", F.col("reach") * 100), F.lit(0.0)))
    summed = grids.box_sums(ratio, "x", "y", "ratio", 1, "share")
    out = summed.join(spaces, ["x", "y"])
    return out.select("x", "y", rounded(F.least(F.lit(1.0), F.col("share"))).alias("share"))


def A27_monthly_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Mean price of a priority in each month, the priority's overall mean where the month has fewer than 20 orders."""
    o = _orders(spark, folder).withColumn("month", _month("o_orderdate"))
    per = o.groupBy("o_orderpriority", "month").agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    whole = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("w"))
    j = per.join(whole, "o_orderpriority")
    rate = F.when(F.col("n") >= 20, F.col("m")).otherwise(F.col("w"))
    return j.select("o_orderpriority", "month", rounded(rate, 2).alias("rate"))


def A28_deficits(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that a month lacks to 1.1 times its year's mean, split among priorities as observed."""
    o = _orders(spark, folder).groupBy(_month("o_orderdate").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    of_month, of_year = Window.partitionBy("month"), Window.partitionBy(F.substring("month", 1, 4))
    o = o.withColumn("total", F.sum("n").over(of_month)).withColumn("year_n", F.sum("n").over(of_year))
    months = F.size(F.collect_set("month").over(of_year))
    o = o.withColumn("missing", F.greatest(F.col("year_n") / months * 1.1 - F.col("total"), F.lit(0.0)))
    return o.select("month", "o_orderpriority", rounded(F.col("missing") * F.col("n") / F.col("total")).alias("added"))


def A30_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by part and supplier capped at two, summed by part and return flag as columns."""
    per = _lines(spark, folder).groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n"))
    return per.groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("n")).na.fill(0, ["A", "N", "R"])


def A31_least_price(spark: SparkSession, folder: str) -> DataFrame:
    """The least of two supplier prices where one may be unknown."""
    one = F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice"))
    two = F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice") * 0.5 + 500)
    return table(spark, folder, "part").select("p_partkey", rounded(F.array_min(F.array(one, two)), 3).alias("price"))


def A33_pyramid(spark: SparkSession, folder: str) -> DataFrame:
    """Mean quantity of 256 x 256 cells, folded eight times."""
    cells = _lines(spark, folder).groupBy((F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 256).alias("y")).agg(
        F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("weight")
    )
    out = grids.pyramid(cells, "x", "y", [], "mean", "weight", 8)
    return out.select("up", "x", "y", rounded(F.col("mean"), 5).alias("mean"), "weight")


def A34_combine(spark: SparkSession, folder: str) -> DataFrame:
    """Level codes of the layers (return flags) of a cell combined; a quantity of 50 isn't assessed."""
    code = F.when(F.col("l_quantity") >= 50, 255).when(F.col("l_quantity") <= 2, 254).otherwise(F.col("l_quantity") * 2 + 60)
    cells = _lines(spark, folder).select((F.col("l_partkey") % 500).alias("x"), "l_returnflag", code.cast("int").alias("code"))
    layer = cells.groupBy("x", "l_returnflag").agg(F.min("code").alias("code"))
    return grids.combine_codes(layer, ["x"], "code")


def A34_p_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Combination with an exponent that depends on the largest of three values."""
    values = F.array("p_size", F.col("p_size") / 2.0, F.lit(3.0))
    values = F.transform(values, lambda x: x.cast("double"))
    p = interpolate_nodes(F.array_max(values), [(5.0, 1.0), (20.0, 2.0), (45.0, 3.0)])
    return table(spark, folder, "part").select("p_partkey", rounded(p_norm(values, p), 3).alias("combined"))


def A35_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).select("l_linestatus", "bin", rounded(F.col("share"), 6).alias("share"))


def _bins(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the bins (5 wide) of quantity by status and flag."""
    n = _lines(spark, folder).groupBy("l_linestatus", "l_returnflag", F.floor(F.col("l_quantity") / 5).alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    return grouping.shares(n, ["l_linestatus", "l_returnflag"], "n")


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    weight = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.25)
    return grids.mixture(_bins(spark, folder).withColumn("w", weight), ["l_linestatus"], "bin", "share", "w")


def A36_convolution(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of two independent quantities, one of each flag."""
    b = _bins(spark, folder)
    one, two = (b.where(F.col("l_returnflag") == f) for f in ("A", "R"))
    out = grids.convolve(one, two, ["l_linestatus"], "bin", "share", F.col("a_bin") + F.col("b_bin"))
    return out.select("l_linestatus", "bin", rounded(F.col("share"), 6).alias("share"))


def A37_exceeded(spark: SparkSession, folder: str) -> DataFrame:
    """The quantity bins exceeded for 10, 50 and 90 % of the lines."""
    lines = _lines(spark, folder).groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("share"))
    return grids.exceeded(lines, ["l_suppkey"], "bin", "share", {"l10": 0.1, "l50": 0.5, "l90": 0.9})


def A39_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and volume of the last 90 days before the newest order, by customer, zero where none."""
    o = _orders(spark, folder)
    newest = o.agg((F.max("o_orderdate") - F.expr("interval 90 days")).alias("m")).scalar()
    recent = o.where(F.col("o_orderdate") > newest).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v")
    )
    c = table(spark, folder, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0.0)
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), rounded(F.coalesce("v", zero), 2).alias("volume"))


def A40_error_report(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank 95th percentile, maximum and signed mean of the line totals against the order, by priority."""
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    sums = _lines(spark, folder).groupBy("l_orderkey").agg(total.alias("t"))
    j = _orders(spark, folder).join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.select("o_orderpriority", rounded((F.col("t") - F.col("o_totalprice")) / 1000, 3).alias("e"))
    e = e.withColumn("size", F.abs("e"))
    ranked = selection.exact_ranks(e, ["o_orderpriority"], "size", {"p95": grouping.nearest_rank(0.95)})
    rest = e.groupBy("o_orderpriority").agg(F.max("size").alias("worst"), rounded(F.avg("e"), 2).alias("bias"))
    return rest.join(ranked, "o_orderpriority").select("o_orderpriority", "p95", "worst", "bias")


def A42_buckets(spark: SparkSession, folder: str) -> DataFrame:
    out = grouping.equal_count_buckets(_lines(spark, folder), ["l_orderkey"], [F.col("l_linenumber")], 3)
    return out.select("l_orderkey", "l_linenumber", "bucket")


def A44_local_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Returned share of a supplier's quantity by year with at least 30 lines, else the year's, else none."""
    l = _lines(spark, folder).withColumn("year", F.year("l_shipdate")).withColumn("r", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    own = l.groupBy("l_suppkey", "year").agg(F.sum("r").alias("a"), F.sum("l_quantity").alias("b"), F.count(F.lit(1)).alias("n"))
    whole = l.groupBy("year").agg(F.sum("r").alias("wa"), F.sum("l_quantity").alias("wb"))
    j = own.join(F.broadcast(whole), "year")  # one row a year
    ratio = F.when(F.col("n") >= 30, F.col("a") / F.col("b")).otherwise(F.try_divide("wa", "wb"))
    return j.select("l_suppkey", "year", rounded(ratio).alias("ratio"))


def A50_period_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over day, evening and night (12, 4 and 8 hours) of three statuses."""
    mean = [F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))) for f in ("A", "N", "R")]
    return _lines(spark, folder).groupBy("l_suppkey").agg(
        rounded((mean[0] * 12 + mean[1] * 4 + mean[2] * 8) / 24).alias("mean")
    )


def A51_feathered(spark: SparkSession, folder: str) -> DataFrame:
    """Blend of overlapping values with weights, their sum at least one."""
    w = F.col("l_discount") * 10
    return _lines(spark, folder).groupBy("l_partkey").agg(
        rounded(F.sum(w * F.col("l_quantity")) / F.greatest(F.sum(w), F.lit(1.0))).alias("blend")
    )


def S14_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of mean quantities read between its nodes at each part's place."""
    grid = _lines(spark, folder).groupBy((F.col("l_partkey") % 20).alias("gx"), (F.col("l_suppkey") % 20).alias("gy")).agg(
        F.avg("l_quantity").alias("v")
    )
    p = table(spark, folder, "part").select(
        "p_partkey", (F.col("p_partkey") % 181 / 10.0).alias("x"), (F.col("p_size") % 19 + 0.25).alias("y")
    )
    return grids.bilinear(p, grid, "x", "y", "gx", "gy", "v", "value").select("p_partkey", rounded(F.col("value")).alias("value"))


def J34_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their order's customer and nation."""
    o = _orders(spark, folder).select("o_orderkey", "o_custkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    j = _lines(spark, folder).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


def J35_lookup_all(spark: SparkSession, folder: str, known: str = "true") -> DataFrame:
    """A fixed lookup (nations to regions) with a default on a miss."""
    n = table(spark, folder, "nation").where(known).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, folder, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", F.coalesce("r_name", F.lit("elsewhere")).alias("region"))


def J35_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: every fourth nation is unknown (see J35_lookup_all)."""
    return J35_lookup_all(spark, folder, "n_nationkey % 4 <> 0")


def J37_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """A price for each line: the part's own from January, else of its month, else of its supplier, else none."""
    l = _lines(spark, folder).withColumn("m", F.month("l_shipdate"))
    jan = l.where("m = 1").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("a"))
    mon = l.where("m < 4").groupBy("l_suppkey", "m").agg(F.min("l_extendedprice").alias("b"))
    sup = l.where("m = 12").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("c"))
    j = l.join(jan, "l_partkey", "left").join(mon, ["l_suppkey", "m"], "left").join(sup, "l_suppkey", "left")
    source = F.when(F.col("a").isNotNull(), "part").when(F.col("b").isNotNull(), "month").when(F.col("c").isNotNull(), "supplier").otherwise("none")
    return j.groupBy("m", source.alias("source")).agg(F.count(F.lit(1)).alias("lines"), rounded(F.sum(F.coalesce("a", "b", "c")), 2).alias("price"))


def J40_drift_all(spark: SparkSession, folder: str, lines: str = "true", orders: str = "true") -> DataFrame:
    """Orders against their lines, either of which may lack the other."""
    sums = _lines(spark, folder).where(lines).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    j = _orders(spark, folder).where(orders).join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    kind = F.when(F.col("o_orderkey").isNull(), "lines only").when(F.col("l_orderkey").isNull(), "order only").otherwise("both")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("orders"))


def J40_drift(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: without first lines and every fifth order (see J40_drift_all)."""
    return J40_drift_all(spark, folder, "l_linenumber > 1", "o_orderkey % 5 <> 0")


def K4_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Days of orders that have no shipped line yet."""
    wanted = _orders(spark, folder).select(F.to_date("o_orderdate").cast("string").alias("day")).distinct()
    done = _lines(spark, folder).where("l_quantity > 49").select(F.to_date("l_shipdate").cast("string").alias("day"))
    return files.missing_partitions(wanted, done, ["day"])


def K9_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over overlapping keys, equal where both have a row."""
    p = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return files.merge_tables(p.where("p_partkey % 3 < 2"), p.where("p_partkey % 3 > 0"), ["p_partkey"], "p_retailprice")


def K10_content(spark: SparkSession, folder: str) -> DataFrame:
    """Equal part descriptions stored once under their digest."""
    text = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))
    return table(spark, folder, "part").groupBy(F.sha2(text, 256).alias("digest")).agg(
        F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("copies")
    )


def S28_overlay_all(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shipped before 1995 are the old table, all others the new one: old rows of keys that the new table lacks, and
    all rows of the new one."""
    l, fresh = _lines(spark, folder), F.coalesce(F.year("l_shipdate") >= 1995, F.lit(True))
    out = grouping.overlay(l.where(~fresh), l.where(fresh), ["l_orderkey"])
    return out.groupBy((F.col("l_orderkey") % 6).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


def S28_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it, over keys that 2 or 3 divides (see S28_overlay_all).

    Old rows of keys that the new table lacks, and all rows of the new one."""
    l = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity")
    new = l.where("l_orderkey % 3 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    out = grouping.overlay(l.where("l_orderkey % 2 = 0"), new, ["l_orderkey"])
    return out.groupBy((F.col("l_orderkey") % 6).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


def S10_json(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of events parsed from JSON, and written back."""
    e = table(spark, folder, "events").withColumn("m", F.from_json("props", "map<string,int>"))
    e = e.withColumn("k", F.element_at("m", "k"))
    return e.select("event_id", "k", F.to_json(F.struct(F.col("k").alias("n"), "event_type")).alias("line"))


def S19_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a few requested squares only."""
    t = table(spark, folder, "traffic").where(F.col("country_iso").isin("CZ", "DK") & (F.col("road_group") == 0))
    return t.groupBy("country_iso", "source_id").agg(F.count(F.lit(1)).alias("n"), F.count(files.positive(F.col("aadt"))).alias("counted"))


def T1_total_order(spark: SparkSession, folder: str) -> DataFrame:
    """A total order with a unique tail, as ranks."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", (-F.col("p_retailprice")).alias("down"), F.lit(1).alias("one"))
    ranked = selection.running_total(p, ["p_brand", "down", "p_partkey"], "one")
    first = ranked.groupBy("p_brand").agg(F.min("before").alias("first"))
    return ranked.join(first, "p_brand").select("p_partkey", (F.col("before") - F.col("first") + 1).alias("place"))


def T12_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest order of each customer, of these the newest 500."""
    last = grouping.keep_once(_orders(spark, folder), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500).select("o_custkey", "o_orderkey")


def U1_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("layer"))
    b = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("layer"))
    return a.unionByName(b).groupBy("nation", "layer").agg(F.count(F.lit(1)).alias("n"))


def U2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    l = _lines(spark, folder)
    return l.where("l_discount > 0.08").select("l_orderkey").union(l.where("l_quantity > 45").select("l_orderkey")).distinct()


def U4_difference(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    return c.subtract(_orders(spark, folder).select(F.col("o_custkey").alias("k")))


def U5_intersection(spark: SparkSession, folder: str) -> DataFrame:
    l = _lines(spark, folder)
    return l.where("l_returnflag = 'A'").select("l_partkey").intersect(l.where("l_returnflag = 'R'").select("l_partkey"))


def U3_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all line keys are order keys."""
    lost = _lines(spark, folder).select("l_orderkey").subtract(_orders(spark, folder).select(F.col("o_orderkey").alias("l_orderkey")))
    return lost.agg((F.count(F.lit(1)) == 0).alias("subset"))


def U8_halo(spark: SparkSession, folder: str) -> DataFrame:
    """Squares within one of an occupied square, each once, x wrapping at 64."""
    cells = A23_density(spark, folder).where("trips > 40").select("x", "y")
    near = cells.withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    y = F.col("y") + F.col("dy")
    return near.select(F.pmod(F.col("x") + F.col("dx"), F.lit(64)).alias("x"), y.alias("y")).where("y between 0 and 63").distinct()


def F_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Loudness codes and back."""
    sone = F.when(F.col("p_size") % 7 > 0, F.col("p_size") / 4.0 - 1)
    code = loudness_code(sone)
    return table(spark, folder, "part").select("p_partkey", code.alias("code"), rounded(loudness_of(code)).alias("sone"))


def F_names(spark: SparkSession, folder: str) -> DataFrame:
    """Row keys by name: collapsed white space, else the reference, else the own id."""
    d = table(spark, folder, "display")
    key = F.coalesce(collapse_space(F.lower("road_name")), bare_name(F.col("road_ref")), F.concat(F.lit("#"), F.col("osm_id").cast("string")))
    return d.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("pieces"))


def F_fnv(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", fnv1a(F.col("n_name")).alias("h"))


def F_digits(spark: SparkSession, folder: str) -> DataFrame:
    """Three significant digits of a price."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10("o_totalprice")) - 2)
    return _orders(spark, folder).select("o_orderkey", rounded(F.floor(F.col("o_totalprice") / scale + 0.5) * scale).alias("v"))


def D2_speed_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Speed of a piece: the sign's, else its class's median in the country, else the class's; heavy at most 80."""
    d = table(spark, folder, "display").withColumn("class", F.lower(F.trim("road_class")))
    own = d.where("speed_posted_kmh is not null").groupBy("country_iso", "class").agg(F.percentile("speed_posted_kmh", 0.5).alias("a"))
    every = d.where("speed_posted_kmh is not null").groupBy("class").agg(F.percentile("speed_posted_kmh", 0.5).alias("b"))
    j = d.join(own, ["country_iso", "class"], "left").join(every, "class", "left")
    speed = F.coalesce(F.col("speed_posted_kmh").cast("double"), "a", "b", F.lit(50.0))
    return j.select("piece_id", rounded(speed).alias("speed"), rounded(F.least(speed, F.lit(80.0))).alias("heavy"))


def F_vehicle_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicles an hour of the day by kind: two-way roads carry half uphill."""
    d = table(spark, folder, "display")
    half = F.when(F.coalesce("oneway", F.lit(False)), 1.0).otherwise(0.5)
    kinds = ("light", "medium", "heavy", "moto")
    return d.select("piece_id", *[rounded(F.col(f"aadt_{k}") * half * 0.7 / 12).alias(k) for k in kinds])


def F_piecewise(spark: SparkSession, folder: str) -> DataFrame:
    """A load by size, piecewise and clamped."""
    load = F.when(F.col("p_size") < 10, F.col("p_size") * 0.5).when(F.col("p_size") < 30, 5 + (F.col("p_size") - 10) * 0.2).otherwise(9.0)
    return table(spark, folder, "part").select("p_partkey", rounded(F.greatest(F.least(load, F.lit(8.5)), F.lit(1.0))).alias("load"))


def P7_guessed(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces whose count is estimated: by source or by any of the estimate's bits."""
    bits = F.col("traffic_estimated").bitwiseAND(5) > 0
    return table(spark, folder, "display").where(F.col("source_id").isin(1, 2, 3) | bits).select("piece_id")


def P8_implausible(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces over the capacity of their lanes (20,000 a lane and day)."""
    total = F.col("aadt_light") + F.col("aadt_medium") + F.col("aadt_heavy") + F.col("aadt_moto")
    return table(spark, folder, "display").where(total > 20000 * F.coalesce("lanes", F.lit(1))).select("piece_id")


def P17_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Quiet cells: silence passes, what isn't assessed fails."""
    return A34_combine(spark, folder).where("combined <> 255 and (combined = 254 or combined <= 140)")


def G3_components(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers connected by a line."""
    edges = _lines(spark, folder).select(
        F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10_000_000).alias("b")
    )
    return graphs.components(edges)


def G2_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Loads carried to the two sources of a network of small numbers along shortest paths."""
    n = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), "p_size").where("k > 2")
    edges = n.select(
        "k", F.explode(F.array(F.floor(F.col("k") / 2).cast("long"), F.floor(F.col("k") / 3).cast("long"))).alias("b"), "p_size"
    ).where("b > 0").select(F.col("k").alias("a"), "b", (F.col("p_size") + 1.0).alias("length"))
    sources = spark.range(1, 3).select(F.col("id").alias("node"))
    tree = graphs.shortest_tree(edges, sources)
    return graphs.accumulate(tree, n.select(F.col("k").alias("node"), F.lit(1.0).alias("load")))


QUERIES = {
    q.__name__: q
    for q in (
        A6_average_day, A9_thresholds, A10_weighted_mean, A11_weighted_mode, A12_distinct_rows, A15_run_median, A18_two_pieces,
        A23_density, A24_box_sums, A27_monthly_rates, A28_deficits, A30_capped, A31_least_price, A33_pyramid, A34_combine,
        A34_p_norm, A35_mixture, A36_convolution, A37_exceeded, A39_quota, A40_error_report, A42_buckets, A43_catchment,
        A44_local_ratio, A50_period_mean, A51_feathered, S14_bilinear, J34_metadata, J35_lookup, J35_lookup_all, J37_fallbacks, J40_drift, J40_drift_all,
        K4_resume, K9_merge, K10_content, S10_json, S19_partitions, S28_overlay, S28_overlay_all, T1_total_order, T12_newest, U1_union,
        U2_distinct, U3_subset, U4_difference, U5_intersection, U8_halo, F_codes, F_names, F_fnv, F_digits, D2_speed_cascade,
        F_vehicle_rates, F_piecewise, P7_guessed, P8_implausible, P17_masked, G3_components, G2_flow,
    )
}


def _r(x: str, places: int = 4) -> str:
    return f"floor(({x}) * {10**places}.0 + 0.5) / {10**places}.0"


_B = """b as (select l_linestatus, l_returnflag, cast(floor(l_quantity / 5) as bigint) as bin, count(*)::double as n from lineitem group by 1, 2, 3),
    s as (select *, n / sum(n) over (partition by l_linestatus, l_returnflag) as share from b)"""
_CODE = "cast(case when l_quantity >= 50 then 255 when l_quantity <= 2 then 254 else l_quantity * 2 + 60 end as int)"
_COMB = f"""with c as (select l_partkey % 500 as x, l_returnflag, min({_CODE}) as code from lineitem group by 1, 2),
    e as (select x, max(code) as top, sum(case when code < 254 then pow(10, code / 20.0) else 0 end) as e from c group by x),
    k as (select x, cast(case when top = 255 then 255 when e < 1 then 254 else least(floor(20 * log10(e) + 0.5), 253) end as int) as combined from e)"""
_GRID = "select l_partkey % 64 as x, l_suppkey % 64 as y, sum(l_quantity) as trips from lineitem group by 1, 2"

SQL = {
    "A6_average_day": f"select l_suppkey, {_r('sum(case when l_returnflag = ' + chr(39) + 'R' + chr(39) + ' then l_quantity / 365 else l_quantity / 182.5 end)')} as per_day from lineitem group by 1",
    "A9_thresholds": "select l_shipdate, " + ", ".join(f"count(*) filter (where l_quantity >= {t}) as q{t}" for t in (10, 20, 40)) + " from lineitem group by 1",
    "A10_weighted_mean": f"select l_partkey, {_r('sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0)', 6)} as discount from lineitem group by 1",
    "A11_weighted_mode": """with s as (select l_suppkey, l_returnflag || l_linestatus as kind, sum(l_quantity) as w from lineitem group by 1, 2)
        select l_suppkey, arg_min(kind, {'a': -w, 'b': kind}) as kind, max(w) as weight from s group by 1""",
    "A12_distinct_rows": "select l_returnflag, count(*) as lines from (select any_value(l_returnflag) as l_returnflag from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey) group by 1",
    "A15_run_median": """with c as (select l_orderkey, l_extendedprice, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_extendedprice, l_linenumber rows between unbounded preceding and current row) as r,
        sum(l_quantity) over (partition by l_orderkey) as t from lineitem) select l_orderkey, min(l_extendedprice) as median from c where r >= t / 2 group by 1""",
    "A18_two_pieces": """with b as (select l_suppkey, l_partkey, max(l_extendedprice) as p from lineitem group by 1, 2), k as (select *, row_number() over (partition by l_suppkey order by p desc, l_partkey) as rank from b)
        select l_suppkey, rank, l_partkey, p from k where rank <= 2""",
    "A23_density": _GRID,
    "A24_box_sums": f"with g as ({_GRID}) select a.x, a.y, sum(b.trips) as box from g a join g b on abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 group by 1, 2",
    "A27_monthly_rates": f"""with o as (select *, strftime(o_orderdate, '%Y-%m') as month from orders), w as (select o_orderpriority, avg(o_totalprice) as w from o group by 1),
        p as (select o_orderpriority, month, avg(o_totalprice) as m, count(*) as n from o group by 1, 2)
        select o_orderpriority, month, {_r('case when n >= 20 then m else w end', 2)} as rate from p join w using (o_orderpriority)""",
    "A28_deficits": f"""with o as (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, count(*) as n from orders group by 1, 2), m as (select month, sum(n) as total from o group by 1),
        y as (select substr(month, 1, 4) as year, sum(n) as y, count(distinct month) as k from o group by 1)
        select month, o_orderpriority, {_r('greatest(y / k * 1.1::double - total, 0) * n / total')} as added from o join m using (month) join y on y.year = substr(month, 1, 4)""",
    "A30_capped": """with p as (select l_partkey, l_returnflag, least(count(*), 2) as n from lineitem group by l_partkey, l_suppkey, l_returnflag)
        select l_partkey, """ + ", ".join(f"coalesce(sum(n) filter (where l_returnflag = '{f}'), 0)::bigint as \"{f}\"" for f in "ANR") + " from p group by 1",
    "A31_least_price": f"""select p_partkey, {_r("list_min([case when p_size % 3 > 0 then p_retailprice end, case when p_size % 4 > 0 then p_retailprice * 0.5 + 500 end])", 3)} as price from part""",
    "A33_pyramid": " union all ".join(
        f"select {k} as up, (l_partkey % 256) >> {k} as x, (l_suppkey % 256) >> {k} as y, {_r('sum(l_quantity) / count(*)', 5)} as mean, count(*) as weight from lineitem group by 2, 3" for k in range(1, 9)),
    "A34_combine": f"{_COMB} select x, combined from k",
    "A34_p_norm": f"""with v as (select p_partkey, [p_size::double, p_size / 2.0::double, 3.0::double] as v, greatest(p_size::double, 3.0) as m from part), q as (select *, case when m <= 5 then 1.0::double
        when m <= 20 then 1 + (m - 5) * (1 / 15.0::double) when m <= 45 then 2 + (m - 20) * (1 / 25.0::double) else 3 end as p from v)
        select p_partkey, {_r('pow(pow(v[1], p) + pow(v[2], p) + pow(v[3], p), 1 / p)', 3)} as combined from q""",
    "A35_mixture": f"with {_B} select l_linestatus, bin, {_r('sum(share * case when l_returnflag = ' + chr(39) + 'R' + chr(39) + ' then 0.5 else 0.25 end)', 6)} as share from s group by 1, 2",
    "A36_convolution": f"with {_B} select a.l_linestatus, a.bin + b.bin as bin, {_r('sum(a.share * b.share)', 6)} as share from s a join s b using (l_linestatus) where a.l_returnflag = 'A' and b.l_returnflag = 'R' group by 1, 2",
    "A37_exceeded": """with b as (select l_suppkey, l_quantity::int as bin, count(*) as n from lineitem group by 1, 2), c as (select *, sum(n) over (partition by l_suppkey order by bin desc) as c, sum(n) over (partition by l_suppkey) as t from b)
        select l_suppkey, """ + ", ".join(f"max(bin) filter (where c > t * {p}::double) as {k}" for k, p in (("l10", 0.1), ("l50", 0.5), ("l90", 0.9))) + " from c group by 1",
    "A39_quota": f"""with r as (select o_custkey, count(*) as n, sum(o_totalprice) as v from orders where o_orderdate > (select max(o_orderdate) from orders) - interval 90 days group by 1)
        select c_custkey, coalesce(n, 0) as orders, {_r('coalesce(v, 0)', 2)} as volume from customer left join r on c_custkey = o_custkey""",
    "A40_error_report": f"""with s as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as t from lineitem group by 1), e as (select o_orderpriority, {_r('(t - o_totalprice) / 1000', 3)} as e from orders join s on o_orderkey = l_orderkey),
        l as (select o_orderpriority, list_sort(list(abs(e))) as s, avg(e) as m from e group by 1) select o_orderpriority, s[ceil(len(s) * 0.95::double)::int] as p95, s[len(s)] as worst, {_r('m', 2)} as bias from l""",
    "A42_buckets": """select l_orderkey, l_linenumber, cast(floor((row_number() over (partition by l_orderkey order by l_linenumber) * 3 - 1) / count(*) over (partition by l_orderkey)) as int) as bucket from lineitem""",
    "A43_catchment": f"""with t as ({_GRID}), p as (select l_partkey % 64 as x, l_suppkey % 64 as y, count(*)::double as n from lineitem where l_linenumber = 1 group by 1, 2),
        r as (select t.x, t.y, any_value(t.trips) / (sum(p.n) * 100) as ratio from t join p on abs(t.x - p.x) <= 1 and abs(t.y - p.y) <= 1 group by 1, 2)
        select p.x, p.y, {_r('least(1, sum(r.ratio))')} as share from p join r on abs(r.x - p.x) <= 1 and abs(r.y - p.y) <= 1 group by 1, 2""",
    "A44_local_ratio": f"""with l as (select *, year(l_shipdate) as year, case when l_returnflag = 'R' then l_quantity else 0 end as r from lineitem), w as (select year, sum(r) / sum(l_quantity) as w from l group by 1)
        select l_suppkey, year, {_r('case when count(*) >= 30 then sum(r) / sum(l_quantity) else any_value(w) end')} as ratio from l join w using (year) group by 1, 2""",
    "A50_period_mean": "select l_suppkey, " + _r(" + ".join(f"avg(l_quantity) filter (where l_returnflag = '{f}') * {h} / 24.0::double" for f, h in (("A", 12), ("N", 4), ("R", 8)))) + " as mean from lineitem group by 1",
    "A51_feathered": f"select l_partkey, {_r('sum(l_discount * 10 * l_quantity) / greatest(sum(l_discount * 10), 1.0)')} as blend from lineitem group by 1",
    "S14_bilinear": f"""with g as (select l_partkey % 20 as gx, l_suppkey % 20 as gy, avg(l_quantity) as v from lineitem group by 1, 2), p as (select p_partkey, p_partkey % 181 / 10.0::double as x, p_size % 19 + 0.25::double as y from part),
        c as (select p.*, i, j, (case when i = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when j = 1 then y - floor(y) else 1 - (y - floor(y)) end) as w from p, range(2) a(i), range(2) b(j))
        select p_partkey, {_r('case when count(v) = count(*) then sum(w * v) end')} as value from c left join g on gx = floor(x) + i and gy = floor(y) + j where w > 0 group by p_partkey, x, y""",
    "J34_metadata": "select c_nationkey, count(*) as lines, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1",
    "J35_lookup": """select s_suppkey, coalesce(r_name, 'elsewhere') as region from supplier left join (select * from nation join region on n_regionkey = r_regionkey where n_nationkey % 4 <> 0) on s_nationkey = n_nationkey""",
    "J37_fallbacks": f"""with l as (select *, month(l_shipdate) as m from lineitem), a as (select l_partkey, min(l_extendedprice) as a from l where m = 1 group by 1),
        b as (select l_suppkey, m, min(l_extendedprice) as b from l where m < 4 group by 1, 2), c as (select l_suppkey, min(l_extendedprice) as c from l where m = 12 group by 1)
        select m, case when a is not null then 'part' when b is not null then 'month' when c is not null then 'supplier' else 'none' end as source, count(*) as lines, {_r('sum(coalesce(a, b, c))', 2)} as price
        from l left join a using (l_partkey) left join b using (l_suppkey, m) left join c using (l_suppkey) group by 1, 2""",
    "J40_drift": """with s as (select l_orderkey from lineitem where l_linenumber > 1 group by 1), o as (select o_orderkey from orders where o_orderkey % 5 <> 0)
        select case when o_orderkey is null then 'lines only' when l_orderkey is null then 'order only' else 'both' end as kind, count(*) as orders from o full join s on o_orderkey = l_orderkey group by 1""",
    "K4_resume": """select distinct cast(cast(o_orderdate as date) as varchar) as day from orders where cast(o_orderdate as date) not in (select cast(l_shipdate as date) from lineitem where l_quantity > 49)""",
    "K9_merge": "select p_partkey, p_retailprice from part",
    "K10_content": "select sha256(p_brand || '|' || p_type || '|' || p_size) as digest, min(p_partkey) as first, count(*) as copies from part group by 1",
    "S10_json": """with e as (select event_id, event_type, cast(props ->> 'k' as int) as k from events) select event_id, k, '{' || coalesce('"n":' || k || ',', '') || '"event_type":"' || event_type || '"}' as line from e""",
    "S19_partitions": """select country_iso, source_id, count(*) as n, count(case when not isnan(aadt) and aadt > 0 then 1 end) as counted from traffic where country_iso in ('CZ', 'DK') and road_group = 0 group by 1, 2""",
    "S28_overlay": """with o as (select l_orderkey % 6 as k, l_quantity + 1 as q from lineitem where l_orderkey % 3 = 0 union all select l_orderkey % 6, l_quantity from lineitem where l_orderkey % 2 = 0 and l_orderkey % 3 <> 0)
        select k, count(*) as n, sum(q) as q from o group by 1""",
    "T1_total_order": "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part",
    "T12_newest": """with l as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
        select o_custkey, o_orderkey from l order by o_orderdate desc, o_orderkey desc limit 500""",
    "U1_union": "select c_nationkey as nation, 'customer' as layer, count(*) as n from customer group by 1 union all select s_nationkey, 'supplier', count(*) from supplier group by 1",
    "U2_distinct": "select l_orderkey from lineitem where l_discount > 0.08 union select l_orderkey from lineitem where l_quantity > 45",
    "U3_subset": "select count(*) = 0 as subset from lineitem where l_orderkey not in (select o_orderkey from orders)",
    "U4_difference": "select c_custkey as k from customer except select o_custkey from orders",
    "U5_intersection": "select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R'",
    "U8_halo": f"""with g as ({_GRID}) select distinct (x + dx + 64) % 64 as x, y + dy as y from g, (select unnest([-1, 0, 1]) as dx), (select unnest([-1, 0, 1]) as dy) where trips > 40 and y + dy between 0 and 63""",
    "F_codes": f"""with s as (select p_partkey, case when p_size % 7 > 0 then p_size / 4.0::double - 1 end as s from part), c as (select p_partkey, cast(case when s is null then 255 when s <= 0 or floor(80 + 20 * log2(nullif(greatest(s, 0), 0)) + 0.5) < 0 then 254
        else least(floor(80 + 20 * log2(nullif(greatest(s, 0), 0)) + 0.5), 253) end as int) as code from s) select p_partkey, code, {_r('case when code = 254 then 0 when code < 254 then pow(2, (code - 80) / 20.0::double) end')} as sone from c""",
    "F_names": r"""select coalesce(nullif(trim(regexp_replace(lower(road_name), '\s+', ' ', 'g')), ''), nullif(lower(trim(road_ref)), ''), '#' || osm_id) as key, count(*) as pieces from display group by 1""",
    "F_digits": f"with s as (select o_orderkey, o_totalprice, pow(10.0::double, floor(log10(o_totalprice)) - 2) as s from orders) select o_orderkey, {_r('floor(o_totalprice / s + 0.5) * s')} as v from s",
    "D2_speed_cascade": f"""with d as (select *, lower(trim(road_class)) as class from display), a as (select country_iso, class, quantile_cont(speed_posted_kmh, 0.5) as a from d where speed_posted_kmh is not null group by 1, 2),
        b as (select class, quantile_cont(speed_posted_kmh, 0.5) as b from d where speed_posted_kmh is not null group by 1), s as (select piece_id, coalesce(speed_posted_kmh::double, a, b, 50.0) as s from d left join a using (country_iso, class) left join b using (class))
        select piece_id, {_r('s')} as speed, {_r('least(s, 80.0)')} as heavy from s""",
    "F_vehicle_rates": "select piece_id, " + ", ".join(f"{_r(f'aadt_{k} * case when coalesce(oneway, false) then 1.0::double else 0.5::double end * 0.7::double / 12')} as {k}" for k in ("light", "medium", "heavy", "moto")) + " from display",
    "F_piecewise": f"select p_partkey, {_r('greatest(least(case when p_size < 10 then p_size * 0.5::double when p_size < 30 then 5 + (p_size - 10) * 0.2::double else 9 end, 8.5), 1.0)')} as load from part",
    "P7_guessed": "select piece_id from display where source_id in (1, 2, 3) or (traffic_estimated & 5) > 0",
    "P8_implausible": "select piece_id from display where aadt_light + aadt_medium + aadt_heavy + aadt_moto > 20000 * coalesce(lanes::int, 1)",
    "P17_masked": f"{_COMB} select x, combined from k where combined <> 255 and (combined = 254 or combined <= 140)",
}
