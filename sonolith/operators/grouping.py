"""Aggregations that plain SQL names don't give: weighted and once-only counts, medians, shares, rest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.levels import energy, lden_energy, level
from sonolith.operators.selection import exact_ranks


def sum_levels(df: DataFrame, keys: list[str], level_db: str, out: str = "level_db") -> DataFrame:
    """The level of all sources together: energies add."""
    return df.groupBy(*keys).agg(level(F.sum(energy(F.col(level_db)))).alias(out))


def lden_by(df: DataFrame, keys: list[str], level_db: str, period: str, out: str = "lden_db") -> DataFrame:
    """Lden of rows that have a level and a period (0 day, 1 evening, 2 night)."""
    parts = [F.sum(F.when(F.col(period) == p, energy(F.col(level_db))).otherwise(0.0)) for p in range(3)]
    return df.groupBy(*keys).agg(level(lden_energy(*parts)).alias(out))


def count_once(df: DataFrame, keys: list[str], thing: str, secondary: Column, first: Column, second: Column) -> DataFrame:
    """Weighted distinct count: each thing counts once a key, with the weight `first` if any of its rows is of the
    first kind, else with `second`. Two aggregates, both merged map-side."""
    per = df.groupBy(*keys, thing).agg(
        F.max(F.when(~secondary, first)).alias("__a"), F.max(F.when(secondary, second)).alias("__b")
    )
    return per.groupBy(*keys).agg(F.sum(F.coalesce("__a", "__b")).alias("weighted"), F.count(F.lit(1)).alias("things"))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest sum of weights; the smaller value on a tie."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    best = F.min_by(value, F.struct(-F.col("__w"), F.col(value)))
    return sums.groupBy(*keys).agg(best.alias(value), F.max("__w").alias("weight"))


def upper_median(value: str) -> Column:
    """The upper one of two middle values. Counts of distinct values are merged map-side; no list is gathered."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")


def median_of_medians(df: DataFrame, keys: list[str], member: str, value: str, least: int = 2) -> DataFrame:
    """Upper median of each member, then of the members; only keys with enough of them. Exact for any number of rows or
    members a key."""
    upper = {"median": lambda n: F.floor(n / 2) + 1}
    inner = exact_ranks(df, [*keys, member], value, upper)
    outer = exact_ranks(inner, keys, "median", upper).withColumnRenamed("values", "members")
    return outer.where(F.col("members") >= least).select(*keys, "median", "members")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """The first row, by value, at which the running weight reaches half of the whole."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    running = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    reached = df.withColumn("__r", running).where(F.col(value).isNotNull()).withColumn("__t", total)
    hit = reached.where(F.col("__r") >= F.col("__t") / 2)
    return hit.groupBy(*keys).agg(F.min(F.struct(value, tie)).alias("m")).select(*keys, F.col(f"m.{value}").alias("median"))


def shares(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    """Each row's share of its group's sum; null where the sum is zero."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(value), total))


def whole_percents(df: DataFrame, keys: list[str], share: str, tie: str, out: str = "percent") -> DataFrame:
    """Shares as whole percents that add up to 100: the largest remainders are rounded up."""
    base = df.withColumn("__f", F.floor(F.col(share) * 100)).withColumn("__rest", F.col(share) * 100 - F.col("__f"))
    group = Window.partitionBy(*keys)
    left = (F.lit(100) - F.sum("__f").over(group)).cast("int")
    place = F.row_number().over(group.orderBy(F.desc("__rest"), tie))
    out_column = (F.col("__f") + F.when(F.col("__place") <= F.col("__left"), 1).otherwise(0)).cast("int")
    ranked = base.withColumn("__left", left).withColumn("__place", place)
    return ranked.withColumn(out, out_column).drop("__f", "__rest", "__left", "__place")


def top_with_rest(df: DataFrame, keys: list[str], name: str, value: str, n: int) -> DataFrame:
    """The n largest of each group by name and one row for all others, with their number."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), name))
    named = df.withColumn("__name", F.when(place <= n, F.col(name).cast("string")).otherwise(F.lit("rest")))
    return named.groupBy(*keys, F.col("__name").alias("row")).agg(
        F.sum(value).alias(value), F.count(F.lit(1)).alias("members")
    )


def nearest_rank(p: float):
    """The rank of the ceil(p n)-th smallest value, for `exact_ranks`."""
    return lambda n: F.ceil(n * p)


def equal_count_buckets(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "bucket") -> DataFrame:
    """Rows of each group in k buckets cut at n i / k, the smaller ones first (ntile has the larger ones first)."""
    group = Window.partitionBy(*keys)
    rn, n = F.row_number().over(group.orderBy(*order)), F.count(F.lit(1)).over(group)
    return df.withColumn(out, F.floor((rn * k - 1) / n).cast("int"))


def keep_once(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") == 1).drop("__rn")


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and all rows of new: keys of several rows are replaced as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
