"""Choosing rows: best k, prefixes under a bound, sampling in proportion to a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.session import materialize


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition before the shuffle (window group limit)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)


def until_omitted(df: DataFrame, keys: list[str], bound: str, tie: str, share: float) -> DataFrame:
    """The fewest rows of largest bound so that the bounds left out are at most `share` of those taken."""
    w = Window.partitionBy(*keys).orderBy(F.desc(bound), tie)
    taken_before = F.coalesce(F.sum(bound).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum(bound).over(Window.partitionBy(*keys))
    needed = (F.col("__whole") - F.col("__before")) > share * F.col("__before")
    rows = df.withColumn("__before", taken_before).withColumn("__whole", whole)
    return rows.where(needed).drop("__before", "__whole")


def best_then_prefix(
    df: DataFrame, keys: list[str], direction: str, value: str, tie: str, residual: float
) -> DataFrame:
    """The best row of each direction, then of these the largest until the others hold at most `residual` of all."""
    best = top_k(df, [*keys, direction], [F.desc(value), F.col(tie)], 1).drop("rank")
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum(value).over(Window.partitionBy(*keys))
    rows = best.withColumn("__b", before).withColumn("__w", whole)
    return rows.where(F.col("__w") - F.col("__b") > residual * F.col("__w")).drop("__b", "__w")


def uniform(*columns: str | Column) -> Column:
    """A number in [0, 1) that depends on the columns alone: a replay draws the same sample."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)


def certain_rows(df: DataFrame, keys: list[str], bound: str, tie: str, size: int) -> DataFrame:
    """Marks the rows so large that a sample of `size` draws in proportion to the bound would hold them for certain."""
    w = Window.partitionBy(*keys).orderBy(F.desc(bound), tie)
    remaining = F.sum(bound).over(w.rowsBetween(0, Window.unboundedFollowing))
    certain = F.col(bound) * size >= remaining
    # Once a row isn't certain, no smaller one is.
    return df.withColumn("__c", certain).withColumn("certain", F.min("__c").over(w)).drop("__c")


def proportional_estimate(df: DataFrame, keys: list[str], bound: str, value: str, tie: str, size: int) -> DataFrame:
    """Hansen-Hurwitz estimate of each group's sum of `value`, with its variance: certain rows count as they are, `size`
    independent draws with replacement in proportion to the bound stand for the others. A draw is a number in the whole
    of the running bound, hashed from the group and its own number; it finds its row by an equi-join on the group and a
    stretch of it (each row is copied to the stretches that it meets) with an exact range test."""
    marked = certain_rows(df, keys, bound, tie, size)
    sure = marked.where("certain").groupBy(*keys).agg(F.sum(value).alias("__sure"))
    w = Window.partitionBy(*keys).orderBy(F.desc(bound), tie)
    rest = marked.where(~F.col("certain")).withColumn("__to", F.sum(bound).over(w)).withColumn(
        "__total", F.sum(bound).over(Window.partitionBy(*keys))
    )
    lo = (F.col("__to") - F.col(bound)) / F.col("__total")
    hi = F.when(F.col("__to") >= F.col("__total"), F.lit(1.0)).otherwise(F.col("__to") / F.col("__total"))
    rest = rest.withColumn("__lo", lo).withColumn("__hi", hi)
    spans = F.sequence(F.floor(F.col("__lo") * size).cast("long"), F.least(F.floor(F.col("__hi") * size), F.lit(size - 1)).cast("long"))
    rest = rest.withColumn("__s", F.explode(spans))
    groups = rest.select(*keys).distinct().withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    draws = groups.withColumn("__u", uniform(*keys, "__i")).withColumn("__s", F.floor(F.col("__u") * size).cast("long"))
    drawn = draws.join(rest, [*keys, "__s"]).where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    x = F.col(value) * F.col("__total") / F.col(bound)
    sampled = drawn.groupBy(*keys).agg(F.avg(x).alias("__mean"), (F.var_samp(x) / F.count(F.lit(1))).alias("__var"))
    every = df.select(*keys).distinct()
    out = every.join(sure, keys, "left").join(sampled, keys, "left")
    zero = F.lit(0.0)
    return out.select(
        *keys,
        (F.coalesce("__sure", zero) + F.coalesce("__mean", zero)).alias("estimate"),
        F.coalesce("__var", zero).alias("variance"),
    )


def estimate_until(
    df: DataFrame, keys: list[str], bound: str, value: str, tie: str, tolerance: float, first: int = 512, last: int = 32_768
) -> DataFrame:
    """The estimate of each group with the smallest sample, doubled from `first` to `last`, whose two standard errors are
    at most `tolerance` of it; and that size. A group that none suffices keeps the largest sample."""
    left, size, out = materialize(df, "rows"), first, None
    while True:
        now = materialize(proportional_estimate(left, keys, bound, value, tie, size).withColumn("size", F.lit(size)), "estimates")
        good = 2 * F.sqrt("variance") <= tolerance * F.abs("estimate")
        done = now if size >= last else now.where(good)
        out = done if out is None else out.unionByName(done)
        if size >= last or now.where(~good).isEmpty():
            return out
        left = materialize(left.join(now.where(~good).select(*keys), keys, "left_semi"), "rows")
        size *= 2


def running_total(df: DataFrame, order: list[str], weight: str, out: str = "before") -> DataFrame:
    """The weights of all rows before each one in a total order of columns: rows are range-partitioned and sorted, each
    partition is summed where it lies, and the partitions' totals (a row a partition) shift the sums. No partition holds
    a whole group, however few groups there are."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(w) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), part, np.int32)), pa.array(sums - w)], names=schema.names)

    summed = materialize(ordered.mapInArrow(run, schema), "ordered")
    ends = sorted(tuple(r) for r in summed.groupBy("__part").agg(F.max(F.col(out) + F.col(weight))).collect())
    shift, rows = 0, []
    for part, total in ends:
        rows.append((part, shift))
        shift += total
    shifts = spark.createDataFrame(rows, "__part int, __shift long")
    return summed.join(F.broadcast(shifts), "__part").withColumn(out, F.col(out) + F.col("__shift")).drop("__part", "__shift")


def exact_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values of given ranks (1-based, from the number of a key's values) by key, exactly, for any number of values a key:
    values are counted first, then ordered as a whole. Unknown values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    summed = running_total(counts, [*keys, "__v"], "__n", "__before")
    whole = summed.groupBy(*keys).agg(F.min("__before").alias("__start"), F.sum("__n").alias("__whole"))
    at = F.col("__before") - F.col("__start")
    hits = [(at < r(F.col("__whole"))) & (r(F.col("__whole")) <= at + F.col("__n")) for r in ranks.values()]
    met = summed.join(whole, keys)
    return met.groupBy(*keys).agg(
        F.first("__whole").alias("values"), *[F.max(F.when(h, F.col("__v"))).alias(n) for n, h in zip(ranks, hits, strict=True)]
    )
