"""Rasters as long tables and level distributions as bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(df: DataFrame, x: str, y: str, keys: list[str], mean: str, weight: str) -> DataFrame:
    """One level up a pyramid: four cells become one, the mean over what was assessed (weight above 0) only."""
    known = df.where(F.col(mean).isNotNull() & (F.col(weight) > 0))
    return known.groupBy(*keys, F.shiftright(x, 1).alias(x), F.shiftright(y, 1).alias(y)).agg(
        (F.sum(F.col(mean) * F.col(weight)) / F.sum(weight)).alias(mean), F.sum(weight).alias(weight)
    )


def pyramid(df: DataFrame, x: str, y: str, keys: list[str], mean: str, weight: str, levels: int) -> DataFrame:
    """All levels above the given one, each computed from the one below (means stay unrounded in between)."""
    out, now = None, df.select(*keys, x, y, mean, weight)
    for up in range(1, levels + 1):
        now = fold(now, x, y, keys, mean, weight)
        row = now.withColumn("up", F.lit(up))
        out = row if out is None else out.unionByName(row)
    return out


def box_sums(df: DataFrame, x: str, y: str, value: str, reach: int, out: str = "box") -> DataFrame:
    """Sum of the values in the square of +-reach cells around each cell that has a value. The grid is summed along
    rows, then along columns: two windows over a range of cells instead of a self-join on all offsets. Empty cells in a
    row don't matter; between columns each cell is copied to the rows that it reaches."""
    cells = df.groupBy(x, y).agg(F.sum(value).alias("__v"))
    spread = cells.withColumn("__to", F.explode(F.sequence(F.col(x) - reach, F.col(x) + reach)))
    across = spread.groupBy(F.col("__to").alias(x), y).agg(F.sum("__v").alias("__h"), F.max(F.when(F.col("__to") == F.col(x), 1)).alias("__own"))
    w = Window.partitionBy(x).orderBy(y).rangeBetween(-reach, reach)
    return across.withColumn(out, F.sum("__h").over(w)).where(F.col("__own") == 1).select(x, y, out)


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, gx: str, gy: str, value: str, out: str) -> DataFrame:
    """Value of a grid between its four nodes around each point; null where a node that counts is missing."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    p = points.withColumn("__c", F.explode(corners))
    p = p.withColumn("__gx", F.floor(x).cast("long") + F.col("__c.i")).withColumn("__gy", F.floor(y).cast("long") + F.col("__c.j"))
    wx = F.when(F.col("__c.i") == 1, fx).otherwise(1 - fx)
    wy = F.when(F.col("__c.j") == 1, fy).otherwise(1 - fy)
    p = p.withColumn("__w", wx * wy)
    g = grid.select(F.col(gx).cast("long").alias("__gx"), F.col(gy).cast("long").alias("__gy"), F.col(value).alias("__v"))
    joined = p.where(F.col("__w") > 0).join(g, ["__gx", "__gy"], "left")
    return joined.groupBy(*points.columns).agg(
        F.when(F.count("__v") == F.count(F.lit(1)), F.sum(F.col("__w") * F.col("__v"))).alias(out)
    )


def mixture(df: DataFrame, keys: list[str], bin_column: str, share: str, weight: str) -> DataFrame:
    """Weighted mixture of distributions given by bins."""
    return df.groupBy(*keys, bin_column).agg(F.sum(F.col(share) * F.col(weight)).alias(share))


def exceeded(df: DataFrame, keys: list[str], bin_column: str, share: str, fractions: dict[str, float]) -> DataFrame:
    """The bin exceeded for a fraction of the time: from loud to quiet, the first at which the share passes it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(bin_column)).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum(share).over(Window.partitionBy(*keys))
    rows = df.withColumn("__c", F.sum(share).over(w)).withColumn("__t", whole)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__c") > F.col("__t") * p, F.col(bin_column))).alias(n) for n, p in fractions.items()]
    )


def convolve(a: DataFrame, b: DataFrame, keys: list[str], bin_column: str, share: str, added: Column) -> DataFrame:
    """Distribution of two independent levels together. added: the bin of both, from columns a_<bin> and b_<bin>. The
    join is by key; a distribution has a bounded number of bins, so a key gives at most bins x bins rows."""
    left = a.select(*keys, F.col(bin_column).alias(f"a_{bin_column}"), F.col(share).alias("__a"))
    right = b.select(*keys, F.col(bin_column).alias(f"b_{bin_column}"), F.col(share).alias("__b"))
    return (
        left.join(right, keys)
        .groupBy(*keys, added.alias(bin_column))
        .agg(F.sum(F.col("__a") * F.col("__b")).alias(share))
    )


def combine_codes(df: DataFrame, keys: list[str], code: str, unknown: int = 255, silent: int = 254) -> DataFrame:
    """Energy sum of the layers' level codes (half decibels): one layer not assessed makes the cell so, all silent
    keeps silence."""
    e = F.when(F.col(code) < silent, F.pow(F.lit(10.0), F.col(code) / 20.0)).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.when(F.max(code) == unknown, unknown)
        .when(F.sum(e) < 1, silent)
        .otherwise(F.least(F.floor(20 * F.log10(F.nullif(F.sum(e), F.lit(0.0))) + 0.5), F.lit(silent - 1)))
        .cast("int")
        .alias("combined")
    )


def stencil(df: DataFrame, x: str, y: str, value: str, weights: Sequence[float], out: str = "mean") -> DataFrame:
    """Weighted mean over the square of cells around each cell, the weights being those of a row times those of a column
    (an odd number of them); null where any cell of the square has no value. Cells are copied along one axis and summed,
    then along the other: two aggregates that merge map-side, whatever the shape of the grid."""
    reach, whole = len(weights) // 2, float(sum(weights)) ** 2
    steps = F.array(*[F.struct(F.lit(i - reach).alias("by"), F.lit(w).alias("w")) for i, w in enumerate(weights)])

    def along(cells: DataFrame, axis: str) -> DataFrame:
        moved = cells.withColumn("__s", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("__s.by"))
        return moved.groupBy(x, y).agg(
            F.sum(F.col("__v") * F.col("__s.w")).alias("__v"), F.sum("__n").alias("__n"),
            F.max(F.when(F.col("__s.by") == 0, F.col("__own"))).alias("__own"),
        )

    cells = df.where(F.col(value).isNotNull()).select(x, y, F.col(value).alias("__v"), F.lit(1).alias("__n"), F.lit(True).alias("__own"))
    both = along(along(cells, y), x)
    full = F.when(F.col("__n") == len(weights) ** 2, F.col("__v") / whole)
    return both.where(F.coalesce("__own", F.lit(False))).select(x, y, full.alias(out))


def distance_to_missing(df: DataFrame, x: str, y: str, valid: Column, reach: int, out: str = "distance") -> DataFrame:
    """Steps from each cell to the nearest missing one or out of the grid (1 along an axis, root 2 across), at most
    reach + 1: what a two-pass chamfer transform gives, by copying each missing cell to the cells within reach."""
    far = float(reach + 1)
    steps = [(i, j, max(abs(i), abs(j)) - min(abs(i), abs(j)) + min(abs(i), abs(j)) * 2**0.5) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(d).alias("d")) for i, j, d in steps if d < far])
    missing = df.where(~F.coalesce(valid, F.lit(False))).select(x, y, F.explode(near).alias("s"))
    found = missing.groupBy((F.col(x) + F.col("s.i")).alias(x), (F.col(y) + F.col("s.j")).alias(y)).agg(F.min("s.d").alias("__d"))
    edge = df.agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    ends = {c: edge.select(c).scalar() for c in ("__x0", "__x1", "__y0", "__y1")}
    border = F.least(F.col(x) - ends["__x0"], ends["__x1"] - F.col(x), F.col(y) - ends["__y0"], ends["__y1"] - F.col(y)) + 1.0
    return df.select(x, y).join(found, [x, y], "left").select(x, y, F.least(F.coalesce("__d", F.lit(far)), border, F.lit(far)).alias(out))
