"""Joins on distance, interval and time order, as equi-joins on cells with an exact residual test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.geo import cell_of, cells_within, distance_m, has_place


def distance_join(
    left: DataFrame,
    right: DataFrame,
    radius_m: float,
    left_at: tuple[str, str] = ("lat", "lon"),
    right_at: tuple[str, str] = ("lat", "lon"),
    how: str = "inner",
    also: Column | None = None,
    out: str = "distance_m",
) -> DataFrame:
    """Rows of left and right at most radius_m apart (the exploded side is right: pass the smaller one there). how:
    inner, semi or anti; also: a further condition. Column names must differ; a row without a place has no partner."""
    height = max(radius_m, 1.0) / 111_000.0
    la, lo, ra, ro = F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1])
    a = left.withColumn("__cell", F.when(has_place(la, lo), cell_of(la, lo, height)))
    # The planner doesn't know how often rows are copied, so it must not choose to broadcast them.
    b = right.where(has_place(ra, ro)).withColumn("__near", F.explode(cells_within(ra, ro, height, radius_m))).hint("merge")
    on = (F.col("__cell") == F.col("__near")) & (distance_m(la, lo, ra, ro) <= radius_m)
    on = on if also is None else on & also
    if how != "inner":
        return a.join(b, on, f"left_{how}").drop("__cell")
    return a.join(b, on).withColumn(out, distance_m(la, lo, ra, ro)).drop("__cell", "__near")


def nearest_within(pairs: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The best partner of each key among joined pairs: an aggregate that merges map-side."""
    best = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*columns).alias("row")))
    return pairs.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.row.{c}").alias(c) for c in columns])


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: Column,
    start: Column,
    end: Column,
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Rows of left whose number `at` lies in [start, end] of a row of right with equal keys (named alike on both
    sides). width: length of a time bucket; right rows are copied to the buckets that they meet."""
    a = left.withColumn("__bucket", F.floor(at / width).cast("long"))
    spans = F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))
    b = right.where(start <= end).withColumn("__bucket", F.explode(spans))
    b = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    b = b.withColumnRenamed("__bucket", "__span")
    on = (F.col("__bucket") == F.col("__span")) & (at >= start) & (at <= end)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    out = a.join(b, on, f"left_{how}" if how in ("semi", "anti") else how)
    return out.drop("__bucket", "__span", *[f"__k_{k}" for k in keys])


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching closed intervals of a key as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    island = df.withColumn("__first", first).withColumn("__island", F.sum("__first").over(w))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def interpolate(probes: DataFrame, known: DataFrame, keys: list[str], t: str, value: str, out: str) -> DataFrame:
    """Value at each probe's time: linear between the neighbours in time, the nearest one beyond the ends; null where
    the key has no known value. One shuffle: both sides are ordered together and carried forward and back."""
    both = probes.withColumn("__v", F.lit(None).cast("double")).withColumn("__p", F.lit(True)).unionByName(
        known.select(*keys, t, F.col(value).cast("double").alias("__v"), F.lit(False).alias("__p")),
        allowMissingColumns=True,
    )
    w = Window.partitionBy(*keys).orderBy(t)
    mark = F.when(F.col("__v").isNotNull(), F.struct(F.col(t).alias("t"), F.col("__v").alias("v")))
    back = F.last(mark, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first(mark, ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumn("__a", back).withColumn("__b", ahead).where("__p")
    dt = F.col("__b.t").cast("double") - F.col("__a.t").cast("double")
    share = (F.col(t).cast("double") - F.col("__a.t").cast("double")) / F.nullif(dt, F.lit(0.0))
    between = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * F.coalesce(share, F.lit(0.0))
    return both.withColumn(out, F.coalesce(between, F.col("__a.v"), F.col("__b.v"))).drop("__v", "__p", "__a", "__b")


def crossing_join(rays: DataFrame, edges: DataFrame, ray: str, edge: str, cell: float) -> DataFrame:
    """(ray, edge, share): where a ray a -> b meets an edge c -> d (columns ax, ay, bx, by and cx, cy, dx, dy), as the
    share of the ray's way. Both are copied to the cells that their boxes meet, so that long ones should be cut before;
    a pair met in several cells is kept in the first one that both reach. Parallel lines don't cross."""

    def boxed(df: DataFrame, key: str, x0: str, y0: str, x1: str, y1: str, name: str) -> DataFrame:
        spans = [F.sequence(F.floor(F.least(a, b) / cell).cast("long"), F.floor(F.greatest(a, b) / cell).cast("long")) for a, b in ((x0, x1), (y0, y1))]
        low = [F.floor(F.least(a, b) / cell).cast("long").alias(f"{name}{c}") for c, a, b in (("x", x0, x1), ("y", y0, y1))]
        df = df.select(key, x0, y0, x1, y1, *low, F.explode(spans[0]).alias("__x"), spans[1].alias("__s"))
        return df.withColumn("__y", F.explode("__s")).drop("__s")

    left = boxed(rays, ray, "ax", "ay", "bx", "by", "__r")
    right = boxed(edges, edge, "cx", "cy", "dx", "dy", "__e").hint("merge")
    j = left.join(right, ["__x", "__y"])
    j = j.where((F.col("__x") == F.greatest("__rx", "__ex")) & (F.col("__y") == F.greatest("__ry", "__ey")))
    rx, ry = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ex, ey = F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    det = F.nullif(rx * ey - ry * ex, F.lit(0.0))
    qx, qy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    t, u = (qx * ey - qy * ex) / det, (qx * ry - qy * rx) / det
    return j.where(t.between(0, 1) & u.between(0, 1)).select(ray, edge, t.alias("share"))
