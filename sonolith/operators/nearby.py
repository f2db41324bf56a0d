"""Points near other points: a sweep along the longitude within latitude strips.

`pairs_within` finds all pairs of a left and a right place at most `radius_m` apart on a sphere. Each left row is owned
by one block (a strip of latitude, cut into ranges of longitude), right rows are copied into every block that a left row
within the radius may lie in, so each pair comes out once. Blocks are range-partitioned and sorted by longitude, and
each task sweeps its rows once with an active set: what lies more than the strip's half-width behind is dropped.
Memory is bounded by the rows within one half-width, not by the block. The exact distance decides on each pair.

Skew: blocks are counted first, rows of both sides; where a side of a block holds more than `block_rows`, its rows are
dealt to several parts, and each part of the left meets each part of the right in a sweep of its own. The table of heavy
blocks has at most rows / block_rows entries; it is collected nowhere and broadcast only by Spark's own size threshold.

Defined cases: a null or non-finite position, a latitude beyond +-90 or a null id has no place and no pair; longitudes count
modulo 360; both poles work (a strip there is one block with the full circle as its half-width); repeated places give a
pair a row; empty inputs give no rows. Only the two ids and the distance come out, so clashing names of other columns
can't meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
CHUNK = 1_000_000


def _place(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    finite = ~F.isnan(la) & ~F.isnan(lo) & (F.abs(lo) < float("inf"))
    good = la.isNotNull() & lo.isNotNull() & finite & la.between(-90, 90)
    return df.where(good & F.col(key).isNotNull()).select(F.col(key).alias("id"), la.alias("lat"), F.pmod(lo, F.lit(360.0)).alias("lon"))


def _half_width(strip: Column, height: float, reach: float) -> Column:
    """Degrees of longitude that a place of the strip (or `reach` degrees beside it) can be away at most."""
    edge = F.least(
        F.lit(90.0), F.greatest(F.abs(strip * height), F.abs((strip + 1) * height)) + F.lit(reach)
    )
    ratio = F.lit(math.sin(math.radians(reach))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.when(ratio >= 0.5, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001 + 1e-9)


def _blocks(strip: Column, width: Column, per_block: float) -> Column:
    """Blocks of a strip: a block is at least per_block half-widths long."""
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (width * per_block)).cast("int"))


def _haversine(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon1 - lon2) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _matches(left: dict, right: dict, radius: float) -> Iterator[pa.RecordBatch]:
    """Pairs of two sorted sets whose swept coordinates lie within the left row's half-width, verified, in chunks."""
    if not len(left["g"]) or not len(right["g"]):
        return
    lo = np.searchsorted(right["g"], left["g"] - left["w"], "left")
    hi = np.searchsorted(right["g"], left["g"] + left["w"], "right")
    n = hi - lo
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        to = int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1
        if to <= at:  # one row with very many candidates: these in pieces
            spans, to = [(at, s, min(s + CHUNK, hi[at])) for s in range(lo[at], hi[at], CHUNK)], at + 1
        else:
            spans = [None]
        for span in spans:
            if span is None:
                k = n[at:to]
                i = np.repeat(np.arange(at, to), k)
                j = np.arange(k.sum()) - np.repeat(total[at:to] - total[at], k) + np.repeat(lo[at:to], k)
            else:
                i, j = np.full(span[2] - span[1], span[0]), np.arange(span[1], span[2])
            if not len(i):
                continue
            d = _haversine(left["lat"][i], left["lon"][i], right["lat"][j], right["lon"][j])
            ok = d <= radius
            if ok.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left["id"][i][ok]), pa.array(right["id"][j][ok]), pa.array(d[ok])],
                    names=["left_id", "right_id", "distance_m"],
                )
        at = to


def _sweep(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    columns = ("g", "w", "id", "lat", "lon")
    empty = {c: np.empty(0, dtype=np.int64 if c == "id" else float) for c in columns}
    active = {0: empty, 1: empty}
    offset, last = 0.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        strip, block, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("strip", "block", "salt"))
        key = np.stack([strip, block, salt])
        change = np.concatenate([[last is None or not (key[:, 0] == last).all()], (key[:, 1:] != key[:, :-1]).any(0)])
        last = key[:, -1]
        # Each block gets its own stretch of the swept axis, further from the next than any half-width.
        stretch = offset + 4000.0 * np.cumsum(change)
        offset = float(stretch[-1])
        row = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "id", "lat", "lon")}
        row["g"] = stretch + batch.column("x").to_numpy(zero_copy_only=False)
        side = batch.column("side").to_numpy(zero_copy_only=False)
        new = {s: {c: row[c][side == s] for c in columns} for s in (0, 1)}
        now = {s: {c: np.concatenate([active[s][c], new[s][c]]) for c in columns} for s in (0, 1)}
        yield from _matches(new[0], now[1], radius)  # the batch's left rows against all rights that are still active
        yield from _matches(active[0], new[1], radius)  # earlier left rows against the batch's rights
        end = row["g"][-1] - max(row["w"].max(), *(a["w"].max() if len(a["w"]) else 0 for a in active.values()))
        active = {s: {c: now[s][c][now[s]["g"] >= end] for c in columns} for s in (0, 1)}
        if offset > 1e9:  # keep the precision of the swept axis
            for s in (0, 1):
                active[s]["g"] = active[s]["g"] - offset
            offset = 0.0


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    radius_m: float,
    left_key: str,
    right_key: str,
    left_at: tuple[str, str] = ("lat", "lon"),
    right_at: tuple[str, str] = ("lat", "lon"),
    block_rows: int = 50_000,
    per_block: float = 8.0,
) -> DataFrame:
    """(left_id, right_id, distance_m) of all pairs at most radius_m apart; ids must be bigint. block_rows: rows of
    a side of one block that are swept together; per_block: half-widths in a block."""
    if not 0 < radius_m < 1_000_000:
        raise ValueError("radius_m must be above 0 and below 1,000 km")
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001 + 1e-9
    height = 4 * reach
    spark = left.sparkSession
    a, b = _place(left, left_key, *left_at), _place(right, right_key, *right_at)

    def strip_of(lat: Column) -> Column:
        return F.floor(lat / height).cast("int")

    own = (
        a.withColumn("strip", strip_of(F.col("lat")))
        .withColumn("w", _half_width(F.col("strip"), height, reach))
        .withColumn("blocks", _blocks(F.col("strip"), F.col("w"), per_block))
        .withColumn("block", F.least(F.floor(F.col("lon") * F.col("blocks") / 360.0).cast("int"), F.col("blocks") - 1))
        .withColumn("x", F.col("lon") - F.col("block") * 360.0 / F.col("blocks"))
    )
    strips = F.sequence(strip_of(F.col("lat") - reach), strip_of(F.col("lat") + reach))
    copies = (
        b.withColumn("strip", F.explode(strips))
        .withColumn("w", _half_width(F.col("strip"), height, reach))
        .withColumn("blocks", _blocks(F.col("strip"), F.col("w"), per_block))
    )
    size = F.lit(360.0) / F.col("blocks")
    ends = [F.floor((F.col("lon") + s * F.col("w")) / size).cast("int") for s in (-1, 1)]
    # With a few blocks a range may reach around the circle; then every block is named once, at the nearest copies.
    copies = (
        copies.withColumn("raw", F.explode(F.when(F.col("w") >= 360.0, F.array(F.lit(0))).otherwise(F.sequence(*ends))))
        .withColumn("block", F.pmod(F.col("raw"), F.col("blocks")).cast("int"))
        .withColumn("x", F.col("lon") - F.col("raw") * size)
    )
    # Blocks with many rows of either side: left rows are dealt to ls parts, right rows to rs, and each left part meets
    # each right part in a sweep of its own, so that a pair still has one owner.
    counted = own.select("strip", "block", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        copies.select("strip", "block", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    heavy = (
        counted.groupBy("strip", "block")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .where((F.col("l") > 0) & (F.col("r") > 0) & (F.greatest("l", "r") > block_rows))
        .select("strip", "block", *[F.ceil(F.col(c) / block_rows).cast("int").alias(f"{c}s") for c in ("l", "r")])
    )

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in its own part, once for each part of the other side."""
        rows = side.join(heavy, ["strip", "block"], "left")
        parts, others = F.coalesce(mine, F.lit(1)), F.coalesce(other, F.lit(1))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), parts).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        l, r = ("mine", "other") if mine == "ls" else ("other", "mine")
        return rows.withColumn("salt", F.col(l) * F.coalesce("rs", F.lit(1)) + F.col(r))

    salted, spread = dealt(own, "ls", "rs"), dealt(copies, "rs", "ls")
    columns = ["strip", "block", "salt", "x", "w", "id", "lat", "lon"]
    both = salted.select(*columns, F.lit(0).alias("side")).unionByName(
        spread.select(*columns, F.lit(1).alias("side"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartitionByRange(parts, "strip", "block", "salt").sortWithinPartitions(
        "strip", "block", "salt", "x", "side", "id"
    )
    return ordered.mapInArrow(
        lambda batches: _sweep(batches, radius_m), "left_id bigint, right_id bigint, distance_m double"
    )
