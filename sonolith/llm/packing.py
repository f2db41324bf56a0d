"""Filling fixed-capacity containers: minimum bin slack over the lengths of all items.

The packing depends on how many items of each length there are, and there are at most `capacity` lengths. So the items
are counted by length (map-side, one row a length comes to the driver), and `plan` packs the counts: the longest length
left is placed, and dynamic programming on a bitset over all lengths left, with their multiplicities, finds the fullest
feasible combination beside it. That pattern is used for as many containers as the counts allow and removed. A pattern
uses up at least one length but for a remainder smaller than its multiplicity, so there are a few thousand patterns at
most, for any number of items.

Each item then finds its container by its rank among the items of its length. Ranks are counted within shards and
shifted by the shard's offset, so that a length shared by a third of all items isn't ranked in one task.

Defined cases: an item longer than the capacity is split into full pieces and a rest; an item of no or unknown size takes
no room and is in no container (container_id null); ids may repeat (each row is an item); an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.session import materialize

#: Parts in which the items of a length are ranked. It belongs to the result: containers are numbered alike everywhere.
SHARDS = 256


def fullest(room: int, counts: dict[int, int]) -> Counter:
    """The combination of available lengths that fills `room` best: lengths and how often each is used."""
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            grown = (reach | reach << length * take) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """(number of containers, lengths in each) until no item is left."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fullest(capacity - longest, rest)
        pattern[longest] += 1
        times = min(left[n] // c for n, c in pattern.items())
        out.append((times, pattern))
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def _segments(patterns: list[tuple[int, Counter]], capacity: int):
    """For each length the stretches of ranks and the containers that they go to, as sorted arrays."""
    used, first, rows = Counter(), 0, []
    for times, pattern in patterns:
        for n, c in pattern.items():
            rows.append((n, used[n], c, first))
            used[n] += c * times
        first += times
    rows.sort()
    return [np.array(column, dtype=np.int64) for column in zip(*rows, strict=True)] if rows else None


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """(container_id, key, piece, first_unit, units) of every piece of every item."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    units = F.col(size).cast("long")
    last = F.floor((F.col("__size") - 1) / capacity).cast("long")
    pieces = (
        items.select(F.col(key), F.greatest(F.coalesce(units, F.lit(0)), F.lit(0)).alias("__size"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))))
        .withColumn("first_unit", F.col("piece") * capacity)
        .withColumn("units", F.least(F.col("__size") - F.col("first_unit"), F.lit(capacity).cast("long")))
        .drop("__size")
    )
    pieces = pieces.withColumn("__shard", F.pmod(F.xxhash64(key, "piece"), F.lit(SHARDS)).cast("int"))
    pieces = materialize(pieces, "pieces")
    sized = pieces.where(F.col("units") > 0)
    counts = {r["units"]: r["n"] for r in sized.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = _segments(plan(counts, capacity), capacity)
    per_shard = sized.groupBy("units", "__shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("units").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_shard.select(
        "units", "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__offset")
    )
    within = Window.partitionBy("units", "__shard").orderBy(key, "piece")
    ranked = (
        sized.withColumn("__rank", F.row_number().over(within))
        .join(offsets, ["units", "__shard"])
        .withColumn("__rank", F.col("__rank") + F.col("__offset") - 1)
        .select(key, "piece", "first_unit", "units", "__rank")
    )
    kind = dict(items.dtypes)[key]
    schema = f"container_id bigint, `{key}` {kind}, piece bigint, first_unit bigint, units bigint"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, start, each, first = segments
        scale = int(start.max()) + 1
        stretches = length * scale + start
        for batch in batches:
            n = batch.column("units").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            # Ranks beyond the last start of a length belong to its last stretch.
            k = np.searchsorted(stretches, n * scale + np.minimum(rank, scale - 1), "right") - 1
            at = pa.array(first[k] + (rank - start[k]) // each[k])
            rest = [batch.column(c) for c in (key, "piece", "first_unit", "units")]
            yield pa.RecordBatch.from_arrays([at, *rest], names=["container_id", key, "piece", "first_unit", "units"])

    empty = pieces.where(F.col("units") == 0).select(
        F.lit(None).cast("long").alias("container_id"), key, "piece", "first_unit", "units"
    )
    if segments is None:
        return empty
    return ranked.mapInArrow(assign, schema).unionByName(empty)
