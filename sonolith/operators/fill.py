"""Filling missing values from similar records: statistics of nested groups, the finest one with enough support first.

`fill_from_groups` keeps every row and every column, and adds

* ``<out>``          the known value, or the filled one (null only where no row of the table knows the field),
* ``<out>_filled``   true where the value was missing,
* ``<out>_level``    for a missing value the name of the level that gave it, or ``none``; null for known values,
* ``<out>_support``  the number of known rows behind a filled value, else 0.

Numeric fields (a double, or several that are filled together) are filled by the median, categories by the mode.
Medians run over values on a grid of `per_unit` steps a unit, so that the state of a group is bounded by the number of
grid steps however many rows the group has; it is merged map-side, and a group that holds a third of all rows needs no
larger task. Two middle values are averaged; a mode's tie goes to the smaller category.

Known rows aren't shuffled for the fill: they are read once for the statistics, which are written to the shared folder
(one row a group and level), and pass through. Levels whose keys are part of a finer level's are summed from its merged
cells, not from the rows. The distinct combinations of keys among the rows with gaps are resolved
against the statistics of all levels (a level whose finished value is null is passed over), and the rows with gaps are joined with that small result once (AQE splits a hot
key there).

Defined cases: null in a key column means that the row belongs to no group of the levels with that key (neither gives
nor takes); an empty table gives an empty table; repeated rows count as often as they occur; extra columns pass
through, and one named like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.session import materialize


#: Bytes of a level's statistics, counted, up to which they are broadcast; more are joined by a shuffle. The size of the
#: written file doesn't tell, as it is compressed.
BROADCAST_BYTES = 2_000_000


@dataclass(frozen=True)
class Level:
    """A grouping of the back-off. keys: columns of the input; support: least number of known rows."""

    name: str
    keys: tuple[str, ...]
    support: int = 1


def _roots(levels: Sequence[Level]) -> list[int]:
    """For each level the level that its counts are summed from: itself, or an earlier one that has all of its keys."""
    out: list[int] = []
    for i, level in enumerate(levels):
        finer = [j for j in range(i) if out[j] == j and set(level.keys) <= set(levels[j].keys)]
        out.append(finer[-1] if finer else i)
    return out


def _statistics(known: DataFrame, levels: Sequence[Level], keys: Sequence[str], names: Sequence[str], kind: str):
    """One row a level and group with enough support: the medians or the mode of each component. All levels are counted
    in one pass: rows become (level, keys, component, value) cells that merge map-side before they move, for the levels
    that aren't part of a finer one; the others are summed from the merged cells of the finer one, null keys included."""
    roots = _roots(levels)

    def keyed(i: int, column) -> list[Column]:
        return [(column(k) if k in levels[i].keys else F.lit(None).cast(known.schema[k].dataType)).alias(k) for k in keys]

    def whole(i: int, column) -> Column:
        return reduce(lambda a, b: a & b, [column(k).isNotNull() for k in levels[i].keys], F.lit(True))

    cells = []
    for i in sorted(set(roots)):
        alone = roots.count(i) == 1  # no coarser level needs its rows of null keys
        for j, n in enumerate(names):
            cell = F.struct(F.lit(i).alias("__level"), *keyed(i, F.col), F.lit(j).alias("__part"), F.col(f"__v_{n}").alias("__v"))
            cells.append(F.when(whole(i, F.col), cell) if alone else cell)
    merged = (
        known.select(F.explode(F.array(*cells)).alias("c"))
        .where(F.col("c").isNotNull())
        .groupBy(*[F.col(f"c.{c}").alias(c) for c in ("__level", *keys, "__part", "__v")])
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    coarser = F.array(*[
        F.when((F.col("__level") == roots[i]) & whole(i, F.col), F.struct(F.lit(i).alias("__level"), *keyed(i, F.col)))
        for i in range(len(levels))
    ])
    counts = merged.select(F.explode(F.array_compact(coarser)).alias("c"), "__part", "__v", "__n")
    counts = counts.select(*[F.col(f"c.{c}").alias(c) for c in ("__level", *keys)], "__part", "__v", "__n")
    if kind == "mode":  # a median takes the counts of a value as they come, a mode needs their sum
        counts = counts.groupBy("__level", *keys, "__part", "__v").agg(F.sum("__n").alias("__n"))
    mine = [F.col("__part") == j for j in range(len(names))]
    if kind == "median":
        best = [F.percentile(F.when(m, F.col("__v")), F.lit(0.5), F.col("__n")) for m in mine]
    else:
        best = [F.min_by("__v", F.when(m, F.struct(-F.col("__n"), F.col("__v")))) for m in mine]
    enough = reduce(lambda a, b: a.when(F.col("__level") == b[0], b[1].support), enumerate(levels), F)
    return (
        counts.groupBy("__level", *keys)
        .agg(F.sum(F.when(mine[0], F.col("__n"))).alias("__support"), *[b.alias(n) for b, n in zip(best, names)])
        .where(F.col("__support") >= enough)
    )


def fill_from_groups(
    df: DataFrame,
    parts: dict[str, Column],
    known: Column,
    levels: Sequence[Level],
    kind: str = "median",
    per_unit: int = 1,
    out: str = "value",
    finish=None,
) -> DataFrame:
    """parts: the value's components by name, as columns that hold good where `known` is true (one for a plain number
    or a category). finish: builds the result column from the columns of the components, as given."""
    added = [out, f"{out}_filled", f"{out}_level", f"{out}_support"]
    df = df.drop(*added)
    names = list(parts)
    finish = finish or (lambda c: c[names[0]])
    numeric = kind == "median"
    is_known = F.coalesce(known, F.lit(False))
    keys = list(dict.fromkeys(k for level in levels for k in level.keys))
    grid = {n: F.floor(c * F.lit(float(per_unit)) + F.lit(0.5)).cast("int") if numeric else c for n, c in parts.items()}
    known_rows = df.where(is_known).select(*keys, *[grid[n].alias(f"__v_{n}") for n in names])
    statistics = materialize(_statistics(known_rows, levels, keys, names, kind), "fill")
    bytes_of = reduce(lambda a, k: a + F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)), keys, F.lit(64 + 16 * len(keys) + 24 * len(names)))
    sizes = {r["__level"]: r["b"] for r in statistics.groupBy("__level").agg(F.sum(bytes_of).alias("b")).collect()}  # a row a level

    def components(packed: str) -> dict[str, Column]:
        return {n: F.col(f"{packed}.{n}") / F.lit(float(per_unit)) if numeric else F.col(f"{packed}.{n}") for n in names}

    gaps = df.where(~is_known)
    resolved = gaps.select(*keys).distinct()
    found = []
    for i, level in enumerate(levels):
        packed = F.struct(F.lit(level.name).alias("level"), F.col("__support").alias("support"), *names)
        s = statistics.where(F.col("__level") == i).select(
            *[F.col(k).alias(f"__k{i}_{k}") for k in level.keys], packed.alias(f"__l{i}")
        )
        found.append(F.when(finish(components(f"__l{i}")).isNotNull(), F.col(f"__l{i}")))
        if level.keys:
            s = s.hint("broadcast" if sizes.get(i, 0) <= BROADCAST_BYTES else "merge")
            on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}_{k}") for k in level.keys])
            resolved = resolved.join(s, on, "left").drop(*[f"__k{i}_{k}" for k in level.keys])
        else:  # one row at most, whatever the input
            resolved = resolved.withColumn(f"__l{i}", s.scalar())
    resolved = resolved.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.coalesce(*found).alias("__fill"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    filled = gaps.join(resolved, on, "left").select(
        *df.columns,
        F.when(F.col("__fill").isNotNull(), finish(components("__fill"))).alias(out),
        F.lit(True).alias(f"{out}_filled"),
        F.coalesce(F.col("__fill.level"), F.lit("none")).alias(f"{out}_level"),
        F.coalesce(F.col("__fill.support"), F.lit(0)).alias(f"{out}_support"),
    )
    kept = df.where(is_known).select(
        *df.columns,
        finish(dict(parts)).alias(out),
        F.lit(False).alias(f"{out}_filled"),
        F.lit(None).cast("string").alias(f"{out}_level"),
        F.lit(0).cast("long").alias(f"{out}_support"),
    )
    return kept.unionByName(filled)


def filled_rows(df: DataFrame, out: str = "value") -> DataFrame:
    """The rows of a filled table whose value was missing; those that nothing could fill are kept as well."""
    return df.where(F.col(f"{out}_filled") & (F.col(out).isNotNull() | (F.col(f"{out}_level") == "none")))


def heldout(df: DataFrame, row_id: str, value: str, known: Column, fill, part: float = 0.1) -> DataFrame:
    """df with known and filled values side by side: (row_id, known value, and what `fill` gives when the known values of
    a hash-drawn part of the rows are taken away). For measuring the accuracy of a fill, not for filling."""
    drawn = F.coalesce(known, F.lit(False)) & (F.pmod(F.xxhash64(row_id), F.lit(1000)) < int(part * 1000))
    masked = df.withColumn(value, F.when(~drawn, F.col(value)))
    kept = df.where(drawn).select(row_id, F.col(value).alias("__true"))
    return fill(masked).join(kept, row_id)
