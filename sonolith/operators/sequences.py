"""Ordered sequences of a key: runs, sessions by a resting state, hysteresis, filters, moving statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.operators.grouping import upper_median


def _order(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: list[str], order: list[str], state: Column, out: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal state within each key, from 1."""
    w = _order(keys, order)
    rows = df.withColumn("__state", state)
    changed = F.when(F.col("__state").eqNullSafe(F.lag("__state").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__new", changed).withColumn(out, F.sum("__new").over(w)).drop("__new", "__state")


def break_chains(df: DataFrame, keys: list[str], order: list[str], breaks: Column, out: str = "chain") -> DataFrame:
    """Numbers stretches of a sequence: a new one starts where `breaks` holds (use lag within it), from 1."""
    w = _order(keys, order)
    first = F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)
    return df.withColumn("__first", first).withColumn(out, F.sum("__first").over(w)).drop("__first")


def rotations(
    df: DataFrame, keys: list[str], t: str, resting: str, slow: Column, rest_s: float, out: str = "rotation"
) -> DataFrame:
    """Sessions that end in a rest: a run of resting rows that follows a moving row, lasts at least rest_s and is
    followed by a moving row closes a session. The next session begins inside the run, at its last slow row (its first
    row where none is slow), so that the rows of the run from there on belong to both. Gaps between rows never split;
    a session of one row is dropped. Each row comes out once for every session that it is in."""
    w = _order(keys, [t])
    marked = runs(df, keys, [t], F.col(resting), "__run")
    by_run = Window.partitionBy(*keys, "__run")
    moved = F.max(F.when(~F.col(resting), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__moved", moved).withColumn("__i", F.row_number().over(w))
    last_run = F.max("__run").over(Window.partitionBy(*keys))
    closes = (
        F.col(resting)
        & (F.min("__moved").over(by_run) == 1)
        & (F.max(t).over(by_run).cast("double") - F.min(t).over(by_run).cast("double") >= rest_s)
        & (F.col("__run") < last_run)
    )
    begin = F.coalesce(F.max(F.when(slow, F.col("__i"))).over(by_run), F.min("__i").over(by_run))
    marked = marked.withColumn("__closes", closes).withColumn("__begin", F.when(F.col("__closes"), begin))
    closed = F.when(F.col("__closes") & (F.col("__i") == F.max("__i").over(by_run)), 1).otherwise(0)
    marked = marked.withColumn("__end", closed)
    before = F.coalesce(F.sum("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("__own", (before + 1).cast("int"))
    own = F.col("__own")
    # Rows of a closing run from its begin on are in the session that it closes and in the next one.
    both = F.when(F.col("__closes") & (F.col("__i") >= F.col("__begin")), F.array(own, own + 1)).otherwise(F.array(own))
    exploded = marked.withColumn(out, F.explode(both))
    members = F.count(F.lit(1)).over(Window.partitionBy(*keys, out))
    kept = exploded.withColumn("__n", members).where(F.col("__n") >= 2)
    return kept.drop("__run", "__moved", "__i", "__closes", "__begin", "__end", "__own", "__n")


def hysteresis(
    df: DataFrame, keys: list[str], order: list[str], enter: Column, leave: Column, out: str = "high"
) -> DataFrame:
    """A state that turns on where `enter` holds and off where `leave` holds, and else stays as it was (off at first)."""
    event = F.when(enter, True).when(leave, False)
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))


def cut_tail(df: DataFrame, keys: list[str], order: list[str], bad: Column) -> DataFrame:
    """The rows of each sequence before its first bad one."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.coalesce(bad, F.lit(False)), 1).otherwise(0)).over(w)
    return df.withColumn("__bad", seen).where(F.col("__bad") == 0).drop("__bad")


def sustained(df: DataFrame, keys: list[str], order: list[str], holds: Column, least: int, out: str) -> DataFrame:
    """Marks rows in runs of at least `least` rows in which `holds` is true."""
    state = F.coalesce(holds, F.lit(False))
    numbered = runs(df.withColumn("__holds", state), keys, order, F.col("__holds"), "__run")
    long = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run")) >= least
    return numbered.withColumn(out, F.col("__holds") & long).drop("__holds", "__run")


def moving_upper_median(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, out: str) -> DataFrame:
    """Upper median of the rows i-rows .. i+rows of the key, unknown values left out."""
    w = _order(keys, order).rowsBetween(-rows, rows)
    ordered = F.array_sort(F.collect_list(value).over(w))
    return df.withColumn(out, F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))


def secant_rate(
    df: DataFrame, keys: list[str], seconds: str, value: str, reach_s: int, least_s: int, out: str
) -> DataFrame:
    """Change a second between the first and last known value within +-reach_s, where they span at least least_s."""
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-reach_s, reach_s)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(seconds).alias("t"), F.col(value).alias("v")))
    a, b = F.first(known, ignorenulls=True).over(w), F.last(known, ignorenulls=True).over(w)
    rows = df.withColumn("__a", a).withColumn("__b", b)
    dt = F.col("__b.t") - F.col("__a.t")
    return rows.withColumn(out, F.when(dt >= least_s, (F.col("__b.v") - F.col("__a.v")) / dt)).drop("__a", "__b")


def carry_changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Only the rows where the last known value changes, with that value carried."""
    w = _order(keys, order)
    rows = df.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("__c", changed & F.col(value).isNotNull()).where("__c").drop("__c")


def fill_between(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Unknown values as the mean of the neighbours' known ones (one neighbour's where the other is unknown)."""
    w = _order(keys, order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(out, F.coalesce(F.col(value), (a + b) / 2, a, b))


def secondary_only(df: DataFrame, keys: list[str], t: str, secondary: str, sane: Column, reach_s: int) -> DataFrame:
    """Merges two providers: all primary rows, and the sane secondary rows with no sane primary row of the key within
    +-reach_s. One window instead of a join."""
    good = F.when(~F.col(secondary) & sane, F.col(t).cast("double"))
    w = Window.partitionBy(*keys).orderBy(F.col(t).cast("double")).rangeBetween(-reach_s, reach_s)
    rows = df.withColumn("__p", F.count(good).over(w))
    return rows.where(~F.col(secondary) | (sane & (F.col("__p") == 0))).drop("__p")


def median_step(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Upper median of the changes between neighbours of each key."""
    step = F.col(value) - F.lag(value).over(_order(keys, order))
    return df.withColumn("__s", step).where(F.col("__s").isNotNull()).groupBy(*keys).agg(upper_median("__s").alias("median"))
