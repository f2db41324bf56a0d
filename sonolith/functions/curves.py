"""Reading tabulated curves, rates of passes, and runs within an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_interpolated(x: Column, nodes: Sequence[float], values: Sequence[Column | float]) -> Column:
    """A curve that is straight over log x between its nodes and goes on straight beyond the first and the last."""
    lg = F.log10(F.greatest(x, F.lit(1e-9)))
    at = [F.log10(F.lit(float(n))) for n in nodes]
    levels = [v if isinstance(v, Column) else F.lit(float(v)) for v in values]

    def between(i: int) -> Column:
        return levels[i] + (levels[i + 1] - levels[i]) * (lg - at[i]) / (at[i + 1] - at[i])

    out = F.when(x < float(nodes[1]), between(0))
    for i in range(1, len(nodes) - 2):
        out = out.when(x < float(nodes[i + 1]), between(i))
    return out.otherwise(between(len(nodes) - 2))


def between_settings(setting: Column, settings: Sequence[float], curves: Sequence[Column]) -> Column:
    """Linear between the curves of two neighbouring settings; the nearest curve's slope goes on beyond."""
    out = None
    for i in range(len(settings) - 1):
        a, b = float(settings[i]), float(settings[i + 1])
        line = curves[i] + (curves[i + 1] - curves[i]) * (setting - a) / (b - a)
        last = i == len(settings) - 2
        out = line if out is None and last else F.when(setting < b, line) if out is None else out.otherwise(line) if last else out.when(setting < b, line)
    return out


def share_with_pass(passes_per_hour: Column, seconds: Column) -> Column:
    """Share of intervals in which at least one of randomly timed passes falls."""
    return 1 - F.exp(-passes_per_hour * seconds / 3600)


def merged_runs(values: Column, spread: float) -> Column:
    """Greedy runs of an array: a value joins the current run while the run's largest and smallest differ by at most
    `spread`. An array of structs first, last (positions), low and high."""
    numbered = F.transform(values, lambda x, i: F.struct(i.alias("first"), i.alias("last"), x.alias("low"), x.alias("high")))
    empty = F.slice(numbered, 1, 0)

    def step(runs: Column, one: Column) -> Column:
        n = F.size(runs)
        last = F.get(runs, n - 1)
        low, high = F.least(last["low"], one["low"]), F.greatest(last["high"], one["high"])
        grown = F.struct(last["first"].alias("first"), one["last"].alias("last"), low.alias("low"), high.alias("high"))
        joins = (n > 0) & (high - low <= spread)
        return F.when(joins, F.concat(F.slice(runs, F.lit(1), n - 1), F.array(grown))).otherwise(F.concat(runs, F.array(one)))

    return F.aggregate(numbered, empty, step)
