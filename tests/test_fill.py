"""Filling: the finest group with enough support wins; marks say what was filled and from where."""

import math

import pytest
from pyspark.sql import functions as F

from sonolith.operators.fill import Level, fill_from_groups, filled_rows

LEVELS = [Level("ab", ("a", "b"), 2), Level("a", ("a",), 2), Level("all", (), 1)]


def filled(spark, rows, kind="median", schema="id long, a string, b string, v double"):
    df = spark.createDataFrame(rows, schema)
    known = F.col("v").isNotNull() if kind == "mode" else F.col("v").between(0, 100) & ~F.isnan("v")
    out = fill_from_groups(df, {"v": F.col("v")}, known, LEVELS, kind, 10, "out")
    return {r.id: (r.out, r.out_filled, r.out_level, r.out_support) for r in out.collect()}


def test_back_off(spark):
    rows = [(1, "x", "p", 1.0), (2, "x", "p", 3.0), (3, "x", "q", 9.0), (4, "y", "p", 50.0)]
    rows += [(10, "x", "p", None), (11, "x", "q", None), (12, "y", "p", -1.0), (13, "z", "p", math.nan), (14, None, None, 999.0)]
    got = filled(spark, rows)
    assert got[1] == (1.0, False, None, 0)
    assert got[10] == (2.0, True, "ab", 2)
    assert got[11] == (3.0, True, "a", 3)  # one row isn't enough for (x, q)
    assert got[12][2] == got[13][2] == got[14][2] == "all"
    assert got[14][0] == 6.0  # (3 + 9) / 2
    assert len(got) == len(rows)


def test_mode_tie_goes_to_the_smaller(spark):
    rows = [(1, "x", "p", "m"), (2, "x", "p", "k"), (3, "x", "p", None)]
    got = filled(spark, rows, "mode", "id long, a string, b string, v string")
    assert got[3] == ("k", True, "ab", 2)


def test_nothing_known(spark):
    df = spark.createDataFrame([(1, "x", "p", None)], "id long, a string, b string, v double")
    out = fill_from_groups(df, {"v": F.col("v")}, F.col("v").isNotNull(), LEVELS, out="out")
    assert [(r.out, r.out_level) for r in filled_rows(out, "out").collect()] == [(None, "none")]


def test_empty_table_and_clashing_columns(spark):
    assert filled(spark, []) == {}
    df = spark.createDataFrame([(1, "x", "p", 2.0, "old")], "id long, a string, b string, v double, out string")
    out = fill_from_groups(df, {"v": F.col("v")}, F.col("v").isNotNull(), LEVELS, out="out")
    assert out.collect()[0].out == 2.0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    import random
    import statistics

    r = random.Random(seed)
    rows = [(i, r.choice("xyz"), r.choice("pq"), r.choice([None, round(r.random() * 90, 1)])) for i in range(120)]
    got = filled(spark, rows)
    for i, a, b, v in rows:
        if v is not None:
            continue
        for name, keep in (("ab", lambda o: o[1:3] == (a, b)), ("a", lambda o: o[1] == a), ("all", lambda o: True)):
            values = [o[3] for o in rows if o[3] is not None and keep(o)]
            if len(values) >= (1 if name == "all" else 2):
                assert got[i][2:] == (name, len(values)) and abs(got[i][0] - statistics.median(values)) < 1e-6
                break


def test_level_without_a_finished_value_is_passed_over(spark):
    """Medians of zero in every component give no shares: the next level fills, and the row is listed."""
    one = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(i, "x", one[i % 3]) for i in range(6)] + [(10 + i, "y", [0.5, 0.25, 0.25]) for i in range(9)]
    rows += [(20, "x", None), (21, "y", None)]
    df = spark.createDataFrame(rows, "id long, a string, v array<double>")

    def finish(c):
        total = c["p"] + c["q"] + c["r"]
        return F.when(total > 0, F.array(*[c[n] / total for n in "pqr"]))

    def run(df):
        parts = {n: F.get("v", i) for i, n in enumerate("pqr")}
        out = fill_from_groups(df, parts, F.col("v").isNotNull(), [Level("a", ("a",), 5), Level("all", (), 1)], "median", 1000, "out", finish)
        return {r.id: (r.out, r.out_level, r.out_support) for r in filled_rows(out, "out").collect()}

    got = run(df)
    assert set(got) == {20, 21}
    assert got[20][1:] == ("all", 15) and got[20][0] == pytest.approx([1 / 2, 1 / 4, 1 / 4])
    assert got[21] == ([0.5, 0.25, 0.25], "a", 9)
    assert run(df.where("a = 'x'")) == {20: (None, "none", 0)}
