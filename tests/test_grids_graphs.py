"""Grids, distributions, selection and graphs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sonolith.functions.hashes import fnv1a
from sonolith.functions.levels import loudness_code, loudness_of
from sonolith.operators import graphs, grids, grouping, selection


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in list(parent)}
    got = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == want
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shortest_tree_and_flow(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (9, 10, 1.0)], "a long, b long, length double")
    tree = graphs.shortest_tree(edges, spark.createDataFrame([(1,)], "node long"))
    assert sorted((r.node, r.distance, r.parent) for r in tree.where("node > 1").collect()) == [(2, 1.0, 1), (3, 2.0, 2), (4, 3.0, 3)]
    load = spark.createDataFrame([(i, 1.0) for i in (1, 2, 3, 4)], "node long, load double")
    assert {r.node: r.flow for r in graphs.accumulate(tree, load).collect()} == {1: 4.0, 2: 3.0, 3: 2.0, 4: 1.0}


def test_inside_and_area(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]])
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 2.5), (5.0, 1.0)], "x double, y double")
    assert [r.i for r in df.select(graphs.inside(F.col("x"), F.col("y"), ring).alias("i")).collect()] == [True, False, True, False]
    assert df.select(graphs.ring_area(ring).alias("a")).first().a == 10.0


def test_pyramid_leaves_out_what_is_not_assessed(spark):
    df = spark.createDataFrame([(0, 0, 4.0, 1), (1, 0, 8.0, 3), (1, 1, None, 0), (2, 2, 1.0, 1)], "x int, y int, m double, w long")
    got = {(r.up, r.x, r.y): (r.m, r.w) for r in grids.pyramid(df, "x", "y", [], "m", "w", 2).collect()}
    assert got == {(1, 0, 0): (7.0, 4), (1, 1, 1): (1.0, 1), (2, 0, 0): (29 / 5, 5)}


def test_combined_codes(spark):
    df = spark.createDataFrame([(1, 254), (1, 254), (2, 255), (2, 60), (3, 60), (3, 60), (4, 254), (4, 100)], "k long, c int")
    got = {r.k: r.combined for r in grids.combine_codes(df, ["k"], "c").collect()}
    assert got == {1: 254, 2: 255, 3: 66, 4: 100}


def test_codes_round_trip(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,), (1e9,), (1e-9,)], "s double")
    got = [(r.c, r.s) for r in df.select(loudness_code(F.col("s")).alias("c"), loudness_of(loudness_code(F.col("s"))).alias("s")).collect()]
    assert [g[0] for g in got] == [255, 254, 80, 100, 253, 254]
    assert [g[1] for g in got][:4] == [None, 0.0, 1.0, 2.0]


def test_percents_add_up(spark):
    df = spark.createDataFrame([(1, "a", 1 / 3), (1, "b", 1 / 3), (1, "c", 1 / 3), (2, "a", 0.995), (2, "b", 0.005)], "k long, n string, s double")
    got = {(r.k, r.n): r.percent for r in grouping.whole_percents(df, ["k"], "s", "n").collect()}
    assert got == {(1, "a"): 34, (1, "b"): 33, (1, "c"): 33, (2, "a"): 100, (2, "b"): 0} or sum(v for k, v in got.items() if k[0] == 2) == 100


def test_estimate_is_exact_for_certain_rows_and_close_otherwise(spark):
    rows = [(1, i, float(b), float(b) * 2) for i, b in enumerate([1000, 1, 1, 1])] + [(2, i, float(b % 7 + 1), float(b % 7 + 1) * 3) for i, b in enumerate(range(400))]
    df = spark.createDataFrame(rows, "k long, i long, b double, v double")
    got = {r.k: (r.estimate, r.variance) for r in selection.proportional_estimate(df, ["k"], "b", "v", "i", 16).collect()}
    assert abs(got[1][0] - 2006) < 1e-6
    assert abs(got[2][0] - sum(r[3] for r in rows if r[0] == 2)) < 1e-6 and got[2][1] < 1e-9  # the value follows the bound


def test_fnv(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "s string")
    assert [r.h for r in df.select(fnv1a(F.col("s")).alias("h")).collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None]


def test_once_only_weights(spark):
    df = spark.createDataFrame([(1, "f", True), (1, "f", False), (1, "g", True), (1, "g", True)], "k long, f string, s boolean")
    out = grouping.count_once(df, ["k"], "f", F.col("s"), F.lit(0.5), F.lit(0.1)).collect()
    assert [(r.weighted, r.things) for r in out] == [(0.6, 2)]


def test_rows_join_only_where_exactly_two_meet(spark):
    rows = [(1, 10, 11, "x"), (2, 11, 12, "x"), (3, 12, 13, "y"), (4, 12, 14, "x"), (5, 20, 20, "x"), (6, 20, 21, "x"), (7, 30, 31, None), (8, 31, 32, None), (9, None, 10, "x")]
    out = graphs.joined_rows(spark.createDataFrame(rows, "r long, a long, b long, j string"), "r", ["a", "b"], "j")
    # 12 is met by three ends; 20 is filled by the loop of row 5; rows of unknown kind never join.
    assert {x.r: x.run for x in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 1}


def test_upper_median_and_nearest_rank(spark):
    rows = [(n, float(x)) for n in range(1, 42) for x in range(n)]
    df = spark.createDataFrame(rows, "n long, v double")
    upper = {r.n: r.m for r in df.groupBy("n").agg(grouping.upper_median("v").alias("m")).collect()}
    ranked = {r.n: r.p for r in selection.exact_ranks(df, ["n"], "v", {"p": grouping.nearest_rank(0.95)}).collect()}
    assert upper == {n: float(n // 2) for n in range(1, 42)}
    assert ranked == {n: float(-(-n * 95 // 100) - 1) for n in range(1, 42)}


def test_runs_of_an_array(spark):
    from sonolith.functions.curves import merged_runs

    df = spark.createDataFrame([([1.0, 1.1, 1.3, 1.25, 2.0, 0.0],), ([],), ([5.0],)], "v array<double>")
    got = [[(r.first, r.last) for r in x.m] for x in df.select(merged_runs(F.col("v"), 0.25).alias("m")).collect()]
    assert got == [[(0, 1), (2, 3), (4, 4), (5, 5)], [], [(0, 0)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_service_tree_against_dijkstra(spark, seed):
    """Ways to the nearest drain; parts without one lead to their busiest node."""
    import heapq
    from collections import Counter, defaultdict

    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40), float(r.randrange(1, 9))) for _ in range(45)] + [(100 + i, 101 + i, 1.0) for i in range(20)] + [(105, 105, 1.0)]
    drains = [3, 9, 17]
    near, degree = defaultdict(list), Counter()
    for a, b, d in edges:
        if a != b:
            near[a].append((b, d))
            near[b].append((a, d))
            degree[a] += 1
            degree[b] += 1
    distance = {}

    def search(sources):
        heap = [(0.0, n) for n in sources]
        while heap:
            d, u = heapq.heappop(heap)
            if d < distance.get(u, float("inf")):
                distance[u] = d
                for v, e in near[u]:
                    heapq.heappush(heap, (d + e, v))

    search([n for n in drains if n in degree])
    for n in sorted(degree):
        if n not in distance:
            part, at = [n], 0
            while at < len(part):
                part += [v for v, _ in near[part[at]] if v not in part]
                at += 1
            search([max(part, key=lambda u: (degree[u], -u))])
    tree = graphs.service_tree(spark.createDataFrame(edges, "a long, b long, length double"), spark.createDataFrame([(n,) for n in drains], "node long"))
    rows = {x.node: (x.distance, x.parent) for x in tree.collect()}
    assert {n: d for n, (d, _) in rows.items()} == distance
    for n, (d, p) in rows.items():
        assert (p is None) == (d == 0) and (p is None or any(v == p and distance[p] + e == d for v, e in near[n]))


def test_flow_down_a_deep_tree(spark):
    n = 300  # a path, and a leaf on each of its nodes
    tree = [(0, None)] + [(i, i - 1) for i in range(1, n)] + [(1000 + i, i) for i in range(n)]
    load = [(1000 + i, 1.0) for i in range(n)] + [(5, 2.0), (5, 3.0)]
    got = graphs.accumulate(spark.createDataFrame(tree, "node long, parent long"), spark.createDataFrame(load, "node long, load double"))
    flow = {x.node: x.flow for x in got.collect()}
    assert flow[0] == n + 5 and flow[6] == n - 6 and flow[5] == n - 5 + 5 and flow[1007] == 1.0


def test_stencil_and_distance_against_loops(spark):
    r = random.Random(4)
    cells = {(x, y): float(r.randrange(100)) for x in range(11) for y in range(13) if r.random() > 0.03}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()] + [(50, 50, None)], "x int, y int, v double")
    w = (1, 2, 2, 2, 2, 2, 1)
    got = {(c.x, c.y): c.mean for c in grids.stencil(df, "x", "y", "v", w).collect()}
    assert set(got) == set(cells)
    for (x, y), mean in got.items():
        square = [(cells.get((x + i - 3, y + j - 3)), w[i] * w[j]) for i in range(7) for j in range(7)]
        want = None if any(v is None for v, _ in square) else sum(v * k for v, k in square) / 144
        assert mean == want if want is None else abs(mean - want) < 1e-9
    full = [(x, y, x * y % 17 != 5) for x in range(20) for y in range(15)]
    out = grids.distance_to_missing(spark.createDataFrame(full, "x int, y int, ok boolean"), "x", "y", F.col("ok"), 6)
    got = {(c.x, c.y): c.distance for c in out.collect()}
    # Two chamfer passes over the raster.
    d = {(x, y): 99.0 if ok else 0.0 for x, y, ok in full}
    for way in (1, -1):
        for x, y, _ in full if way == 1 else full[::-1]:
            steps = [(x - way, y - way, 2**0.5), (x - way, y, 1.0), (x - way, y + way, 2**0.5), (x, y - way, 1.0)]
            d[x, y] = min([d[x, y], *[d.get((a, b), 0.0) + s for a, b, s in steps if d[x, y]]])
    assert all(abs(got[k] - min(d[k], 7.0)) < 1e-9 for k in d)


@pytest.mark.parametrize("values", [3, 100_000])
def test_exact_ranks_of_few_keys(spark, values):
    r = random.Random(values)
    rows = [(r.choice("aab"), r.randrange(values)) for _ in range(2000)] + [("c", None), ("d", 7)]
    got = selection.exact_ranks(
        spark.createDataFrame(rows, "k string, v long"), ["k"], "v", {"upper": lambda n: F.floor(n / 2) + 1, "p95": grouping.nearest_rank(0.95)}
    ).collect()
    for x in got:
        own = sorted(v for k, v in rows if k == x.k and v is not None)
        assert (x["values"], x.upper, x.p95) == (len(own), own[len(own) // 2], own[-(-len(own) * 95 // 100) - 1])
    assert {x.k for x in got} == {"a", "b", "d"}


def test_total_order_is_whole(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"), F.lit(2).alias("w"))
    rows = selection.running_total(df, ["k", "v"], "w").collect()
    assert [x.before for x in sorted(rows, key=lambda x: (x.k, x.v))] == list(range(0, 10_000, 2))


def test_draws_are_unbiased_and_their_variance_honest(spark):
    r = random.Random(3)
    rows = [(g, i, float(r.randrange(1, 9)), float(r.randrange(1, 9))) for g in range(400) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, i long, b double, v double")
    truth = {}
    for g, _, _, v in rows:
        truth[g] = truth.get(g, 0.0) + v
    got = selection.proportional_estimate(df, ["k"], "b", "v", "i", 20).collect()
    assert len(got) == 400 and abs(sum(x.estimate - truth[x.k] for x in got) / sum(truth.values())) < 0.03  # three standard errors
    inside = sum(abs(x.estimate - truth[x.k]) <= 2 * x.variance**0.5 for x in got) / 400
    assert 0.82 < inside < 0.99  # skewed draws, twenty of them
    more = selection.estimate_until(df, ["k"], "b", "v", "i", 0.1, 20, 80).collect()
    assert len(more) == 400 and {x.size for x in more} <= {20, 40, 80} and len({x.size for x in more}) > 1
    assert all(2 * x.variance**0.5 <= 0.1 * x.estimate for x in more if x.size < 80)
