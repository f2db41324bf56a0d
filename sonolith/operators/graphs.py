"""Graphs: components of undirected edges, trees of shortest paths, sums down the trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node is connected with. Alternates large-star and small-star
    steps, which settle in about log(n) rounds for any shape; each round is written to the shared folder, the one before
    it deleted, and only a count and a checksum come to the driver. A node of very many edges is aggregated map-side
    before it moves."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    links = materialize(pairs.where("u <> v").distinct(), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(links)
        links, before, state = now, state, _state(now)
        if state == before:
            break
    return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def _state(df: DataFrame) -> tuple:
    """Number and checksums of the rows."""
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.bit_xor(F.hash(*df.columns))).first())


def joined_rows(rows: DataFrame, row: str, ends: list[str], joins: str) -> DataFrame:
    """(row, run): rows that form one line. Two rows join where exactly two ends meet at a node, the rows differ and
    `joins` is known and equal; a row with both ends at one node fills it alone. A run is named by its smallest row."""
    nodes = rows.select(row, joins, F.explode(F.array(*ends)).alias("node")).where("node is not null")
    met = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min(row).alias("a"), F.max(row).alias("b"),
        F.min(joins).alias("ja"), F.max(joins).alias("jb"), F.count(joins).alias("known"),
    )
    links = met.where("n = 2 and a <> b and known = 2 and ja = jb").select("a", "b")
    parts = components(links)
    return rows.select(row).join(parts.withColumnRenamed("node", row), row, "left").select(
        row, F.coalesce("component", F.col(row)).alias("run")
    )


def shortest_tree(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, distance, parent) of shortest paths from the nearest source. edges: a, b, length (both ways); sources:
    node. Relaxes the nodes that changed, round by round, until none does; the smaller parent wins a tie."""
    both = edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    both = materialize(both.groupBy("a", "b").agg(F.min("length").alias("length")), "edges")
    none = F.lit(None).cast(both.schema["a"].dataType)
    first = sources.select("node", F.lit(0.0).alias("distance"), none.alias("parent"), F.lit(True).alias("changed")).distinct()
    found = materialize(first, "tree")
    while True:
        step = found.where("changed").join(both, F.col("node") == both.a).select(
            F.col("b").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), F.col("a").alias("parent"), F.lit(None).cast("double").alias("old")
        )
        known = found.select("node", "distance", "parent", F.col("distance").alias("old"))
        best = known.unionByName(step).groupBy("node").agg(
            F.min(F.struct("distance", F.coalesce("parent", F.lit(-1).cast("long")).alias("p"), "parent")).alias("m"), F.max("old").alias("old")
        )
        changed = F.col("old").isNull() | (F.col("m.distance") < F.col("old"))
        now = materialize(best.select("node", "m.distance", "m.parent", changed.alias("changed")), "tree")
        discard(found)
        found = now
        if found.where("changed").isEmpty():
            discard(both)
            return found.select("node", "distance", "parent")


def service_tree(edges: DataFrame, drains: DataFrame) -> DataFrame:
    """(node, distance, parent) of the shortest ways to the nodes that drain, and in each part of the graph that none of
    them reaches, to its node of most edges (the smaller one on a tie)."""
    edges = materialize(edges.select("a", "b", "length").where("a <> b"), "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("edges"))
    parts = components(edges).join(degree, "node").join(drains.select("node", F.lit(True).alias("drains")).distinct(), "node", "left")
    parts = materialize(parts, "parts")
    busiest = F.max_by("node", F.struct("edges", -F.col("node")))
    alone = parts.groupBy("component").agg(F.max("drains").alias("drained"), busiest.alias("node")).where("drained is null")
    roots = parts.where("drains").select("node").unionByName(alone.select("node"))
    return shortest_tree(edges, roots)


def accumulate(tree: DataFrame, load: DataFrame) -> DataFrame:
    """(node, flow): the load of each node and of all nodes whose way to the source leads through it. Every round a node
    hands what it has gathered to the node twice as far up, so that a tree of any depth takes log2(depth) rounds."""
    loads = load.groupBy("node").agg(F.sum(F.col("load").cast("double")).alias("load"))
    nodes = tree.select("node", F.col("parent").alias("up")).join(loads, "node", "full").select("node", "up", F.coalesce("load", F.lit(0.0)).alias("flow"))
    now = materialize(nodes, "flows")
    while not now.where("up is not null").isEmpty():
        handed = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("flow").alias("more"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        step = now.join(handed, "node", "left").join(above, "up", "left")
        after = materialize(step.select("node", F.col("higher").alias("up"), (F.col("flow") + F.coalesce("more", F.lit(0.0))).alias("flow")), "flows")
        discard(now)
        now = after
    # Nodes of the tree without any load below them have no flow.
    return now.where("flow <> 0").select("node", "flow")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a position lies in a ring (an array of structs x, y): crossings of a ray to the east."""
    n = F.size(ring)

    def crosses(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
        return acc != F.coalesce(spans & (x < at), F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace rule."""
    n = F.size(ring)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(ring, i)["x"] * F.get(ring, F.pmod(i + 1, n))["y"]
        - F.get(ring, F.pmod(i + 1, n))["x"] * F.get(ring, i)["y"],
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2
