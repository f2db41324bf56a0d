"""Pairs of keys that meet often: brute force, blocks and parts, and the edges."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonolith.operators import meetings
from sonolith.plans import joins
from tests.conftest import rows_of

KIND = "key long, t long, v double"


def brute(left, right, within, apart, bucket, least):
    hours = defaultdict(set)
    for k, t, v in left:
        for k2, t2, v2 in right:
            if None not in (k, t, v, k2, t2, v2) and k != k2 and abs(t - t2) <= within and abs(v - v2) <= apart:
                hours[k, k2].add(int(t / bucket))
    return sorted((*pair, len(h)) for pair, h in hours.items() if len(h) >= least)


@pytest.mark.parametrize(("block_rows", "part_rows"), [(2_000_000, 10_000), (90, 40)])
@pytest.mark.parametrize("keys", [6, 300])
def test_brute_force(spark, monkeypatch, block_rows, part_rows, keys):
    monkeypatch.setattr(meetings, "PART_ROWS", part_rows)  # the parts are dealt by this process
    draw = random.Random(keys)

    def rows(n):
        hot = [(0, draw.randrange(-9000, 9000), draw.choice([1.0, 2.0, 3.0])) for _ in range(n)]  # one key has half
        return hot + [(draw.randrange(keys), draw.randrange(-9000, 9000), draw.uniform(0, 9)) for _ in range(n)]

    odd = [(None, 0, 1.0), (1, None, 1.0), (1, 0, None), (1, 0, float("nan")), (1, 0, float("inf"))]
    left, right = rows(250) + odd, rows(350) + odd
    out = meetings.met_often(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), 300, 0.5, 900, 2, block_rows)
    assert sorted(map(tuple, out.collect())) == brute(left, right, 300, 0.5, 900, 2)


@pytest.mark.parametrize(("hits", "bits"), [(2_000_000, 10), (7, 10), (60, 2), (1, 1)])
@pytest.mark.parametrize("least", [1, 3])
def test_portions(monkeypatch, hits, bits, least):
    """The kernel by itself, with the limits at which a key is counted in portions; values a rounding away from the limit."""
    monkeypatch.setattr(meetings, "HITS", hits)
    monkeypatch.setattr(meetings, "BITS", bits)
    draw = random.Random(hits + bits)
    values = [0.0, 0.01, 0.3, 0.1 + 0.2, 40.01, 40.0, 80.01, 39.99, 1e-17, 40.3, 0.30000000000000004 + 40, -40.0, 1e300, -1e300]
    left, right = ([(draw.randrange(8), draw.randrange(-4000, 4000), draw.choice(values)) for _ in range(n)] for n in (150, 200))
    batches = []
    for side, rows in ((0, right), (1, sorted(left))):
        for i in range(0, len(rows), 64):
            columns = [list(c) for c in zip(*rows[i : i + 64], strict=True)]
            batches.append(pa.RecordBatch.from_pydict(dict(zip(("side", "key", "t", "v"), ([side] * len(columns[0]), *columns), strict=True))))
    out = meetings._walk(iter(batches), 100, 40.0, 300, least)
    got = sorted(tuple(r.values()) for batch in out for r in batch.to_pylist())
    assert got == brute(left, right, 100, 40.0, 300, least)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], KIND), spark.createDataFrame([(1, 0, 0.0)], KIND)
    for left, right in ((none, one), (one, none), (none, none), (one, one)):
        assert meetings.met_often(left, right, 1, 1.0, 1, 1).collect() == []


def dense(path, users=60, fixes=120):
    """Many fixes in the same few hours, from before 1970 on."""
    draw = random.Random(5)
    rows = [(i, draw.randrange(-5 * 3600, 5 * 3600), i % users, "view", draw.uniform(0, 200)) for i in range(users * fixes)]
    return rows, f"{path}/events.parquet"


def test_echoes_of_dense_fixes(spark, duck, tmp_path):
    rows, at = dense(tmp_path)
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(at)
    con = duck.cursor()
    con.sql(f"create temp view events as select * from '{at}/*.parquet'")
    got = joins.J3_echoes(spark, str(tmp_path)).toPandas()
    assert len(got) > 500
    assert rows_of(got) == rows_of(con.sql(joins.SQL["J3_echoes"]).df())


def test_pairs_of_rows_stay_in_their_task(spark, tmp_path):
    """What is shuffled are rows, not the pairs of rows that meet, of which there are fifty times as many."""
    rows, at = dense(tmp_path)
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(at)
    query = joins.J3_echoes(spark, str(tmp_path))
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1 and "MapInArrow" in plan
