"""Packing: every item whole and once, nothing too full, and as full as brute force finds."""

import itertools
import random
from collections import Counter

import pytest

from sonolith.llm.packing import fullest, pack, plan


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_fullest(seed):
    r = random.Random(seed)
    items = [r.randrange(1, 40) for _ in range(10)]
    room = r.randrange(1, 90)
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
    used = fullest(room, Counter(items))
    assert sum(n * c for n, c in used.items()) == best
    assert all(c <= Counter(items)[n] for n, c in used.items())


def test_plan_uses_every_item():
    counts = {n: n * 37 % 11 + 1 for n in range(1, 129)} | {77: 100_000}
    used = Counter()
    patterns = plan(counts, 128)
    for times, pattern in patterns:
        assert sum(n * c for n, c in pattern.items()) <= 128
        for n, c in pattern.items():
            used[n] += c * times
    assert used == Counter(counts) and len(patterns) < 300


def test_pack(spark):
    r = random.Random(3)
    sizes = [r.randrange(1, 60) for _ in range(500)] + [64] * 300 + [7] * 800 + [200, 0, 0]
    rows = list(enumerate(sizes)) + [(9000, None), (1, sizes[1])]
    out = pack(spark.createDataFrame(rows, "id long, n int"), "id", "n", 64).collect()
    full = Counter()
    for x in out:
        if x.container_id is not None:
            full[x.container_id] += x.units
    assert max(full.values()) <= 64 and set(full) == set(range(len(full)))
    assert sum(full.values()) == sum(sizes) + sizes[1]
    assert len(full) <= -(-sum(full.values()) // 64) + 2
    assert sorted((x.piece, x.first_unit, x.units) for x in out if x.id == 1100 + 500) == [(0, 0, 64), (1, 64, 64), (2, 128, 64), (3, 192, 8)]
    assert sorted(x.id for x in out if x.container_id is None) == [1601, 1602, 9000]
    pieces = Counter((x.id, x.piece) for x in out)
    assert pieces[(1, 0)] == 2 and len(out) == len(rows) + 3


def test_nothing_to_pack(spark):
    assert pack(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0
    assert [r.container_id for r in pack(spark.createDataFrame([(1, 0)], "id long, n int"), "id", "n").collect()] == [None]
