"""Pairs of keys whose rows meet often: near each other in time and value, in many different hours.

`met_often` counts, for every pair of a left and a right key, the buckets of time in which a left row has a right row near
it. The rows that meet outnumber both tables by far (with the density squared), so they are never written or shuffled: each
task holds a block of right rows as arrays, takes left rows by key and time, and counts what a left key meets before it takes
the next. Only pairs with enough buckets leave the task. Right keys are dealt to blocks of `block_rows` at most on
average, left keys to parts, so that every core has a task; a row is copied once for each block, or part, of the other side
(2.3 copies a row on 6 cores where a quarter of 6 million rows are left), and a pair of keys has one owner.

A block's rows are sorted by frame (a stretch of time as long as `within`) and value. What a left row meets in its own frame is
one slice; of the frames before and after, it is what of a slice lies late or early enough. The met keys of a left key are
sorted with their buckets; a key with fewer rows than `least` among them is passed over, the others' buckets are counted.

Skew: a key's left rows are walked by one task for each block, and its right rows lie in one block (some 100 bytes a row while
it is built), as a count of different buckets needs them together; a left key that meets more than `HITS` rows is counted in
portions. Defined cases: a null key or time and a value that is null or not finite meet nothing; a key doesn't meet itself;
repeated rows count once; buckets are integer quotients (rounded towards 0, as SQL divides); an empty side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2_000_000
#: Left rows that are worth a part of their own, and rows of a batch that comes out.
PART_ROWS, BATCH_ROWS = 10_000, 50_000
#: Of one left key: rows met, and bits for the number of a bucket, that are counted together.
HITS, BITS = 2_000_000, 10

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Block:
    """Right rows of a task, and what the left key that is walked has met."""

    def __init__(self, held: list[tuple[np.ndarray, ...]], within: int, apart: float, bucket: int, least: int) -> None:
        key, t, v = (np.concatenate(c) for c in zip(*held, strict=True))
        self.within, self.apart, self.bucket, self.least = within, apart, bucket, least
        self.values, rank = np.unique(v, return_inverse=True)
        self.frames, frame = np.unique(t // within, return_inverse=True)
        place = frame * len(self.values) + rank
        order = np.argsort(place, kind="stable")
        self.place, self.late = place[order], (t % within)[order].astype(np.int32 if within < 2**31 else np.int64)
        self.keys, code = np.unique(key, return_inverse=True)
        self.code = (code[order] << BITS).astype(np.int32 if len(self.keys) < 2 ** (31 - BITS) else np.int64)
        self.now, self.hour = None, None
        self._clean()

    def _clean(self) -> None:
        """No rows met; number: of the bucket among the left key's."""
        self.hits: list[np.ndarray] = []
        self.numbers: list[int] = []
        self.met = self.number = 0
        self.count: np.ndarray | None = None  # of a key that is counted in portions
        self.open: np.ndarray | None = None  # keys met in its last bucket, which may go on

    def _sorted(self) -> np.ndarray:
        """The keys met, each with the number of the bucket in its lowest bits."""
        out = np.concatenate([self.code[:0], *self.hits])
        out |= np.repeat(np.array(self.numbers, out.dtype), [len(x) for x in self.hits])
        out.sort()
        return out

    def _count_portion(self) -> None:
        """Adds the buckets so far to the count; the last one is number 0 from here on."""
        c = np.unique(self._sorted())
        if self.count is None:
            self.count = np.zeros(len(self.keys), np.int64)
        else:
            c = c[~np.isin(c, self.open)]
        self.count += np.bincount(c >> BITS, minlength=len(self.keys))
        last = c[(c & (2**BITS - 1)) == self.number] >> BITS << BITS
        self.open = last if self.number or self.open is None else np.union1d(self.open, last)
        self.hits, self.numbers, self.met, self.number = [], [], 0, 0

    def end_key(self) -> Found | None:
        """The pairs of the left key that is walked, if it has any, and a clean slate."""
        if self.count is not None:
            self._count_portion()
            at = np.flatnonzero(self.count)
            hours = self.count[at]
        elif self.met:
            c = self._sorted()
            codes = c >> BITS
            at = codes[self.least - 1 :]
            at = at.take((at == codes[: len(at)]).nonzero()[0])  # those with rows enough
            at = np.concatenate([at[:1], at[1:][at[1:] != at[:-1]]])
            lo, n = np.searchsorted(codes, at), np.searchsorted(codes, at, "right")
            n -= lo
            starts = np.cumsum(n) - n
            c = c[np.arange(n.sum()) + np.repeat(lo - starts, n)]
            fresh = np.concatenate([[True], c[1:] != c[:-1]])
            hours = np.add.reduceat(fresh, starts, dtype=np.int64) if len(at) else n
        else:
            return None
        self._clean()
        ok = (hours >= self.least) & (self.keys[at] != self.now)
        return (np.full(int(ok.sum()), self.now, np.int64), self.keys[at[ok]], hours[ok]) if ok.any() else None

    def _reach(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and behind the last of the block's values at most `apart` away, by the very difference that decides."""
        values = np.concatenate([[-np.inf], self.values, [np.inf]])
        lo, hi = np.searchsorted(values, v - self.apart), np.searchsorted(values, v + self.apart, "right")
        lo, hi = np.maximum(lo, 1), np.minimum(hi, len(values) - 1)
        for at, step, ahead in ((lo, -1, -1), (hi, 1, 0)):  # while the next one outside belongs in
            while (more := np.abs(values[at + ahead] - v) <= self.apart).any():
                at[more] += step
        while (less := (values[lo] < v) & (np.abs(values[lo] - v) > self.apart)).any():
            lo[less] += 1
        while (less := (values[hi - 1] > v) & (np.abs(values[hi - 1] - v) > self.apart)).any():
            hi[less] -= 1
        return lo - 1, np.maximum(hi, lo) - 1

    def walk(self, key: np.ndarray, t: np.ndarray, v: np.ndarray) -> Iterator[Found]:
        """Takes left rows in the order of key and time; pairs of the keys that end."""
        reach, frame, columns = self._reach(v), t // self.within, []
        for d in (0, -1, 1):
            i = np.searchsorted(self.frames, frame + d)
            there = self.frames[np.minimum(i, len(self.frames) - 1)] == frame + d
            columns += [np.where(there, np.searchsorted(self.place, i * len(self.values) + r), 0).tolist() for r in reach]
        code, late, hits, numbers = self.code, self.late, self.hits, self.numbers
        hours = (np.sign(t) * (np.abs(t) // self.bucket)).tolist()
        for k, hour, at, a, b, c, d, e, f in zip(key.tolist(), hours, (t % self.within).tolist(), *columns, strict=True):
            if k != self.now:
                if (pairs := self.end_key()) is not None:
                    yield pairs
                self.now, self.hour = k, hour
                hits, numbers = self.hits, self.numbers
            elif hour != self.hour:
                if self.number + 1 == 2**BITS:
                    self._count_portion()
                    hits, numbers = self.hits, self.numbers
                self.hour, self.number = hour, self.number + 1
            if a < b:
                hits.append(code[a:b])
                numbers.append(self.number)
            if c < d:
                hits.append(code[c:d].take((late[c:d] >= at).nonzero()[0]))
                numbers.append(self.number)
            if e < f:
                hits.append(code[e:f].take((late[e:f] <= at).nonzero()[0]))
                numbers.append(self.number)
            self.met += b - a + d - c + f - e
            if self.met > HITS:
                self._count_portion()
                hits, numbers = self.hits, self.numbers


def _walk(batches: Iterator[pa.RecordBatch], *limits) -> Iterator[pa.RecordBatch]:
    """A task's rows: right rows (side 0) first, then left rows by key and time."""

    def batch_of(pairs: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], names=["left_key", "right_key", "buckets"])

    held, block, pairs, n = [], None, [], 0
    with np.errstate(over="ignore"):
        for batch in batches:
            side, *row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "key", "t", "v"))
            cut = int(np.searchsorted(side, 1))
            if cut:
                held.append(tuple(c[:cut].copy() for c in row))
            if cut == len(side):
                continue
            if not held and block is None:
                return
            if block is None:
                block, held = _Block(held, *limits), []
            for found in block.walk(*[c[cut:] for c in row]):
                pairs.append(found)
                n += len(found[0])
                if n >= BATCH_ROWS:
                    yield batch_of(pairs)
                    pairs, n = [], 0
        if block is not None and (found := block.end_key()) is not None:
            pairs.append(found)
    if pairs:
        yield batch_of(pairs)


def met_often(
    left: DataFrame, right: DataFrame, within: int, apart: float, bucket: int, least: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(left_key, right_key, buckets) of all pairs of different keys with a left row at most `within` away in time and `apart`
    in value from a right row in at least `least` buckets of the left row's time. Both sides: key and t bigint, v double."""
    if not 0 <= apart < float("inf") or min(within, bucket, least) < 1:
        raise ValueError("apart must be 0 or more and finite, within, bucket and least 1 or more")
    spark = left.sparkSession
    usable = F.col("key").isNotNull() & F.col("t").isNotNull() & (F.abs("v") < float("inf"))
    sides = [df.select("key", "t", "v", F.lit(i).alias("side")).where(usable) for i, df in enumerate((right, left))]
    rows = dict(sides[0].unionByName(sides[1]).groupBy("side").count().collect())  # two rows
    held, walked = rows.get(0, 0), rows.get(1, 0)
    tasks, fewest = spark.sparkContext.defaultParallelism, max(1, math.ceil(held / block_rows))
    # One task a core, with few copies; a left row's copy, which is walked, counts twice.
    parts = max(1, min(round(math.sqrt(2 * tasks * walked / max(1, held))), math.ceil(tasks / fewest), 1 + walked // PART_ROWS))
    blocks = max(fewest, min(math.ceil(tasks / parts), 1 + held // PART_ROWS))

    def dealt(n: int):
        return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rights = sides[0].withColumn("block", dealt(blocks)).withColumn("part", copies(parts))
    lefts = sides[1].withColumn("part", dealt(parts)).withColumn("block", copies(blocks))
    both = rights.unionByName(lefts).withColumn("task", F.col("part") * blocks + F.col("block")).drop("part", "block")
    walks = F.col("side") == 1  # right rows come first, in any order
    ordered = both.repartitionById(parts * blocks, "task").sortWithinPartitions(F.when(walks, F.col("key")), F.when(walks, F.col("t")))
    return ordered.select("side", "key", "t", "v").mapInArrow(
        lambda batches: _walk(batches, within, apart, bucket, least), "left_key bigint, right_key bigint, buckets bigint"
    )
