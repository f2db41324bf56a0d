"""The batch operators on streams: windows with a watermark, once-only rows, sessions by a resting state, and day by
day accumulation into a table of mergeable sums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def tumbling_counts(stream: DataFrame, t: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows of each key in windows of event time; a window is final when the watermark passes its end."""
    counts = stream.withWatermark(t, late).groupBy(F.window(t, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n")


def once(stream: DataFrame, t: str, keys: list[str], late: str) -> DataFrame:
    """Each key's first row within the watermark; deliveries again are dropped."""
    return stream.withWatermark(t, late).dropDuplicatesWithinWatermark(keys)


def rest_sessions(stream: DataFrame, key: str, t: str, resting: str, rest_s: float) -> DataFrame:
    """Sessions that end in a rest of at least rest_s, as the batch form has them but for the shared rest: a session is
    given out when the first moving row after such a rest arrives. Columns: key, start_s, stop_s, rows. Rows of a key
    are expected in time order over the micro-batches (within one they are sorted); earlier ones are left out. The
    state is a few numbers a key."""
    kind = stream.schema[key].dataType.simpleString()

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, rest, moved, rows = state.get if state.exists else (-1.0, -1.0, -1.0, False, 0)
        pdf = pd.concat(list(parts)).dropna(subset=[t]).sort_values(t, kind="stable")
        done = []
        for second, still in zip(pdf[t].map(lambda x: x.timestamp()), pdf[resting], strict=True):
            if second < last:
                continue
            if not still and moved and rest >= 0 and last - rest >= rest_s:
                done.append((name[0], start, last, rows))
                start, moved, rows = second, False, 0
            start = second if start < 0 else start
            rest = (second if rest < 0 else rest) if still else -1.0
            moved, rows, last = moved or not still, rows + 1, second
        state.update((start, last, rest, moved, rows))
        if done:
            yield pd.DataFrame(done, columns=[key, "start_s", "stop_s", "rows"])

    return stream.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {kind}, start_s double, stop_s double, rows long",
        "start double, last double, rest double, moved boolean, rows long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def accumulate(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str):
    """Starts a query that adds each micro-batch's sums to the table at path, one folder a batch: a batch that is run
    again replaces its own folder, so that nothing counts twice. `total` reads the sums."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def total(spark, path: str, keys: list[str]) -> DataFrame:
    """The sums over all batches so far."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
