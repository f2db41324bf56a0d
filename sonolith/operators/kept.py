"""Sequence operators whose state depends on the rows that were kept: they walk each key's rows in order.

One key's rows are walked in one task (a track of one vehicle), so keys must be bounded; split a longer history by day
before. Rows without a time are left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def drop_jumps(
    df: DataFrame, keys: list[str], t: str, value: str, limit: float, within_s: float
) -> DataFrame:
    """Drops a row whose value lies more than `limit` from the last kept row's within within_s after it."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[t]).sort_values([t, value], kind="stable")
        seconds = pdf[t].astype("int64").to_numpy() / 1e6 if str(pdf[t].dtype).startswith("datetime") else pdf[t].to_numpy()
        if str(pdf[t].dtype).startswith("datetime64[ns"):
            seconds = seconds / 1e3
        values, keep, last = pdf[value].to_numpy(dtype=float), np.ones(len(pdf), bool), -1
        for i in range(len(pdf)):
            if last >= 0 and 0 < seconds[i] - seconds[last] < within_s and abs(values[i] - values[last]) > limit:
                keep[i] = False
            else:
                last = i
        return pdf[keep]

    return df.groupBy(*keys).applyInPandas(walk, df.schema)


def simplify(df: DataFrame, keys: list[str], order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Douglas-Peucker: the rows that a line needs to stay within the tolerance."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[order, x, y]).sort_values([order, x, y], kind="stable")
        points = pdf[[x, y]].to_numpy(dtype=float)
        keep = np.zeros(len(pdf), bool)
        if len(pdf):
            keep[[0, -1]] = True
        stack = [(0, len(pdf) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            chord = points[b] - points[a]
            inner = points[a + 1 : b] - points[a]
            length = float(chord @ chord)
            along = np.clip(inner @ chord / length, 0, 1) if length else np.zeros(len(inner))
            off = np.hypot(*(inner - along[:, None] * chord).T)
            k = int(off.argmax())
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf[keep]

    return df.groupBy(*keys).applyInPandas(walk, df.schema)


def greedy_pairs(pairs: DataFrame, group: str, a: str, b: str, distance: str) -> DataFrame:
    """One-to-one pairing within each group: by rising distance, a pair counts when both are still free."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, keep = set(), set(), []
        pdf = pdf.sort_values([distance, a, b])
        for left, right in zip(pdf[a], pdf[b], strict=True):
            free = left not in used_a and right not in used_b
            keep.append(free)
            if free:
                used_a.add(left)
                used_b.add(right)
        return pdf[np.array(keep, bool)]

    return pairs.groupBy(group).applyInPandas(walk, pairs.schema)
