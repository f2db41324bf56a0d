"""Hashes whose exact values are part of a key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        h = 0xCBF29CE484222325
        for byte in text.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return texts.map(one)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes, as 16 hexadecimal digits; null for null."""
    return _fnv(text)
