"""Text keys that two spellings of one thing share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference_key(ref: Column) -> Column:
    """A reference without letter case, white space, the separators - _ / . and the leading zeros of its numbers; null
    where nothing is left."""
    bare = F.regexp_replace(F.upper(ref), r"(^|[^0-9])0+([0-9])", "$1$2")
    key = F.regexp_replace(bare, r"[\s \-_/.]+", "")
    return F.when(key != "", key)


def bare_name(name: Column) -> Column:
    """Lower case without surrounding space; null where nothing is left."""
    key = F.lower(F.trim(name))
    return F.when(key != "", key)


def collapse_space(text: Column) -> Column:
    """White space runs as one space, none at the ends; null where nothing is left."""
    key = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(key != "", key)
