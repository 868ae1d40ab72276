"""A lookup by a key that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a group with one in so many of the rows is hot; there are at most so many of them
HOT_GROUPS = 1000


def lookup_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row per ``key`` and its number of rows in ``size``.

    Groups of at least ``total / HOT_GROUPS`` rows, at most ``HOT_GROUPS`` of them if ``total`` is the sum of all
    sizes, are broadcast, so their rows stay where they are; the rest are joined by an exchange.
    """
    named = groups.withColumnRenamed(key, "__key")
    hot = F.col(size) * HOT_GROUPS >= total
    out = [c for c in groups.columns if c != key]
    looked = rows.join(F.broadcast(named.where(hot)), F.col(key) == F.col("__key"), "left")
    found = looked.where(F.col("__key").isNotNull()).drop("__key")
    others = looked.where(F.col("__key").isNull()).drop("__key", *out)
    return found.unionByName(others.join(named.where(~hot), F.col(key) == F.col("__key"), "left").drop("__key"))
