"""Dense positions and running totals over a whole ordered table, without a one-task window.

Rows are cut into key ranges by fixed bounds. Inside a range an ordinary window counts; the totals of the ranges,
one row each, are accumulated and added. The bounds come from a sample but only steer balance: any bounds give the
same result. They are fetched once and enter the plan as literals, so a lost task is recomputed with the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: keys fetched for one range
KEYS_PER_RANGE = 20
RANGE = "__range"

Bounds = list[tuple]


def key_bounds(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> Bounds:
    """Upper bounds of about equally filled key ranges, as many as shuffle partitions unless ``ranges`` is given.

    One pass over the keys: they fall into ``20 * ranges`` slots by one digest, and each slot gives the key with the
    least second digest, which is a uniform draw. No more keys than slots are fetched.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return []
    key = F.struct(*order)
    slot = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(KEYS_PER_RANGE * ranges))
    drawn = df.select(*order).dropna().groupBy(slot).agg(F.min_by(key, F.xxhash64(key, F.lit(2))).alias("key"))
    sampled = sorted({tuple(row["key"]) for row in drawn.collect()})
    return sorted({sampled[i * len(sampled) // ranges] for i in range(1, ranges)}) if sampled else []


def range_of(df: DataFrame, order: Sequence[str], bounds: Bounds) -> Column:
    """Number of bounds below the row's key, found by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    types = [df.schema[c].dataType for c in order]

    def literal(key: tuple) -> Column:
        parts = [F.lit(v).cast(t).alias(c) for v, t, c in zip(key, types, order, strict=True)]
        return parts[0] if len(parts) == 1 else F.struct(*parts)

    def spelled(key: tuple) -> str:
        parts = [f"cast('{v}' as {t.simpleString()})" for v, t in zip(key, types, strict=True)]
        return parts[0] if len(parts) == 1 else f"named_struct({', '.join(f'{c!r}, {p}' for c, p in zip(order, parts, strict=True))})"

    if all(isinstance(t, IntegralType) for t in types) and all(c.isidentifier() for c in order):
        table = F.expr(f"array({', '.join(map(spelled, bounds))})")  # one call to the JVM instead of some for every value
    else:
        table = F.array(*[literal(b) for b in bounds])
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    strides = [1 << p for p in reversed(range(len(bounds).bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(s) for s in strides]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < key), at + s).otherwise(at),
    )
    return F.coalesce(below, F.lit(0))


def running_total(
    df: DataFrame, value: Column, order: Sequence[str], by: Sequence[str], name: str, bounds: Bounds | None = None
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same ``by`` group, in the order of the unique key ``order``.

    The whole row takes part in the exchange, so give this a narrow table and join the rest by key. A group of any
    size is spread over all key ranges. NULL in ``by`` is a group of its own.
    """
    if bounds is None:
        bounds = key_bounds(df, order)
    zero = F.lit(0).cast("bigint")
    ranged = df.withColumn(RANGE, range_of(df, order, bounds)).withColumn("__value", value.cast("bigint"))
    group = [*by, RANGE]
    earlier_ranges = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*group)
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__start", F.coalesce(F.sum("__sum").over(earlier_ranges), zero))
        .drop("__sum")
    )
    earlier_rows = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("__inside", F.coalesce(F.sum("__value").over(earlier_rows), zero))
    return (
        join_null_safe(inside, starts, group, "inner")
        .withColumn(name, F.col("__start") + F.col("__inside"))
        .select(*df.columns, name)
    )


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL meets NULL; the keys come from ``left``."""
    keys = {c: f"__key_{n}" for n, c in enumerate(on)}
    renamed = right.withColumnsRenamed(keys)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return left.join(renamed, reduce(Column.__and__, same, F.lit(True)), how).drop(*keys.values())
