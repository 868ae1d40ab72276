"""A filter of 64-bit keys in Spark's own bitmap functions: it keeps rows in place that no key can mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.exact_dedup import BITMAP_BITS, filter_bits

BITS_PER_KEY = 16
#: bits of a filter at most: 32 MB, which is what gets broadcast
MAX_BITS = 1 << 28


@dataclass
class KeyFilter:
    """``bitmaps (bucket, bitmap)`` with two bits set per key."""

    bits: int
    bitmaps: DataFrame

    def positions(self, key: Column) -> list[Column]:
        low = F.lit(self.bits - 1)
        return [key.bitwiseAND(low), F.shiftrightunsigned(key, 32).bitwiseAND(low)]

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """``rows`` whose key is surely not in the filter, and those whose key may be. Nothing is exchanged."""
        tests, looked, mark = [], rows, "__"
        while any(c.startswith(mark) and c.endswith(("bit_0", "bit_1", "bucket_0", "bucket_1", "map_0", "map_1")) for c in rows.columns):
            mark += "_"
        for k, position in enumerate(self.positions(key)):
            at, bucket, bitmap = f"{mark}bit_{k}", f"{mark}bucket_{k}", f"{mark}map_{k}"
            side = self.bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
            looked = looked.withColumn(at, position)
            looked = looked.join(F.broadcast(side), F.expr(f"bitmap_bucket_number({at} + 1)") == F.col(bucket), "left")
            byte = f"cast(conv(hex(substring({bitmap}, cast({at} % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
            tests.append(F.expr(f"coalesce(shiftright({byte}, cast({at} % 8 as int)) & 1 = 1, false)"))
        may = tests[0] & tests[1]
        own = [rows[c] for c in rows.columns]
        return looked.where(~may).select(*own), looked.where(may).select(*own)


def key_filter(keys: DataFrame, key: Column, max_bits: int = MAX_BITS) -> KeyFilter:
    """The filter of ``key``, a well mixed BIGINT, over the stored table ``keys``: 16 bits a key up to ``max_bits``.

    Beyond that more rows test true, which costs their exchange and changes no result.
    """
    made = KeyFilter(filter_bits(keys.count(), BITS_PER_KEY, max_bits), keys)
    places = keys.select(F.explode(F.array(*made.positions(key))).alias("p"))
    made.bitmaps = places.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bitmap")
    )
    return made
