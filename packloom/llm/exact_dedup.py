"""Exact duplicates by two passes over a Bloom filter.

Pass one sets two filter positions per row and keeps the positions that more than one row has set. Pass two tests
every row against those: a row with a position of its own has a text nobody else has, and passes straight through.
Only the others shuffle. False positives cost a shuffle of one row and never change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.llm.hot import lookup_groups

#: bits of one bitmap value in Spark's bitmap functions
BITMAP_BITS = 32768


def _positions(text: Column, bits: int) -> list[Column]:
    h = F.xxhash64(text)
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two of about ``bits_per_row`` bits a row, at most ``max_bits``."""
    return min(max_bits, max(BITMAP_BITS, 1 << (max(1, rows) * bits_per_row - 1).bit_length()))


def repeated_positions(texts: DataFrame, text: Column, bits: int) -> DataFrame:
    """``(bucket, bitmap)``: the filter of all positions that at least two rows have set, ``bits / 32768`` rows at most."""
    counted = (
        texts.select(F.explode(F.array(*_positions(text, bits))).alias("p"))
        .groupBy("p")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    return counted.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bitmap")
    )


def possibly_repeated(
    docs: DataFrame, text_col: str, bits_per_row: int = 16, max_filter_bits: int = 1 << 28
) -> DataFrame:
    """``docs`` and ``__repeated``: false only where no other row has the same text (null counts as empty).

    The filter is broadcast; ``max_filter_bits`` (32 MB by default) bounds it. Beyond its capacity more rows test
    true, so more of them shuffle, and results stay the same.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = filter_bits(docs.count(), bits_per_row, max_filter_bits)
    filters = repeated_positions(docs, text, bits)
    out = docs
    for k, position in enumerate(_positions(text, bits)):
        side = F.broadcast(filters.select(F.col("bucket").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}")))
        out = out.withColumn(f"__p{k}", position)
        out = out.join(side, F.expr(f"bitmap_bucket_number(__p{k} + 1)") == F.col(f"__b{k}"), "left")
    tests = []
    for k in range(2):
        byte = f"cast(conv(hex(substring(__m{k}, cast(__p{k} % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
        tests.append(F.expr(f"coalesce(shiftright({byte}, cast(__p{k} % 8 as int)) & 1 = 1, false)"))
    return out.select(*[docs[c] for c in docs.columns], (tests[0] & tests[1]).alias("__repeated"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty, so null and empty texts form one group. The row with the
    largest id stays; a null id is smaller than any other; of rows that share text and id one stays. An empty table
    gives an empty table. Rows that may be repeated are staged once in the shared folder with their other columns, so
    that the numbers that tell equal ids apart are drawn once; groups with many rows meet their result without an
    exchange. Columns of ``docs`` named like a result are replaced.
    """
    results = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*results)
    own = docs.columns
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    tested = possibly_repeated(docs, text_col, bits_per_row, max_filter_bits)
    alone = tested.where(~F.col("__repeated")).select(
        *own, F.col(id_col).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        digest.alias("text_sha256"),
    )
    maybe = stage(
        tested.where("__repeated").select(*own, digest.alias("text_sha256"), F.monotonically_increasing_id().alias("__row")),
        "exact-candidates",
    )
    groups = (
        maybe.groupBy("text_sha256")
        .agg(F.max(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1")
    )
    row = F.coalesce(F.col("__first.row"), F.col("__row"))
    return alone.unionByName(
        lookup_groups(maybe, groups, "text_sha256", "__n", maybe.count()).select(
            *own,
            F.when(F.col("__n").isNull(), F.col(id_col)).otherwise(F.col("__first.id")).alias("keep_id"),
            F.coalesce(F.col("__n"), F.lit(1).cast("bigint")).alias("group_size"),
            (row == F.col("__row")).alias("kept"),
            "text_sha256",
        )
    )
