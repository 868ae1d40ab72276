"""Packed files whose content can be proven.

Beside the files lies a manifest with the rows and an order-free digest that each file must have, worked out from the rows
before they are written. Reading the files back tells which are missing, changed or not listed; a damaged file is built
again alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.index import join_null_safe
from packloom.sources.packed import FOLDERS, STORED, bound_listing, write_packed

PLACE = (*FOLDERS, "file")
LISTED = "domain string, split string, rank int, file bigint, n_rows bigint, digest decimal(38,0)"


def row_digest() -> Column:
    """60 bits of a row's md5 over its keys and ids, as a number."""
    ids = [F.array_join(F.col(c).cast("array<string>"), " ") for c in ("input_ids", "label")]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("domain", "split", "rank", "chunk", "seq_id")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys, *ids)), 1, 15), 16, 10).cast("decimal(38,0)")


def file_digests(rows: DataFrame) -> DataFrame:
    """``(domain, split, rank, file, n_rows, digest)``: sums of the rows' digests, which no order of rows changes."""
    return rows.groupBy(*PLACE).agg(F.count("*").alias("n_rows"), F.sum(row_digest()).cast("decimal(38,0)").alias("digest"))


def with_file(df: DataFrame, samples_per_file: int) -> DataFrame:
    """Adds ``file``, the place that ``write_packed`` gives a row."""
    return df.withColumn("file", F.call_function("div", F.col("chunk"), F.lit(samples_per_file).cast("bigint")))


def write_verified(df: DataFrame, path: str, samples_per_file: int) -> None:
    """Write packed rows like ``write_packed``, and first the manifest ``path/_digests`` that says what must be there."""
    file_digests(with_file(df, samples_per_file)).write.mode("overwrite").parquet(f"{path}/_digests")
    write_packed(df, path, samples_per_file, "append")


def verified_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, split, rank, file, n_rows, digest, status)`` of all files listed or found.

    ``status`` is ok, missing, changed, or unlisted; rows and digest are those of the manifest, of an unlisted file its own.
    """
    bound_listing(spark)
    listed = spark.read.schema(LISTED).parquet(f"{path}/_digests")
    files = spark.read.schema(f"{STORED}, file bigint").parquet(path)
    sides = listed.select("*", F.lit(True).alias("is_listed")).unionByName(file_digests(files).select("*", F.lit(False).alias("is_listed")))
    told = sides.groupBy(*PLACE).agg(
        *[F.max(F.when(F.col("is_listed") == side, F.struct("n_rows", "digest"))).alias(name) for name, side in (("due", True), ("has", False))]
    )
    status = (
        F.when(F.col("due").isNull(), "unlisted").when(F.col("has").isNull(), "missing").when(F.col("due") == F.col("has"), "ok").otherwise("changed")
    )
    shown = F.coalesce("due", "has")
    return told.select(*PLACE, shown["n_rows"].alias("n_rows"), shown["digest"].alias("digest"), status.alias("status"))


def rebuild_damaged(df: DataFrame, path: str, samples_per_file: int) -> int:
    """Write again, from the packed rows ``df``, just the files that are missing or changed; returns their number.

    Each file has a folder of its own, so only those folders are replaced. Unlisted files stay, named by the manifest.
    """
    spark = df.sparkSession
    bad = verified_manifest(spark, path).where(F.col("status").isin("missing", "changed")).select(*PLACE)
    damaged = spark.createDataFrame(bad.collect(), bad.schema)
    number = damaged.count()
    if number:
        marked = damaged.withColumn("__damaged", F.lit(True))
        rows = join_null_safe(with_file(df, samples_per_file), marked, PLACE, "inner").drop("__damaged")
        narrow = rows.withColumns({c: F.col(c).cast("array<int>") for c in ("input_ids", "label")})
        writer = narrow.repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*PLACE).parquet(path)
    return number
