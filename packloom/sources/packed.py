"""Packed sequences on disk: fixed schema, folders by domain, split and rank, filled files of bounded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("domain", "split", "rank")
STORED = (
    "domain string, split string, rank int, chunk bigint, seq_id bigint, input_ids array<int>, label array<int>"
)

#: tasks that list folders at once; Spark would start one for each folder, and every file has one
LISTING_TASKS = 32
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def bound_listing(spark: SparkSession) -> None:
    """Lower the session's tasks for listing folders to ``LISTING_TASKS``, or four for each core, where they are more."""
    most = max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)
    if int(spark.conf.get(LISTING)) > most:
        spark.conf.set(LISTING, most)


def read_packed(spark: SparkSession, path: str, folders: str = "") -> DataFrame:
    """The packed sequences below ``path``, or those in the folders matching a glob such as ``domain=de/split=*``.

    The folders' names are columns either way; token ids are widened to 64 bit.
    """
    bound_listing(spark)
    stored = spark.read.schema(STORED).option("basePath", path).parquet(f"{path}/{folders}" if folders else path)
    return stored.withColumns({c: F.col(c).cast("array<bigint>") for c in ("input_ids", "label")})


def write_packed(df: DataFrame, path: str, samples_per_file: int = 0, mode: str = "errorifexists") -> None:
    """32-bit ``input_ids`` and ``label`` with their keys under ``domain=…/split=…/rank=…`` folders.

    With a cap of n rows, folder ``file=k`` below them holds one file with the rank's windows k * n to
    (k + 1) * n - 1, so every file but a rank's last is full. 0 or less sets no cap and moves nothing.
    """
    narrow = df.withColumns({c: F.col(c).cast("array<int>") for c in ("input_ids", "label")})
    if samples_per_file > 0:
        place = F.call_function("div", F.col("chunk"), F.lit(samples_per_file).cast("bigint"))
        narrow = narrow.withColumn("file", place).repartition(*FOLDERS, "file")
    else:
        narrow = narrow.withColumn("file", F.lit(0).cast("bigint"))
    narrow.write.mode(mode).partitionBy(*FOLDERS, "file").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, split, rank, file_path, first_chunk, n_rows)``: one row per data file below ``path``."""
    bound_listing(spark)
    stored = spark.read.schema(STORED).parquet(path)
    return stored.groupBy(*FOLDERS, F.col("_metadata.file_path").alias("file_path")).agg(
        F.min("chunk").alias("first_chunk"), F.count("*").alias("n_rows")
    )


def write_zones(spark: SparkSession, path: str) -> None:
    """Store the zone map of the packed files below ``path`` in its folder ``_zones``, which readers of the files pass over.

    ``(domain, split, rank, file_path, first_seq, last_seq, first_chunk, last_chunk, n_rows)``: one row per file.
    """
    bound_listing(spark)
    stored = spark.read.schema(STORED).parquet(path)
    zones = stored.groupBy(*FOLDERS, F.col("_metadata.file_path").alias("file_path")).agg(
        F.min("seq_id").alias("first_seq"), F.max("seq_id").alias("last_seq"),
        F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"), F.count("*").alias("n_rows"),
    )
    zones.write.mode("overwrite").parquet(f"{path}/_zones")


def read_sequences(spark: SparkSession, path: str, first: int, last: int, by: str = "seq_id") -> DataFrame:
    """Rows ``first`` to ``last`` (inclusive) of every domain and split by ``seq_id``, or of every rank by ``chunk``.

    The zone map names the files that may have such a row, and only those are read; their names, which grow with what is
    asked for and not with the store, are what the driver sees. Files written after the zone map are not found.
    """
    zone = {"seq_id": "seq", "chunk": "chunk"}[by]
    zones = spark.read.parquet(f"{path}/_zones")
    hit = zones.where((F.col(f"last_{zone}") >= first) & (F.col(f"first_{zone}") <= last))
    files = sorted(row["file_path"] for row in hit.select("file_path").collect())
    if not files:
        return read_packed(spark, path).where(F.lit(False))
    stored = spark.read.schema(STORED).option("basePath", path).parquet(*files)
    asked = stored.where(F.col(by).between(first, last))
    return asked.withColumns({c: F.col(c).cast("array<bigint>") for c in ("input_ids", "label")})


def write_manifest(spark: SparkSession, path: str, target: str) -> None:
    """The file list as text, one path per line."""
    manifest(spark, path).select("file_path").write.text(target)


def write_overwrite(df: DataFrame, path: str) -> None:
    """Replace the target."""
    df.write.mode("overwrite").parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Leave a target that exists alone."""
    df.write.mode("ignore").parquet(path)
