"""A packed corpus that grows batch by batch, each packed from where the one before it ended.

Below the store's folder lie, for each batch, ``packed/batch=k`` with its windows, ``tails/batch=k`` with the tokens that
every rank has left over, and ``documents/batch=k`` with the number of documents so far. The last is written last: a
batch counts once that table is complete, and a batch cut short is written anew. No batch reads the windows of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions.index import join_null_safe, key_bounds
from packloom.functions.staging import complete, stage
from packloom.operators.tokens import DOMAIN, RANK, label_shift, lay_out, range_starts, windows

WINDOWS = "domain string, split string, rank int, chunk bigint, tokens array<int>"


def finished_batches(spark: SparkSession, path: str) -> int:
    """How many batches the store has; what a crashed one left behind does not count."""
    return len(complete(spark, f"{path}/documents/batch=*"))


def carry_state(spark: SparkSession, path: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """``(domain, split, docs, seq_len, world_size)`` and ``(domain, split, rank, chunk, tokens)`` after ``batch``.

    ``chunk`` is the rank's next window, which the left-over ``tokens`` begin.
    """
    counted = spark.read.parquet(f"{path}/documents/batch={batch}")
    return counted, spark.read.schema(WINDOWS).parquet(f"{path}/tails/batch={batch}")


def batch_windows(
    encoded: DataFrame, key: str, seq_len: int, world_size: int, counted: DataFrame | None, tails: DataFrame | None
) -> DataFrame:
    """All windows that a batch completes or leaves open, ``(domain, split, rank, chunk, n, tokens)``.

    ``encoded (key, domain, split, n_tokens, digest, ids)`` holds the batch's documents, stored, in key order after
    those of earlier batches. ``counted`` and ``tails`` are the state before it, one row per domain and per rank.
    """
    order = [key, "n_tokens", "digest"]
    bounds = key_bounds(encoded, order)
    tokens = None
    if tails is not None:
        tokens = tails.select(*RANK, (F.col("chunk") * F.lit(seq_len) + F.size("tokens")).cast("bigint").alias("tokens"))
    starts = range_starts(encoded.select(*order, *DOMAIN), order, bounds, world_size, seq_len, counted, tokens)
    laid_out = lay_out(encoded.select(*order, *DOMAIN, "ids"), starts, order, bounds, world_size)
    return windows(laid_out.withColumn("first_seq", F.lit(0).cast("bigint")), seq_len, tails).drop("first_seq")


def append_packed(encoded: DataFrame, path: str, key: str, seq_len: int, world_size: int) -> int:
    """Pack the documents of ``encoded`` as the store's next batch; returns its number, from 0.

    Documents take up the index, rank and token stream where the store's last batch ended, so the windows are those of
    packing all batches at once, as long as keys rise from batch to batch. Work and reading grow with the batch and the
    number of ranks, not with the store. Empty documents use up an index; an empty batch leaves the state as it was.
    A store keeps its window length and number of ranks; others raise an error. One writer at a time.
    """
    spark = encoded.sparkSession
    batch = finished_batches(spark, path)
    counted = tails = None
    if batch:
        counted, tails = carry_state(spark, path, batch - 1)
        settings = counted.select("seq_len", "world_size").distinct().collect()
        if any(tuple(row) != (seq_len, world_size) for row in settings):
            raise ValueError("the store has another window length or number of ranks")
    made = stage(batch_windows(encoded, key, seq_len, world_size, counted, tails), "batch-windows")
    full = F.col("n") == seq_len + 1
    made.where(full).drop("n").write.mode("overwrite").parquet(f"{path}/packed/batch={batch}")
    made.where(~full).drop("n").write.mode("overwrite").parquet(f"{path}/tails/batch={batch}")
    here = encoded.groupBy(*DOMAIN).agg(F.count("*").alias("docs"))
    if counted is not None:
        here = here.unionByName(counted.select(*DOMAIN, "docs")).groupBy(*DOMAIN).agg(F.sum("docs").alias("docs"))
    settled = here.withColumns({"seq_len": F.lit(seq_len), "world_size": F.lit(world_size)})
    settled.write.mode("overwrite").parquet(f"{path}/documents/batch={batch}")
    return batch


def read_grown(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, split, rank, chunk, seq_id, input_ids, label)`` of all finished batches.

    ``seq_id`` follows from rank and chunk: the last state tells how many windows the ranks before have. A store
    without a batch raises an error.
    """
    batches = finished_batches(spark, path)
    if not batches:
        raise ValueError("the store has no finished batch")
    counted, tails = carry_state(spark, path, batches - 1)
    before = Window.partitionBy(*DOMAIN).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    first = tails.select(*RANK, F.coalesce(F.sum("chunk").over(before), F.lit(0).cast("bigint")).alias("first_seq"))
    length = counted.select("seq_len").first()
    paths = [f"{path}/packed/batch={b}" for b in range(batches)]
    numbered = join_null_safe(spark.read.schema(WINDOWS).parquet(*paths), first, RANK, "inner")
    rows = numbered.select(*RANK, "chunk", (F.col("first_seq") + F.col("chunk")).alias("seq_id"), "tokens")
    return label_shift(rows, length["seq_len"] if length else 1)
