"""Stored experts and the catalog that says which domain each belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.staging import complete, delete

COUNTS = ("expert", "order", "ctx2", "ctx1", "tok")
STORED = "`order` int, ctx2 int, ctx1 int, tok int, n bigint, expert string, step int"


def domain_of_path(path: Column) -> Column:
    """Third path element from the end, text after its last ``_domain_``."""
    return F.substring_index(F.try_element_at(F.split(path, "/"), F.lit(-3)), "_domain_", -1)


def expert_catalog(paths: DataFrame, path: str = "path", given: str | None = None) -> DataFrame:
    """Adds ``domain``: the given name where there is one, else the one in the path."""
    derived = domain_of_path(F.col(path))
    return paths.withColumn("domain", derived if given is None else F.coalesce(F.col(given), derived))


def write_expert(counts: DataFrame, path: str, step: int | None = None, mode: str = "append") -> None:
    """Store count tables under ``expert=…/step=…``; without ``step`` every row has its own in a column ``step``."""
    stepped = counts if step is None else counts.withColumn("step", F.lit(step))
    stepped.write.mode(mode).partitionBy("expert", "step").parquet(path)


def read_experts(spark: SparkSession, path: str, members: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Load an ensemble in one scan; ``members`` are (expert, step) pairs, which prune folders."""
    stored = spark.read.parquet(path).withColumn("expert", F.col("expert").cast("string"))
    if members is not None:
        chosen = F.lit(False)
        for expert, step in members:
            chosen = chosen | ((F.col("expert") == expert) & (F.col("step") == step))
        stored = stored.where(chosen)
    return stored.select("expert", "step", "order", "ctx2", "ctx1", "tok", "n")


def write_deltas(deltas: DataFrame, path: str, mode: str = "append") -> None:
    """Store ``(step, expert, order, ctx2, ctx1, tok, n)``, what each step adds, under ``deltas/expert=…/step=…``."""
    deltas.write.mode(mode).partitionBy("expert", "step").parquet(f"{path}/deltas")


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Steps up to which deltas are folded, from complete bases alone."""
    return sorted(int(name.rpartition("=")[2]) for name in complete(spark, f"{path}/bases/upto=*"))


def read_snapshot(spark: SparkSession, path: str, step: int) -> DataFrame:
    """``(expert, order, ctx2, ctx1, tok, n)`` as of ``step``: the newest base up to it and the deltas since.

    Folders of other steps are pruned. A step whose deltas have been folded into a later base raises an error.
    """
    folded = _bases(spark, path)
    if folded and step < folded[0]:
        raise ValueError(f"step {step} has been folded into step {folded[0]}")
    base = max((b for b in folded if b <= step), default=None)
    deltas = spark.read.schema(STORED).parquet(f"{path}/deltas").where(F.col("step") <= step)
    if base is not None:
        before = spark.read.schema(STORED).parquet(f"{path}/bases/upto={base}")
        deltas = deltas.where(F.col("step") > base).unionByName(before)
    return deltas.groupBy(*COUNTS).agg(F.sum("n").alias("n"))


def compact_snapshots(spark: SparkSession, path: str, step: int) -> None:
    """Fold all deltas up to ``step`` into one base, and delete them and older bases once it is complete.

    Readers use the base from the moment it is complete, so a run that is cut short leaves no step counted twice.
    """
    whole = read_snapshot(spark, path, step).withColumn("step", F.lit(step))
    whole.write.mode("overwrite").partitionBy("expert").parquet(f"{path}/bases/upto={step}")
    for old in _bases(spark, path):
        if old < step:
            delete(spark, f"{path}/bases/upto={old}")
    names = spark.read.schema(STORED).parquet(f"{path}/deltas").where(F.col("step") <= step)
    for row in names.select(F.col("_metadata.file_path").alias("file")).distinct().toLocalIterator():
        delete(spark, row["file"].rpartition("/")[0])
