"""Intermediate tables that several branches of one plan read.

A staged table is parquet in the shared folder named by ``spark.checkpoint.dir``: it survives the loss of any
executor, cuts the lineage, keeps column pruning, and gives the planner true sizes. The tables of one application lie
in one folder, ``packloom-<application id>``, which can be deleted when it has ended.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: where each staged table lies
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster must name one. Where a local master has none, this session gets one folder and names it from then on.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="packloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/packloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    return staged


def stage_together(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """``stage`` rows that are partitioned by ``keys`` so that Spark knows it: grouping them by these exchanges nothing.

    One bucket for each shuffle partition; rows keep their order within a bucket. The catalog's entry, which a bucketed
    table needs to be read, is dropped at once; the files stay.
    """
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"packloom_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    writer.option("path", path).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    _PATHS[staged] = path
    return staged


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and all below it, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def complete(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a glob pattern whose writing Spark's committer has marked as finished."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return [status.getPath().getParent().toString() for status in found or ()]


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: the very DataFrames that ``stage`` gave."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            delete(table.sparkSession, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; DataFrames that still read it fail from then on."""
    delete(spark, f"{shared_dir(spark)}/packloom-{spark.sparkContext.applicationId}")
