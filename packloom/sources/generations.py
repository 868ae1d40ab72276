"""Tables published as generations: written beside the one in use, then made current by one small file.

``path/data/…`` holds a folder per generation and ``path/pointers/n`` names the folder of generation n. A pointer is created
in one step after its data is complete; the greatest one tells the current generation. So a job may overwrite the table that
it reads, readers never see half a table, and what a crashed write leaves behind is not taken for a prepared target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from packloom.functions.staging import delete


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published generations, in order."""
    folder, store = _folder(spark, f"{path}/pointers")
    return sorted(int(s.getPath().getName()) for s in store.listStatus(folder)) if store.exists(folder) else []


def is_published(spark: SparkSession, path: str) -> bool:
    return bool(pointers(spark, path))


def _data_of(spark: SparkSession, path: str, generation: int) -> str:
    name = spark.read.text(f"{path}/pointers/{generation:09d}").first()["value"]
    return f"{path}/data/{name}"


def read_published(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The current generation, or an earlier one that is still there; a table never published raises an error.

    The DataFrame stays with the generation it was opened on, also when a later one becomes current.
    """
    known = pointers(spark, path)
    if not known:
        raise ValueError(f"nothing has been published at {path}")
    return spark.read.parquet(_data_of(spark, path, known[-1] if generation is None else generation))


def publish(df: DataFrame, path: str, *partition_by: str) -> int:
    """Write ``df`` as the next generation and make it current; returns its number. ``df`` may read the table itself.

    Of two writers that start from the same generation the second one fails, and its data is removed.
    """
    spark = df.sparkSession
    number = max(pointers(spark, path), default=-1) + 1
    name = f"{number}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/data/{name}")
    pointer, store = _folder(spark, f"{path}/pointers/{number:09d}")
    try:
        made = store.create(pointer, False)
    except Exception:
        delete(spark, f"{path}/data/{name}")
        raise
    made.write(bytearray(name.encode()))
    made.close()
    return number


def publish_if_absent(df: DataFrame, path: str, *partition_by: str) -> bool:
    """Publish unless a generation is there, whatever a crashed write has left; returns whether it did."""
    if is_published(df.sparkSession, path):
        return False
    publish(df, path, *partition_by)
    return True


def retire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the last ``keep`` generations and whatever crashed writes have left. Nobody may be writing."""
    known = pointers(spark, path)
    kept = {_data_of(spark, path, n).rpartition("/")[2] for n in known[-keep:]}
    for number in known[:-keep]:
        delete(spark, f"{path}/pointers/{number:09d}")
    folder, store = _folder(spark, f"{path}/data")
    for status in store.listStatus(folder):
        if status.getPath().getName() not in kept:
            delete(spark, status.getPath().toString())
