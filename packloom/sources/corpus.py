"""Text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, domain: str | None = None, split: str | None = None) -> DataFrame:
    """A parquet corpus, restricted to one domain and one split where those are columns.

    On a corpus partitioned by ``domain`` and ``split`` the filters prune folders; else they are pushed to the scan.
    """
    corpus = spark.read.parquet(path)
    if domain is not None:
        corpus = corpus.where(F.col("domain") == domain)
    if split is not None:
        corpus = corpus.where(F.col("split") == split)
    return corpus


def select_text(df: DataFrame, textfield: str, *keep: str) -> DataFrame:
    """Any named string column becomes ``text``; only the kept columns travel with it."""
    return df.select(*keep, F.col(textfield).alias("text"))
