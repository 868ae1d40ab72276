"""A training-data pipeline: every stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.llm import decontam, exact_dedup, near_dedup, packing, quality
from packloom.llm.bit_filter import key_filter
from packloom.llm.queries import END_ID, TOKENIZER, WINDOW_TOKENS


def _apart(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside one column that holds all others, so that no result can hide one of them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0)]).alias("__others"))


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, as they were."""
    own = [F.col(c) if c in ("doc_id", "text") else F.col("__others").getField(c).alias(c) for c in docs.columns]
    return rows.select(*own)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among ``docs``."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as_before(quality.with_quality(_apart(docs), net).where("predicted = 1"), docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _as_before(exact_dedup.exact_dedup(_apart(docs)).where("kept"), docs)


def one_of_each_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    A row's id and text tell what was decided on it: ids may be null or repeated. Only rows that a bit filter of the
    dropped ones lets through meet these by an exchange; all others stay where they are.
    """
    told = _apart(docs).withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = near_dedup.near_dedup(told, carried=["__digest"])
    dropped = stage(judged.where("not kept").select(F.col("id").alias("__id"), F.col("__digest").alias("__dropped")), "near-dropped")
    sure, doubtful = key_filter(dropped, F.xxhash64("__dropped", "__id")).split(told, F.xxhash64("__digest", "doc_id"))
    same = (F.col("__digest") == F.col("__dropped")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return _as_before(sure.unionByName(doubtful.join(dropped, same, "left_anti")), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontam.judged(decontam.find_benchmark(_apart(docs), benchmark))
    return _as_before(judged.where("not contaminated"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of bounded length."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), WINDOW_TOKENS, END_ID)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", first_copies),
    ("near dedup", one_of_each_kind),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
