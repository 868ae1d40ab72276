"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.staging import fresh_path
from packloom.llm import (
    decontam,
    exact_dedup,
    html_text,
    language,
    lexical_search,
    licenses,
    near_dedup,
    packing,
    phrases,
    quality,
    secrets,
    sharding,
    token_store,
)

SHARDS = 16
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
WINDOW_TOKENS = 2048


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    base = [r.kind for r in secrets.BASE_RULES]
    return found.select(
        "doc_id",
        *[secrets.count_kind(F.col("secrets"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.spans_text(F.col("secrets"), base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets")).alias("spans"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.judged(decontam.find_benchmark(_documents(spark, sf_dir), benchmark))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs, net).select("doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licenses(_documents(spark, sf_dir))
    told = F.transform(
        "licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["coverage"], 4).cast("string"), x["start"], x["end"])
    )
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_notices"), F.array_join(told, ",").alias("notices"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), END_ID)
    stored = token_store.read_tokens(spark, path)
    return stored.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.with_main_text(pages).select("page_id", "url", "text", "n_chars")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), WINDOW_TOKENS, END_ID)
    return packed.withColumnRenamed("id", "doc_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.with_shards(_documents(spark, sf_dir), sharding.even_tree(SHARDS))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    grown = sharding.shard_of(key, sharding.even_tree(SHARDS + 1)).cast("int")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = language.with_language(docs.drop("lang"), language.fit(docs))
    return judged.select("doc_id", language.is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(_documents(spark, sf_dir), benchmark).withColumnRenamed("id", "doc_id")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_near_dedup,
        op3_decontamination,
        op4_quality,
        op5_license_scan,
        op6_token_ids,
        op7_html_text,
        op8_packing,
        op9_sharding,
        op10_exact_dedup,
        op11_language,
        op12_lexical_search,
        op13_phrases,
    )
}
