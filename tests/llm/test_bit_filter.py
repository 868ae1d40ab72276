from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.llm.bit_filter import key_filter
from packloom.llm.near_dedup import features, node_sets


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = stage(spark.range(1000).select(F.xxhash64(F.col("id") * 7).alias("key")), "keys")
    rows = spark.range(20_000).select("id", F.lit("x").alias("__bit_0"))
    sure, may = key_filter(keys, F.col("key")).split(rows, F.xxhash64("id"))
    passed = {r.id for r in may.collect()}
    assert {n * 7 for n in range(1000)} <= passed and len(passed) < 1000 + 0.05 * 20_000
    assert passed | {r.id for r in sure.collect()} == set(range(20_000)) and may.count() + sure.count() == 20_000


def test_an_empty_or_full_filter(spark):
    rows = spark.range(50)
    none = stage(spark.range(0).select(F.xxhash64("id").alias("key")), "keys")
    sure, may = key_filter(none, F.col("key")).split(rows, F.xxhash64("id"))
    assert sure.count() == 50 and may.count() == 0
    many = stage(spark.range(100_000).select(F.xxhash64("id").alias("key")), "keys")
    sure, may = key_filter(many, F.col("key"), max_bits=32768).split(rows, F.xxhash64("id"))
    assert sure.count() == 0 and may.count() == 50


def test_texts_are_read_where_they_lie(spark, plan_of):
    docs = spark.createDataFrame([(n, " ".join(f"w{n % 5}{k}" for k in range(9))) for n in range(40)], "doc_id bigint, text string")
    seen = stage(features(docs, "doc_id", "text", 25, 5, 5), "features")
    nodes = stage(seen.groupBy("node").agg(F.min("id").alias("id")), "nodes")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = node_sets(docs, nodes, "doc_id", "text", 5)
        plan = plan_of(sets)
        assert sets.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    below = plan[plan.index("MapInPandas") :]
    texts = [line for line in below.splitlines() if "Exchange" in line and "text" in line]
    assert not texts
