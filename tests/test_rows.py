from collections import Counter

import pytest
from pyspark.sql import functions as F

from packloom.operators import rows as R


def test_empty_text_is_dropped_but_uses_an_index(spark):
    texts = [(0, None), (1, ""), (2, " "), (3, "one"), (4, "a longer text")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    sharded = R.drop_empty(R.shard(R.with_index(df, ["doc_id"]), 2))
    assert {(r.doc_id, r["rank"]) for r in sharded.collect()} == {(2, 0), (3, 1), (4, 0)}
    one = R.shard(R.with_index(df, ["doc_id"]), 2, rank=1)
    assert {r.doc_id for r in one.collect()} == {1, 3}


def test_split_is_stable_and_near_its_weights(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    split = R.split_corpus(df, "k")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 5000
    assert 3850 < sizes["train"] < 4150 and 400 < sizes["validation"] < 600 and 400 < sizes["test"] < 600
    again = R.split_corpus(df.repartition(7), "k")
    assert split.exceptAll(again).isEmpty()


def test_shuffle_keeps_rows_and_follows_the_draw_over_all_shards(spark, plan_of):
    df = spark.range(1000).withColumnRenamed("id", "k")
    shuffled = R.shuffle_rows(df, "k", 5, 6)
    placed = shuffled.select("k", F.spark_partition_id().alias("p"), R.shuffle_key("k", 5).alias("draw")).collect()
    assert sorted(r.k for r in placed) == list(range(1000))
    assert [r.draw for r in placed] == sorted(r.draw for r in placed)
    assert {r.p for r in placed} == set(range(6)) and max(Counter(r.p for r in placed).values()) < 230
    assert [r.k for r in placed] != list(range(1000))
    assert plan_of(shuffled).count("Exchange") == 1


def test_reshard_fills_all_shards_evenly(spark):
    df = R.with_index(spark.range(100).withColumnRenamed("id", "k"), ["k"])
    sizes = R.reshard(df, 7, "index").groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in sizes) == [14, 14, 14, 14, 14, 15, 15]
    assert R.reshard(df, 3).rdd.getNumPartitions() == 3


def sequences(spark, n, ranks=1):
    rows = [("d", "train", r, c, c) for r in range(ranks) for c in range(n)]
    return spark.createDataFrame(rows, "domain string, split string, rank int, chunk bigint, seq_id bigint")


def cycle(n, batch_size, steps, accum):
    """What a loop over epochs uses: (sequence, epoch, micro, step)."""
    used, micro, epoch = [], 0, 0
    while n and micro < steps * accum:
        for first in range(0, n, batch_size):
            if micro == steps * accum:
                break
            used += [(s, epoch, micro, micro // accum + 1) for s in range(first, min(first + batch_size, n))]
            micro += 1
        epoch += 1
    return used


@pytest.mark.parametrize(
    "n,batch_size,steps,accum", [(10, 3, 5, 2), (7, 7, 4, 1), (50, 4, 3, 2), (5, 10, 9, 3), (0, 3, 2, 2)]
)
def test_schedule_equals_the_loop(spark, n, batch_size, steps, accum):
    df = sequences(spark, n)
    planned = R.training_schedule(df, steps, accum, batch_size)
    got = sorted((r.seq_id, r.epoch, r.micro, r.step) for r in planned.collect())
    expected = cycle(n, batch_size, steps, accum)
    assert got == sorted(expected)
    seen = {r.seq_id: r.times_seen for r in R.times_seen(df, F.lit(steps), accum, batch_size).collect()}
    assert seen == dict(Counter(s for s, *_ in expected))
    half = R.snapshot(planned, steps // 2)
    assert half.count() == sum(1 for *_, step in expected if step <= steps // 2)


def test_batches_keep_the_short_last_one_and_the_limit_counts_one_more(spark):
    batched = R.assign_batches(sequences(spark, 25, 2), 4)
    sizes = {(r["rank"], r.batch_id): r["count"] for r in batched.groupBy("rank", "batch_id").count().collect()}
    assert sizes[(0, 6)] == 1 and sizes[(1, 0)] == 4 and len(sizes) == 14
    tens = spark.range(10).withColumnRenamed("id", "batch_id")
    assert [R.limit_eval_batches(tens, s).count() for s in (-1, 0, 3)] == [10, 10, 4]


def test_first_sequences_of_every_domain(spark):
    rows = [(d, "test", s) for d, n in (("a", 2), ("b", 9)) for s in range(n)]
    df = spark.createDataFrame(rows, "domain string, split string, seq_id bigint")
    kept = Counter(r.domain for r in R.first_sequences(df, 5).collect())
    assert kept == {"a": 2, "b": 5}


def test_null_groups_are_scheduled_too(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), ("a", 0)], "domain string, chunk bigint")
    seen = R.times_seen(df, F.lit(2), 1, 1, ["domain"]).collect()
    assert sorted((r.domain or "", r.chunk, r.times_seen) for r in seen) == [("", 0, 1), ("", 1, 1), ("a", 0, 2)]


def test_snapshots_equal_the_schedule_cut_off(spark):
    df = sequences(spark, 23, 2)
    planned = R.training_schedule(df, 9, 2, 3)
    got = {(r["rank"], r.seq_id, r.snapshot): (r.times_seen, r.last_micro) for r in R.snapshots(df, (2, 5, 9), 2, 3).collect()}
    expected = {}
    for s in (2, 5, 9):
        for r in R.snapshot(planned, s).groupBy("rank", "seq_id").agg(F.count("*").alias("n"), F.max("micro").alias("m")).collect():
            expected[(r["rank"], r.seq_id, s)] = (r.n, r.m)
    assert got == expected


def test_rows_of_files_get_a_key(spark, tmp_path):
    spark.range(0, 50, 1, 3).write.parquet(str(tmp_path / "t"))
    keyed = R.with_row_key(spark.read.parquet(str(tmp_path / "t")))
    rows = R.with_index(keyed, ["file_path", "row_index"]).collect()
    assert sorted(r["index"] for r in rows) == list(range(50))


def test_composite_shuffle_key_and_parts_of_a_shard(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("a"), "id")
    shuffled = R.shuffle_rows(df, ("a", "id"), 1, 4, 3)
    placed = shuffled.select("shard", F.spark_partition_id().alias("p")).collect()
    assert len(placed) == 600 and {r.p for r in placed} == set(range(12)) and all(r.shard == r.p // 3 for r in placed)
