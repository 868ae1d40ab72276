import math

import pytest
from pyspark.sql import functions as F

from packloom.functions.staging import fresh_path
from packloom.operators.metrics import cosine_rate, metrics_rollup, warmup_rate
from packloom.sources import corpus, experts, packed


def test_corpus_is_pruned_to_one_domain_and_split(spark, plan_of):
    path = fresh_path(spark, "corpus")
    rows = [(i, "ab"[i % 2], "train" if i < 6 else "test", f"t{i}", "x") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, split string, body string, more string")
    df.write.partitionBy("domain", "split").parquet(path)
    got = corpus.select_text(corpus.read_corpus(spark, path, "b", "train"), "body", "doc_id")
    assert sorted(map(tuple, got.collect())) == [(1, "t1"), (3, "t3"), (5, "t5")]
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(domain" in plan and "ReadSchema: struct<doc_id:bigint,body:string>" in plan
    assert corpus.read_corpus(spark, path).count() == 8


def packed_rows(spark, n=1000, ranks=2):
    ids = F.array(F.col("id").cast("int"), F.lit(1))
    return spark.range(0, n * ranks, 1, 8).select(
        F.when(F.col("id") % 2 == 1, F.lit("01")).alias("domain"),
        F.lit("train").alias("split"),
        (F.col("id") % ranks).cast("int").alias("rank"),
        F.expr(f"id div {ranks}").alias("chunk"),
        F.col("id").alias("seq_id"),
        ids.alias("input_ids"),
        ids.alias("label"),
    )


@pytest.mark.parametrize("cap,sizes", [(300, [100, 300, 300, 300]), (0, None), (-1, None)])
def test_files_are_filled_listed_and_read_back_with_their_rank(spark, cap, sizes):
    path = fresh_path(spark, "packed")
    packed.write_packed(packed_rows(spark), path, cap)
    listed = packed.manifest(spark, path).collect()
    if sizes:
        assert sorted(r.n_rows for r in listed) == sorted(sizes * 2)
        assert {r.first_chunk % cap for r in listed} == {0}
    back = packed.read_packed(spark, path, "domain=*/split=*/rank=1")
    assert {(r["rank"], r.domain) for r in back.select("rank", "domain").distinct().collect()} == {(1, "01")}
    assert dict(back.dtypes)["input_ids"] == "array<bigint>" and back.count() == 1000
    whole = packed.read_packed(spark, path)
    assert whole.count() == 2000 and whole.where("domain is null").count() == 1000
    assert dict(spark.read.parquet(path).dtypes)["label"] == "array<int>"
    target = fresh_path(spark, "manifest")
    packed.write_manifest(spark, path, target)
    assert {r.value for r in spark.read.text(target).collect()} == {r.file_path for r in listed}


def test_overwrite_replaces_and_absent_leaves_alone(spark):
    path = fresh_path(spark, "target")
    packed.write_if_absent(spark.range(3), path)
    packed.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    packed.write_overwrite(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9


def test_domain_of_an_expert_path(spark):
    rows = [
        ("runs/x/train_iter3_X_expert_m_domain_TinyTales/checkpoints/model_400.bin", None),
        ("runs/x/train_iter3_X_expert_m_domain_TinyTales/checkpoints/model_400.bin", "given"),
        ("runs/a_domain_b_domain_c/checkpoints/model.bin", None),
        ("plain/checkpoints/model.bin", None),
    ]
    df = spark.createDataFrame(rows, "path string, given string")
    assert [r.domain for r in experts.expert_catalog(df, "path", "given").collect()] == [
        "TinyTales", "given", "c", "plain",
    ]


def test_experts_come_back_by_name_and_step(spark):
    path = fresh_path(spark, "experts")
    schema = "expert string, `order` int, ctx2 int, ctx1 int, tok int, n bigint"
    for step in (300, 400):
        rows = [(e, 1, None, 2, 3, step + i) for i, e in enumerate(("1", "2"))]
        experts.write_expert(spark.createDataFrame(rows, schema), path, step)
    got = experts.read_experts(spark, path, [("1", 400), ("2", 300)]).collect()
    assert sorted((r.expert, r.step, r.n) for r in got) == [("1", 400, 400), ("2", 300, 301)]
    assert experts.read_experts(spark, path).count() == 4


def test_rollup_reports_complete_intervals_and_rank_zero_time(spark):
    rows = [(r, m, float(10 * r + m), float(r + 1)) for r in range(2) for m in range(10)]
    df = spark.createDataFrame(rows, "rank int, micro bigint, loss double, seconds double")
    got = sorted(tuple(r) for r in metrics_rollup(df, interval=2, accum=2, world=2).collect())
    expected = []
    for i in range(2):
        losses = [loss for _, m, loss, _ in rows if m // 4 == i]
        expected.append((2 * (i + 1), sum(losses) / 2 / 2 / 2, 4 * 1.0 / 2))
    assert got == expected


def test_learning_rates(spark):
    def rate(s):
        if s < 4:
            return 1.0 * (s + 1) / 4
        return 0.1 if s >= 10 else 0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * (s - 4) / 6))

    steps = spark.range(14).select(
        F.col("id").alias("s"),
        warmup_rate(F.col("id"), 1.0, 4).alias("w"),
        cosine_rate(F.col("id"), 1.0, 0.1, 4, 10).alias("c"),
    )
    for r in steps.collect():
        assert r.w == pytest.approx(min(1.0, (r.s + 1) / 4)) and r.c == pytest.approx(rate(r.s))


def test_listing_starts_no_task_for_each_folder(spark, tmp_path):
    """Each packed file has a folder; a bounded number of tasks lists them all."""
    path = str(tmp_path / "p")
    df = spark.range(90).select(F.lit("a").alias("domain"), F.lit("train").alias("split"), F.lit(0).alias("rank"), F.col("id").alias("chunk"), F.col("id").alias("seq_id"))
    ids = F.array(F.lit(1).cast("bigint"))
    packed.write_packed(df.withColumns({"input_ids": ids, "label": ids}), path, 2)
    before = spark.conf.get(packed.LISTING)
    for read in (lambda: packed.read_packed(spark, path).count(), lambda: packed.manifest(spark, path).agg(F.sum("n_rows")).first()[0]):
        spark.conf.set(packed.LISTING, 10_000)
        assert read() == 90 and int(spark.conf.get(packed.LISTING)) <= 32
    spark.conf.set(packed.LISTING, before)
