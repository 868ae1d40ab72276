import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from packloom.llm import quality, queries, sql
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_tokens import ids_of

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def test_registered():
    names = [q.split("_")[0] for q in queries.QUERIES]
    assert names == [f"op{n}" for n in range(1, 14)]
    assert {*queries.QUERIES, "pipeline"} <= set(entry_point.queries())


def test_stages_keep_columns_and_act(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    before, packed = docs, None
    for name, function in corpus_pipeline.STAGES:
        after = function(spark, before, TABLES).cache()
        if name == "packing":
            packed = after
            break
        assert after.dtypes == docs.dtypes
        assert after.subtract(before).count() == 0 and 0 < after.count() <= before.count()
        before = after
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert packed.count() == corpus_pipeline.run(spark, TABLES).count()
    texts = [r.text for r in before.select("text").collect()]
    assert len(set(texts)) == len(texts)


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    net = quality.fit(spark.read.parquet(f"{TABLES}/documents.parquet"), labels)
    good = {i: t for i, t in docs.items() if net.score(t) >= 0.7}
    last = {t: i for i, t in sorted(good.items())}
    near = near_brute({i: t for t, i in last.items()})
    kept = [i for i, (_, component) in near.items() if i == component and not contaminated(docs[i], items)[3]]
    tokens = {}
    for r in corpus_pipeline.run(spark, TABLES).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert 0 < len(kept) < len(docs)
    assert tokens == {i: len(ids_of(docs[i])) for i in kept}


def test_stages_leave_other_columns_alone(spark, tmp_path):
    shown = spark.read.parquet(f"{TABLES}/documents.parquet").limit(30).select(
        "doc_id", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in ("score", "kept", "n_hit", "hits", "keep_id", "a.b")], "text"
    )
    rows = [(None, *["x"] * 6, None), (5, *["x"] * 6, ""), (5, *["x"] * 6, "")]
    docs = shown.union(spark.createDataFrame(rows, shown.schema))
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, TABLES)
        assert after.columns == docs.columns and after.count() > 0
        assert all(r.score in ("x", f"score-{r.doc_id}") and r["a.b"] in ("x", f"a.b-{r.doc_id}") for r in after.collect())
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), TABLES).count() == 0


def test_near_stage_judges_rows_not_ids(spark):
    base, other = (" ".join(f"{w}{n}" for n in range(200)) for w in "ab")
    rows = [(1, base), (5, f"{base} end"), (5, other), (None, other.upper()), (None, None), (7, "short one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.one_of_each_kind(spark, docs, TABLES)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    cursor = db.execute(sql.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(r) for r in cursor.fetchall())
