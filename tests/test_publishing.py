"""Generations, verified files and epoch orders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from packloom.operators import rows
from packloom.sources import generations, packed, verified


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_table_is_replaced_by_a_job_that_reads_it(spark, tmp_path):
    path = str(tmp_path / "table")
    assert generations.publish(spark.range(100), path) == 0
    before = generations.read_published(spark, path)
    shuffled = rows.shuffle_rows(before, "id", 5, 3)
    assert generations.publish(shuffled, path, "shard") == 1
    after = generations.read_published(spark, path)
    assert ids(after) == list(range(100)) and "shard" in after.columns
    assert ids(before) == list(range(100)) and ids(generations.read_published(spark, path, 0)) == list(range(100))
    generations.retire(spark, path)
    assert generations.pointers(spark, path) == [1] and ids(generations.read_published(spark, path)) == list(range(100))
    assert len(list((tmp_path / "table" / "data").iterdir())) == 1


def test_a_half_written_target_is_not_prepared(spark, tmp_path):
    path = tmp_path / "table"
    half = path / "data" / "0-crashed"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half")
    assert not generations.is_published(spark, str(path))
    with pytest.raises(ValueError, match="nothing has been published"):
        generations.read_published(spark, str(path))
    assert generations.publish_if_absent(spark.range(3), str(path))
    assert not generations.publish_if_absent(spark.range(9), str(path))
    assert ids(generations.read_published(spark, str(path))) == [0, 1, 2]
    generations.retire(spark, str(path))
    assert not half.exists() and ids(generations.read_published(spark, str(path))) == [0, 1, 2]


def test_a_failing_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    generations.publish(spark.range(3), path)
    with pytest.raises(Exception, match="no such row"):
        generations.publish(spark.range(3).select(F.raise_error(F.lit("no such row")).cast("bigint").alias("id")), path)
    assert generations.pointers(spark, path) == [0] and ids(generations.read_published(spark, path)) == [0, 1, 2]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    generations.publish(spark.range(3), path)
    monkeypatch.setattr(generations, "pointers", lambda *_: [])  # both have seen the same state
    with pytest.raises(Exception, match="exist"):
        generations.publish(spark.range(9), path)
    monkeypatch.undo()
    assert ids(generations.read_published(spark, path)) == [0, 1, 2]
    assert len(list((tmp_path / "table" / "data").iterdir())) == 1


@pytest.fixture
def sequences(spark):
    rows = [(d, "train", r, c, c, [c, r, 1], [r, 1, 2]) for d in ("a", None) for r in (0, 1) for c in range(12)]
    schema = "domain string, split string, rank int, chunk bigint, seq_id bigint, input_ids array<int>, label array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


def status(spark, path):
    return {(r.domain, r["rank"], r.file): r.status for r in verified.verified_manifest(spark, path).collect()}


def test_damaged_files_are_named_and_built_again_alone(spark, tmp_path, sequences):
    path = tmp_path / "packed"
    verified.write_verified(sequences, str(path), 5)
    want = {(d, r, f): "ok" for d in ("a", None) for r in (0, 1) for f in range(3)}
    assert status(spark, str(path)) == want
    missing = path / "domain=a" / "split=train" / "rank=1" / "file=2"
    for file in missing.iterdir():
        file.unlink()
    changed = path / "domain=a" / "split=train" / "rank=0" / "file=1"
    other = spark.createDataFrame([(5, 5, [9], [9])], "chunk bigint, seq_id bigint, input_ids array<int>, label array<int>")
    other.write.mode("overwrite").parquet(str(changed))
    other.write.parquet(str(path / "domain=a" / "split=train" / "rank=0" / "file=7"))
    named = status(spark, str(path))
    assert {k: s for k, s in named.items() if s != "ok"} == {("a", 1, 2): "missing", ("a", 0, 1): "changed", ("a", 0, 7): "unlisted"}
    whole = path / "domain=a" / "split=train" / "rank=0" / "file=0"
    untouched = {f.name: f.stat().st_mtime_ns for f in whole.iterdir()}
    assert verified.rebuild_damaged(sequences, str(path), 5) == 2
    assert {k: s for k, s in status(spark, str(path)).items() if s != "ok"} == {("a", 0, 7): "unlisted"}
    assert {f.name: f.stat().st_mtime_ns for f in whole.iterdir()} == untouched
    assert verified.rebuild_damaged(sequences, str(path), 5) == 0
    assert packed.read_packed(spark, str(path)).where("file < 7").count() == sequences.count()


def test_a_digest_sees_rows_and_not_their_order(spark, sequences):
    digest = lambda df: sorted(map(repr, verified.file_digests(verified.with_file(df, 5)).collect()))
    assert digest(sequences) == digest(sequences.orderBy(F.rand(3)).coalesce(1))
    turned = sequences.withColumn("input_ids", F.when(F.col("chunk") == 3, F.reverse("input_ids")).otherwise(F.col("input_ids")))
    assert len(set(digest(sequences)) - set(digest(turned))) == 4


def place_by_hand(i, n, seed, epoch, rounds):
    draw = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    for turn in range(1, rounds + 1):
        other = (draw(f"{seed}:{epoch}:{turn}") % n - i) % n
        if draw(f"{seed}:{epoch}:{turn}:{max(i, other)}") % 2:
            i = other
    return i


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_every_epoch_is_a_permutation_of_its_own(spark, plan_of, n):
    each = spark.range(n).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2))))
    placed = each.select("id", "epoch", rows.epoch_place(F.col("id"), n, 9, F.col("epoch")).alias("place"))
    got = {(r.id, r.epoch): r.place for r in placed.collect()}
    assert got == {(i, e): place_by_hand(i, n, 9, e, 32) for i in range(n) for e in range(3)}
    orders = [tuple(got[i, e] for i in range(n)) for e in range(3)]
    assert all(sorted(order) == list(range(n)) for order in orders)
    if n > 10:
        assert len(set(orders)) == 3 and sum(order[i] == i for order in orders for i in range(n)) < 15
    assert "Sort" not in plan_of(placed) and "Exchange" not in plan_of(placed)
