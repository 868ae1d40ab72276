import random

from pyspark.sql import functions as F

from packloom.functions.index import key_bounds, range_of, running_total
from packloom.operators.rows import with_index


def brute_index(rows, order, by):
    seen, out = {}, {}
    for row in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
        group = tuple(row[c] for c in by)
        out[tuple(row[c] for c in order)] = seen.get(group, 0)
        seen[group] = seen.get(group, 0) + 1
    return out


def test_index_over_a_composite_key_with_one_hot_part(spark):
    rng = random.Random(1)
    rows = [{"a": 7 if rng.random() < 0.5 else rng.randrange(50), "b": i, "g": rng.choice("xxxxy")} for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b bigint, g string").repartition(5)
    for by in ([], ["g"]):
        got = {(r.a, r.b): r["index"] for r in with_index(df, ["a", "b"], by).collect()}
        assert got == brute_index(rows, ["a", "b"], by)


def test_hot_part_of_a_key_is_spread_over_ranges(spark):
    df = spark.range(4000).select(F.lit(1).alias("a"), "id")
    bounds = key_bounds(df, ["a", "id"], 8)
    sizes = [r["count"] for r in df.groupBy(range_of(df, ["a", "id"], bounds).alias("r")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)


def test_index_over_strings_and_any_number_of_ranges(spark):
    words = [f"k{i * 7919 % 1000:03d}é" for i in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    expected = {w: i for i, w in enumerate(sorted(words))}
    for ranges in (1, 2, 3, 17):
        bounds = key_bounds(df, ["k"], ranges)
        got = {r.k: r["index"] for r in with_index(df, ["k"], bounds=bounds).collect()}
        assert got == expected


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, g string, v int")
    sums, expected = {}, {}
    for k, g, v in rows:
        expected[k] = sums.get(g, 0)
        sums[g] = expected[k] + v
    got = {r.k: r["t"] for r in running_total(df, F.col("v"), ["k"], ["g"], "t").collect()}
    assert got == expected


def test_index_never_needs_a_single_partition(spark, plan_of):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    assert "SinglePartition" not in plan_of(with_index(df, ["id"], ["g"]))


def test_null_groups_and_keys_keep_their_rows(spark):
    rows = [(1, None), (2, "a"), (3, None), (None, "a"), (5, "b")]
    df = spark.createDataFrame(rows, "k int, g string").repartition(3)
    got = {(r.k, r.g): r["index"] for r in with_index(df, ["k"], ["g"]).collect()}
    assert got == {(1, None): 0, (3, None): 1, (None, "a"): 0, (2, "a"): 1, (5, "b"): 0}


def test_bounds_come_from_one_job(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    tracker, group = spark.sparkContext.statusTracker(), "bounds"
    spark.sparkContext.setJobGroup(group, group)
    bounds = key_bounds(df, ["k"], 10)
    spark.sparkContext.setJobGroup("", "")
    assert len(bounds) == 9 and len(tracker.getJobIdsForGroup(group)) <= 2


def test_literals_do_not_grow_with_the_bounds(spark, monkeypatch):
    """Whole-numbered bounds reach the JVM in one call; results are those of Python's order, at the types' ends too."""
    low, high = -(1 << 63), (1 << 63) - 1
    bounds = sorted({(k, n) for k in (low, -5, 0, 7, high) for n in range(-30, 30, 3)})
    keys = [(k, n) for k in (low, low + 1, -5, -4, 0, 7, 8, high) for n in (-31, -30, 0, 1, 29)]
    df = spark.createDataFrame(keys, "a bigint, id int")
    calls, lit = [], F.lit
    monkeypatch.setattr(F, "lit", lambda v: calls.append(v) or lit(v))
    ranged = df.select("a", "id", range_of(df, ["a", "id"], bounds).alias("r"))
    assert len(calls) < 20
    assert {(r.a, r.id): r.r for r in ranged.collect()} == {key: sum(b < key for b in bounds) for key in keys}
    single = df.select("a", range_of(df, ["a"], [(low,), (0,), (high,)]).alias("r")).distinct()
    assert {r.a: r.r for r in single.collect()} == {a: sum(b < a for b in (low, 0, high)) for a, _ in keys}
