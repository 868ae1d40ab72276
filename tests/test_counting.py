"""Suffix counting against plain loops, and vocabularies by summaries against full counts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from packloom.operators.suffixes import Walk, reversed_contexts, suffix_counts
from packloom.operators.summaries import Summary, vocab_summary, word_summaries
from packloom.operators.tokens import build_vocab


def sequences(seed, n, length):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tokens = [min(6, int(rng.expovariate(0.7))) for _ in range(length + 1)]
        out.append((rng.choice(["x", "y"]), rng.randint(0, 4), rng.randint(1, 3), tokens[:-1], tokens[1:]))
    return out


def by_hand(rows):
    found = Counter()
    for expert, capacity, uses, inputs, labels in rows:
        for p, tok in enumerate(labels):
            for order in range(min(capacity, p + 1) + 1):
                context = tuple(inputs[p - k] for k in range(order))
                found[expert, order, context, tok] += uses
    return sorted((*k, n) for k, n in found.items())


SCHEMA = "expert string, capacity int, uses int, input_ids array<int>, label array<int>"


def counted(df):
    return sorted((r.expert, r.order, tuple(r.context), r.tok, r.n) for r in df.collect())


@pytest.mark.parametrize(("n", "batch"), [(60, 10_000), (60, 7), (1, 3)])
def test_all_orders_from_one_row_per_position(spark, n, batch):
    """Small batches cut runs in two; four ranges cut them again."""
    rows = sequences(n + batch, n, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    grams = reversed_contexts(df, df["capacity"], "expert", "uses")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = counted(suffix_counts(grams, grams["uses"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == by_hand(rows)


def test_one_row_per_distinct_gram_is_exchanged(spark):
    """A hundred equal sequences exchange what one does."""
    rows = sequences(3, 1, 12) * 100
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    grams = reversed_contexts(df, df["capacity"], "expert")
    assert grams.count() == 1200
    assert grams.groupBy("expert", "gram").count().count() <= 12
    assert counted(suffix_counts(grams)) == by_hand([(e, c, 1, i, t) for e, c, _, i, t in rows])


def test_no_grams(spark):
    df = spark.createDataFrame([("x", 2, 1, [], [])], SCHEMA)
    assert suffix_counts(reversed_contexts(df, 2, "expert")).count() == 0
    assert suffix_counts(reversed_contexts(df.limit(0), 2, "expert")).count() == 0


def test_walk_over_batches():
    grams = sorted(tuple(random.Random(n).randrange(3) for _ in range(n % 4 + 1)) for n in range(200))
    want = Counter(g[:k] for g in grams for k in range(1, len(g) + 1))
    run = Walk()
    for at in range(0, 200, 13):
        part = grams[at : at + 13]
        run.add(["e"] * len(part), pa.array([list(g) for g in part], pa.list_(pa.int32())), np.ones(len(part), np.int64))
    run.close()
    got = {(tok, *context): n for _, _, context, tok, n, _ in run.rows}
    assert got == want and len(run.rows) == len(want)


def corpus(seed, n):
    rng = random.Random(seed)
    return [(" ".join(f"w{int(rng.paretovariate(0.8)) % 5000}" for _ in range(rng.randint(0, 60))),) for _ in range(n)]


@pytest.mark.parametrize(("size", "keep"), [(50, None), (50, 5), (20, 60), (100_000, None)])
def test_summary_gives_the_full_count(spark, size, keep):
    """Too few counters at first only cost further rounds; ties at the last place come out alike."""
    df = spark.createDataFrame(corpus(size, 400) + [(None,), ("",), ("<unk> <unk> a\tb\r\nc",)], "text string").repartition(5)
    assert sorted(map(tuple, vocab_summary(df, size, keep=keep).collect())) == sorted(map(tuple, build_vocab(df, size).collect()))


def test_rows_exchanged_do_not_grow_with_distinct_words(spark):
    few = spark.createDataFrame(corpus(1, 300), "text string").repartition(4)
    many = spark.createDataFrame([(f"{t} " + " ".join(f"u{i}_{k}" for k in range(50)),) for i, (t,) in enumerate(corpus(1, 300))], "text string").repartition(4)
    assert word_summaries(many, 40).count() <= 4 * 41 and word_summaries(few, 40).count() <= 4 * 41


def test_summary_bounds():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(20_000)]
    summary = Summary(100)
    for at in range(0, len(words), 500):
        summary.add(Counter(words[at : at + 500]))
    summary.shrink()
    true = Counter(words)
    assert len(summary.counts) <= 100 and summary.error <= len(words) / 101
    assert all(n - summary.error <= summary.counts.get(w, 0) <= n for w, n in true.items())


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert [tuple(r) for r in vocab_summary(df, 5).collect()] == [("<unk>", 0, 0)]
    assert [tuple(r) for r in vocab_summary(df.limit(0), 5).collect()] == [("<unk>", 0, 0)]
