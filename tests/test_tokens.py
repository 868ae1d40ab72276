import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packloom.functions.index import key_bounds
from packloom.functions.staging import stage
from packloom.operators import tokens as T
from packloom.plans.prepare import encode_corpus, pack_corpus


def windows(stream, seq_len):
    """All windows of a token stream that have their look-ahead token, as (input, label)."""
    starts = range(0, len(stream) - seq_len, seq_len)
    return [(stream[s : s + seq_len], stream[s + 1 : s + seq_len + 1]) for s in starts]


def encoded_frame(spark, docs):
    rows = [(k, d, "train", ids, len(ids)) for k, d, ids in docs]
    return spark.createDataFrame(
        rows, "doc_id bigint, domain string, split string, ids array<int>, n_tokens int"
    ).withColumn("digest", F.xxhash64("ids")).repartition(3)


def check_packing(spark, docs, seq_len, world):
    packed = pack_corpus(encoded_frame(spark, docs), "doc_id", seq_len, world).collect()
    got = {(r.domain, r["rank"], r.chunk): (r.seq_id, r.input_ids, r.label) for r in packed}
    expected = {}
    for domain in {d for _, d, _ in docs}:
        mine = [ids for _, d, ids in sorted(docs) if d == domain]
        number = 0
        for rank in range(world):
            stream = [t for ids in mine[rank::world] for t in ids]
            for chunk, (inputs, label) in enumerate(windows(stream, seq_len)):
                expected[(domain, rank, chunk)] = (number, inputs, label)
                number += 1
    assert got == expected


@pytest.mark.parametrize("seq_len,world", [(8, 1), (8, 3), (1, 2)])
def test_packing_equals_cutting_each_ranks_stream(spark, seq_len, world):
    rng = random.Random(seq_len * 10 + world)
    docs = [
        (k, rng.choice(["a", "a", "b"]), [rng.randrange(99) for _ in range(rng.choice([0, 1, 2, 5, 17, 40]))])
        for k in range(60)
    ]
    check_packing(spark, docs, seq_len, world)


def test_packing_at_the_edges(spark):
    length = 4
    docs, key = [], 0
    for name, total in (("n0", 0), ("n1", 1), ("L", 4), ("L1", 5), ("2L", 8), ("2L1", 9), ("long", 23)):
        docs.append((key, name, list(range(total))))
        key += 1
    docs += [(key + i, "singles", [i]) for i in range(10)]
    check_packing(spark, docs, length, 1)
    packed = pack_corpus(encoded_frame(spark, docs), "doc_id", length, 1)
    counts = {r.domain: r["count"] for r in packed.groupBy("domain").count().collect()}
    assert counts == {"L1": 1, "2L": 1, "2L1": 2, "long": 5, "singles": 2}
    stats = {r.domain: (r.n_sequences, r.n_tokens) for r in T.corpus_token_stats(packed).collect()}
    assert stats["long"] == (5, 20)


def test_vocabulary_order_ties_and_specials(spark):
    texts = ["b a a\tc", "<unk> c\n\nc d", " ", None, "e  e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = Counter(w for t in texts if t for w in t.split() if w != "<unk>")
    ranked = sorted(counted, key=lambda w: (-counted[w], w))
    for size in (3, 100):
        got = sorted((r.id, r.token, r.n) for r in T.build_vocab(df, size, ("<unk>", "<s>")).collect())
        expected = [(0, "<unk>", 0), (1, "<s>", 0)]
        assert got == expected + [(i + 2, w, counted[w]) for i, w in enumerate(ranked[:size])]


def test_encoding_unknown_words_first_token_and_empty_text(spark):
    vocab = spark.createDataFrame([("<unk>", 0, 0), ("<s>", 1, 0), ("x", 2, 3), ("y", 3, 1)], "token string, id int, n int")
    df = spark.createDataFrame([(1, "x z\ty x"), (2, ""), (3, None), (4, "  ")], "k bigint, text string")
    got = {r.k: r.ids for r in T.encode(df, vocab, 3, bos_id=1).collect()}
    assert got == {1: [1, 2, 0, 3, 2], 2: [], 3: [], 4: [1]}
    plain = {r.k: r.ids for r in T.encode(df, vocab, 100).collect()}
    assert plain == {1: [2, 0, 3, 2], 2: [], 3: [], 4: []}


def test_encoding_exchanges_neither_text_nor_tokens(spark, plan_of):
    vocab = spark.createDataFrame([("<unk>", 0, 0), ("x", 1, 3)], "token string, id int, n int")
    df = spark.range(10).select(F.col("id").alias("k"), F.lit("x y").alias("text"))
    main = plan_of(T.encode(df, vocab, 2)).split("Subquery")[0]
    assert "Exchange" not in main and "Explode" not in main and "Generate" not in main


def test_a_large_vocabulary_is_joined(spark, plan_of):
    vocab = spark.createDataFrame([("<unk>", 0)] + [(f"w{n}", n + 1) for n in range(50)], "token string, id int")
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(70)}" for _ in range(rng.randrange(12))) for _ in range(40)] + [None, "", " \t", "w1"]
    df = spark.createDataFrame([(n % 9, t) for n, t in enumerate(texts)], "k bigint, text string").repartition(3)
    for bos in (None, 7):
        small, large = T.encode(df, vocab, 51, bos_id=bos), T.encode(df, vocab, 51, bos_id=bos, in_place=100)
        assert small.columns == large.columns and small.schema["ids"].dataType == large.schema["ids"].dataType
        assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
    main = plan_of(large)
    assert "Join" in main and "Subquery" not in main


def test_each_task_of_the_layout_holds_one_key_range(spark, plan_of):
    stored = stage(encoded_frame(spark, [(k, "d", [1] * (k % 5)) for k in range(600)]), "encoded")
    order = ["doc_id", "n_tokens", "digest"]
    bounds = key_bounds(stored, order, 16)
    starts = T.range_starts(stored.select(*order, "domain", "split"), order, bounds, 2, 4)
    laid_out = T.lay_out(stored.select(*order, "domain", "split", "ids"), starts, order, bounds, 2)
    tasks = laid_out.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("__range").alias("ranges"), F.count("*").alias("n"))
    held = [(r.ranges, r.n) for r in tasks.collect()]
    assert len(held) == 16 and all(ranges == 1 for ranges, _ in held) and max(n for _, n in held) < 2.5 * 600 / 16
    main = plan_of(laid_out)
    assert main.count("shufflepartitionidpassthrough") == 3  # the documents' own, and that of the starts' two branches
    assert not [line for line in main.splitlines() if "hashpartitioning(__range" in line and "ids" in line]


def test_repeated_keys_and_null_groups_lose_nothing(spark):
    rows = [(7, None, [1, 2, 3]), (7, None, [4, 5, 6]), (7, None, [4, 5, 6]), (None, "a", [9, 9]), (3, "a", [8])]
    frame = encoded_frame(spark, [(k, d, ids) for k, d, ids in rows])
    got = pack_corpus(frame, "doc_id", 2, 1).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.chunk):
        by.setdefault(r.domain, []).append((r.seq_id, r.input_ids, r.label))
    assert [seq for seq, _, _ in by[None]] == [0, 1, 2, 3] and len(by["a"]) == 1
    stream = [x for _, ids, _ in by[None] for x in ids]
    assert sorted(stream) == sorted([1, 2, 3, 4, 5, 6, 4, 5, 6])[: len(stream)] or len(stream) == 8
    assert by["a"][0][1:] == ([9, 9], [9, 8])


def test_a_window_that_holds_too_much_raises(spark):
    schema = "domain string, split string, rank int, offset bigint, first_seq bigint, ids array<int>, __range int"
    twice = spark.createDataFrame([("d", "s", 0, 0, 0, [1, 2, 3], 0)] * 2, schema)
    with pytest.raises(Exception, match="more tokens than fit"):
        T.pack(twice, 2).collect()


def test_packing_exchanges_token_arrays_once_and_joins_none(spark, plan_of):
    docs = [(k, "d", [1, 2, 3]) for k in range(20)]
    stored = stage(encoded_frame(spark, docs), "encoded")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(pack_corpus(stored, "doc_id", 4, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("rank" in line and "ids" not in line for line in joins)


def test_pairs_know_two_tokens_before(spark):
    df = spark.createDataFrame([(5, [1, 2, 3], [2, 3, 4])], "seq_id bigint, input_ids array<int>, label array<int>")
    got = sorted(tuple(r) for r in T.training_pairs(df, "seq_id").collect())
    assert got == [(5, 0, None, 1, 2), (5, 1, 1, 2, 3), (5, 2, 2, 3, 4)]


def test_whole_way_from_text(spark):
    texts = ["to be or not to be", "", "that is the question", "whether tis nobler in the mind"] * 5
    rows = [(i, "d", "train", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, split string, text string")
    vocab = T.build_vocab(df, 50)
    ids = {r.token: r.id for r in vocab.collect()}
    packed = pack_corpus(encode_corpus(df, vocab, "doc_id", 51), "doc_id", 6, 2).collect()
    for rank in (0, 1):
        stream = [ids[w] for t in texts[rank::2] for w in t.split()]
        got = [(r.input_ids, r.label) for r in sorted(packed, key=lambda r: r.chunk) if r["rank"] == rank]
        assert got == windows(stream, 6)


def test_words_of_an_arrow_batch():
    ascii_marks = [f"a{chr(c)}b" for c in range(128)]
    for texts in ([" x  y\t", None, "", "\n \r", "z"], ["x\vy z\f", " \v "], ascii_marks, ["é ß  x", None], [None], []):
        starts, found = T.split_words(pa.array(texts, pa.string()))
        got = [found.to_pylist()[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        assert got == [[w for w in re.split("[ \t\n\r]+", t or "") if w] for t in texts]


def test_no_word_becomes_a_row_to_be_counted(spark, plan_of):
    """Words are counted and looked up by whole Arrow batches."""
    df = spark.createDataFrame([("a b a " * 50,)] * 20, "text string").repartition(2)
    counted = T.count_words(df)
    assert "Generate" not in plan_of(counted) and counted.count() == 4
    vocab = T.build_vocab(df, 5)
    plan = plan_of(T.encode(df, vocab, 6))
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan


def test_bytes_that_are_no_text(spark):
    """Words with bytes that are no UTF-8 are words with U+FFFD in their place, as in any split by Spark."""
    df = spark.createDataFrame([("61FF20622061FF",), ("62FF0B6120",)], "h string").select(F.unhex("h").cast("string").alias("text"))
    vocab = T.build_vocab(df, 5)
    assert {(r.token, r.n) for r in vocab.collect()} == {("<unk>", 0), ("a�", 2), ("b", 1), ("b�\va", 1)}
    assert sorted(r.ids for r in T.encode(df, vocab, 6).select("ids").collect()) == [[1, 2, 1], [3]]
