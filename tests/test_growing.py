"""Corpora that grow: batches packed one after the other, and stores read in part."""

import random

import pytest
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.operators import experts, rows
from packloom.plans.prepare import pack_corpus
from packloom.sources import growing, packed
from packloom.sources import experts as expert_store

ENCODED = "doc_id bigint, domain string, split string, ids array<int>"


def encoded(spark, docs):
    df = spark.createDataFrame(docs, ENCODED).repartition(3)
    return stage(df.withColumns({"n_tokens": F.size("ids"), "digest": F.xxhash64("ids")}), "encoded")


def corpus(seed, n):
    """Documents of 0 to 30 tokens in two domains, one of them null."""
    rng = random.Random(seed)
    return [
        (i, rng.choice(["a", "a", None]), rng.choice(["train", "test"]), [rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 9, 30]))])
        for i in range(n)
    ]


def streams(docs, world):
    """Token streams of every rank by plain loops."""
    seen, out = {}, {}
    for _, domain, split, ids in docs:
        place = seen.get((domain, split), 0)
        seen[domain, split] = place + 1
        out.setdefault((domain, split, place % world), []).extend(ids)
    return out


def read(df):
    return sorted(
        ((r.domain or "", r.split, r["rank"], r.chunk, r.seq_id, tuple(r.input_ids), tuple(r.label)) for r in df.collect())
    )


@pytest.mark.parametrize(("seq_len", "world", "cuts"), [(8, 2, (0, 20, 21, 60)), (5, 3, (0, 2, 30, 60)), (64, 2, (0, 10, 10, 60))])
def test_batches_give_the_windows_of_one_packing(spark, tmp_path, seq_len, world, cuts):
    docs, path = corpus(seq_len, 60), str(tmp_path / "store")
    for low, high in zip(cuts, cuts[1:], strict=False):
        growing.append_packed(encoded(spark, docs[low:high]), path, "doc_id", seq_len, world)
    grown = read(growing.read_grown(spark, path))
    assert grown == read(pack_corpus(encoded(spark, docs), "doc_id", seq_len, world))
    by_hand = {k: s for k, s in streams(docs, world).items()}
    assert len(grown) == sum(max(0, (len(s) - 1) // seq_len) for s in by_hand.values())
    for domain, split, rank, chunk, _, inputs, labels in grown:
        stream = by_hand[domain or None, split, rank]
        assert list(inputs) == stream[chunk * seq_len : (chunk + 1) * seq_len]
        assert list(labels) == stream[chunk * seq_len + 1 : (chunk + 1) * seq_len + 1]
    _, tails = growing.carry_state(spark, path, len(cuts) - 2)
    left = {(r.domain, r.split, r["rank"]): (r.chunk, list(r.tokens)) for r in tails.collect()}
    for key, stream in by_hand.items():
        if stream:
            chunk = (len(stream) - 1) // seq_len
            assert left[key] == (chunk, stream[chunk * seq_len :])


def test_a_batch_reads_no_windows_of_others(spark, tmp_path):
    docs, path = corpus(4, 45), str(tmp_path / "store")
    for low in (0, 15):
        growing.append_packed(encoded(spark, docs[low : low + 15]), path, "doc_id", 8, 2)
    counted, tails = growing.carry_state(spark, path, 1)
    third = growing.batch_windows(encoded(spark, docs[30:]), "doc_id", 8, 2, counted, tails)
    files = third.inputFiles()
    assert files and not [f for f in files if "/packed/" in f or "batch=0" in f]
    assert any("/tails/batch=1/" in f for f in files)


def test_a_batch_cut_short_does_not_count(spark, tmp_path):
    docs, path = corpus(5, 40), tmp_path / "store"
    growing.append_packed(encoded(spark, docs[:20]), str(path), "doc_id", 8, 2)
    half = path / "packed" / "batch=1"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half a file")
    before = read(growing.read_grown(spark, str(path)))
    assert growing.finished_batches(spark, str(path)) == 1 and before
    assert growing.append_packed(encoded(spark, docs[20:]), str(path), "doc_id", 8, 2) == 1
    assert read(growing.read_grown(spark, str(path))) == read(pack_corpus(encoded(spark, docs), "doc_id", 8, 2))


def test_a_store_keeps_its_settings(spark, tmp_path):
    docs, path = corpus(6, 10), str(tmp_path / "store")
    with pytest.raises(ValueError, match="no finished batch"):
        growing.read_grown(spark, path)
    growing.append_packed(encoded(spark, docs), path, "doc_id", 8, 2)
    for seq_len, world in ((9, 2), (8, 3)):
        with pytest.raises(ValueError, match="another window length"):
            growing.append_packed(encoded(spark, docs), path, "doc_id", seq_len, world)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packed") / "store")
    packed.write_packed(pack_corpus(encoded(spark, corpus(7, 400)), "doc_id", 8, 2), path, samples_per_file=5)
    packed.write_zones(spark, path)
    return path


def test_first_sequences_read_few_files(spark, store):
    every = packed.read_packed(spark, store)
    first = packed.read_sequences(spark, store, 0, 6)
    assert read(first) == read(rows.first_sequences(every, 7))
    assert 0 < len(first.inputFiles()) < len(every.inputFiles()) / 2
    assert first.dtypes == every.dtypes


def test_any_stretch_of_sequences(spark, store):
    every = packed.read_packed(spark, store)
    assert read(packed.read_sequences(spark, store, 3, 11)) == read(every.where("seq_id between 3 and 11"))
    assert read(packed.read_sequences(spark, store, 2, 4, by="chunk")) == read(every.where("chunk between 2 and 4"))
    none = packed.read_sequences(spark, store, 10**6, 10**7)
    assert none.count() == 0 and none.dtypes == every.dtypes


PLAN = [("a0", "a", 0), ("a2", "a", 2)]


def counts(df):
    return sorted(((r.expert, r.order, r.ctx2, r.ctx1, r.tok, r.n) for r in df.collect()), key=repr)


@pytest.mark.parametrize("steps", [(1, 2, 3), (2, 5, 40)])
def test_snapshots_add_up(spark, tmp_path, steps):
    path = str(tmp_path / "deltas")
    train = stage(pack_corpus(encoded(spark, corpus(8, 300)), "doc_id", 8, 2).where("domain is not null and split = 'train'"), "train")
    deltas = experts.fit_deltas(train, PLAN, steps, 2, 3)
    expert_store.write_deltas(deltas, path)
    full = {s: experts.fit_experts(train, [(e, d, o, s) for e, d, o in PLAN], 2, 3) for s in steps}
    want = {s: counts(df) for s, df in full.items()}
    for s in steps:
        assert counts(expert_store.read_snapshot(spark, path, s)) == want[s]
    stored = spark.read.parquet(f"{path}/deltas").count()
    assert stored < sum(map(len, want.values()))
    expert_store.compact_snapshots(spark, path, steps[1])
    assert spark.read.parquet(f"{path}/deltas").select("step").distinct().collect() == [(steps[2],)]
    assert counts(expert_store.read_snapshot(spark, path, steps[1])) == want[steps[1]]
    assert counts(expert_store.read_snapshot(spark, path, steps[2])) == want[steps[2]]
    with pytest.raises(ValueError, match="folded"):
        expert_store.read_snapshot(spark, path, steps[0])


def test_a_base_cut_short_does_not_count(spark, tmp_path):
    path = tmp_path / "deltas"
    train = pack_corpus(encoded(spark, corpus(9, 100)), "doc_id", 8, 2).where("domain is not null and split = 'train'")
    expert_store.write_deltas(experts.fit_deltas(stage(train, "train"), PLAN, (1, 2), 2, 3), str(path))
    want = counts(expert_store.read_snapshot(spark, str(path), 2))
    (path / "bases" / "upto=1" / "expert=a0").mkdir(parents=True)
    assert counts(expert_store.read_snapshot(spark, str(path), 2)) == want
