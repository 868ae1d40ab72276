"""One runnable query per operator, each from the given tables alone.

Arrays leave as space-joined strings and counts as BIGINT, so that results compare value by value with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.index import key_bounds, range_of
from packloom.functions.staging import fresh_path, stage
from packloom.operators import ensemble, experts, metrics, rows, suffixes, summaries, tokens
from packloom.plans.prepare import document_layout, encode_corpus, pack_corpus
from packloom.sources import bucketed, corpus, generations, growing, packed, verified
from packloom.sources import experts as expert_store

SEQ_LEN = 64
WORLD = 2
VOCAB_WORDS = 2000
VOCAB_SIZE = VOCAB_WORDS + 1
BATCH = 42
ACCUM = 2
EVAL_BATCH = 10
EVAL_STEPS = 20
PRIOR_SEQUENCES = 100
DECAY = 0.3
SAMPLES_PER_FILE = 500
RESHARDS = 7
SEED = 42
DOMAINS = ("de", "en", "es", "fr")
SNAPSHOTS = (300, 400, 500)
PARTS_PER_SHARD = 2
EPOCHS = 3
#: domains that an expert of every capacity learns one after the other, with the steps of each
CHAIN = (("en", 300), ("de", 400), ("fr", 500))
ORDERS = (0, 1, 2)
#: (expert, domain, order, steps); es has no expert of its own
PLAN = (("de", "de", 1, 300), ("en", "en", 2, 500), ("fr", "fr", 1, 400))
EXPERTS = tuple(name for name, *_ in PLAN)
#: Three set-ups over the same domains: all alike, unequal steps, unequal sizes
SETUPS = {
    "same_size_same_steps": (("de", 1, 400), ("fr", 1, 400), ("en", 1, 400)),
    "same_size_unequal_steps": (("de", 1, 300), ("fr", 1, 400), ("en", 1, 500)),
    "unequal_size_same_steps": (("de", 0, 400), ("fr", 1, 400), ("en", 2, 400)),
}
#: every domain's expert at several steps
CURVE_PLAN = tuple((f"{d}_at_{s}", d, 1, s) for d in ("de", "en", "fr") for s in SNAPSHOTS)
#: experts of unequal capacity beyond pairs: (expert, domain, order, steps)
DEEP_PLAN = (("de", "de", 4, 300), ("en", "en", 3, 500), ("fr", "fr", 2, 400))
#: early steps, before every sequence has been used between two of them
DELTA_STEPS = (4, 8, 12)
DELTA_PLAN = tuple((f"{e}_at_{s}", d, o, s) for e, d, o, _ in PLAN for s in DELTA_STEPS)
#: batches that a growing corpus arrives in
ARRIVALS = 3
METRIC_WORLD = 4
METRIC_INTERVAL = 10
LOGIT_DOMAIN = ("label",)


def _member(domain: str, order: int, steps: int) -> str:
    return f"{domain}_o{order}_s{steps}"


SETUP_PLAN = tuple(
    sorted({(_member(*m), m[0], m[1], m[2]) for members in SETUPS.values() for m in members})
)
CHAIN_PLAN = tuple((f"{d}_o{o}", d, o, s) for o in ORDERS for d, s in CHAIN)
ENSEMBLES = {name: tuple(_member(*m) for m in members) for name, members in SETUPS.items()}


def _joined(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), " ").alias(array)


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- shared steps ---------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = corpus.read_corpus(spark, f"{sf_dir}/documents.parquet")
    texts = corpus.select_text(table.withColumnRenamed("lang", "domain"), "text", "doc_id", "domain")
    return rows.split_corpus(texts, "doc_id")


def _vocab(docs: DataFrame) -> DataFrame:
    return tokens.build_vocab(docs, VOCAB_WORDS)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return encode_corpus(docs, _vocab(docs), "doc_id", VOCAB_SIZE)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(_encoded(spark, sf_dir), "doc_id", SEQ_LEN, WORLD)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(_packed(spark, sf_dir), "packed")


def _pairs(sequences: DataFrame, *keep: str) -> DataFrame:
    return tokens.training_pairs(sequences, *(keep or ("domain", "split", "seq_id")))


def _train(sequences: DataFrame) -> DataFrame:
    return sequences.where(F.col("split") == "train")


def _scored(spark: SparkSession, sf_dir: str, plan: tuple = PLAN, split: str | None = None) -> DataFrame:
    """A row per position, of one split or all, with an array entry per expert of the plan."""
    sequences = _stored(spark, sf_dir)
    counts = stage(experts.fit_experts(_train(sequences), plan, ACCUM, BATCH), "experts")
    if split is not None:
        sequences = sequences.where(F.col("split") == split)
    return experts.score_sequences(sequences, counts, [p[0] for p in plan], VOCAB_SIZE)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per position and expert."""
    return experts.by_expert(_scored(spark, sf_dir), EXPERTS)


def _count_rows(counts: DataFrame) -> DataFrame:
    return counts.select("expert", *_big("order", "ctx2", "ctx1", "tok", "n"))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# ---- sources and sinks ----------------------------------------------------------------------------------------


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "corpus")
    _documents(spark, sf_dir).write.partitionBy("domain", "split").parquet(path)
    train, validation, test = (corpus.read_corpus(spark, path, split=s) for s in ("train", "validation", "test"))
    return train.unionByName(validation).unionByName(test).select("doc_id", "domain", "split", F.length("text").cast("bigint").alias("n_chars"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.select_text(_lines(spark, sf_dir), "content", "doc_id", "line")
    return rows.drop_empty(lines).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars")
    )


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.select_text(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "text", "conv_id", "turn")


def packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "packed")
    packed.write_packed(_packed(spark, sf_dir), path, SAMPLES_PER_FILE)
    back = packed.read_packed(spark, path, "domain=*/split=*/rank=*")
    return back.select("domain", "split", *_big("rank", "chunk", "seq_id"), _joined("input_ids"), _joined("label"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "packed")
    packed.write_packed(_packed(spark, sf_dir), path, SAMPLES_PER_FILE)
    files = packed.manifest(spark, path)
    return files.select("domain", "split", *_big("rank"), "first_chunk", "n_rows")


def first_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sequences of every domain, from the files alone that the zone map names."""
    path = fresh_path(spark, "packed")
    packed.write_packed(_packed(spark, sf_dir), path, SAMPLES_PER_FILE)
    packed.write_zones(spark, path)
    return packed.read_sequences(spark, path, 0, PRIOR_SEQUENCES - 1).select("domain", "split", *_big("seq_id", "rank", "chunk"))


def pack_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus packed in batches that arrive one after the other in key order."""
    path, encoded = fresh_path(spark, "growing"), _encoded(spark, sf_dir)
    arrival = range_of(encoded, ["doc_id"], key_bounds(encoded, ["doc_id"], ARRIVALS))
    batches = stage(encoded.withColumn("arrival", arrival), "arrivals")
    for batch in range(ARRIVALS):
        growing.append_packed(batches.where(F.col("arrival") == batch).drop("arrival"), path, "doc_id", SEQ_LEN, WORLD)
    grown = growing.read_grown(spark, path)
    return grown.select("domain", "split", *_big("rank", "seq_id"), _joined("input_ids"), _joined("label"))


def verified_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packed file must hold, proven by reading it back."""
    path = fresh_path(spark, "verified")
    verified.write_verified(_stored(spark, sf_dir), path, SAMPLES_PER_FILE)
    files = verified.verified_manifest(spark, path)
    return files.select("domain", "split", *_big("rank"), "file", "n_rows", F.col("digest").cast("string").alias("digest"), "status")


def shuffle_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table replaced by its own rows in random order, twice."""
    path = fresh_path(spark, "published")
    generations.publish(corpus.read_corpus(spark, f"{sf_dir}/documents.parquet"), path)
    for seed in (SEED + 1, SEED):
        current = generations.read_published(spark, path).drop("shard")
        generations.publish(rows.shuffle_rows(current, "doc_id", seed, RESHARDS), path, "shard")
    generations.retire(spark, path)
    return generations.read_published(spark, path).select("doc_id", *_big("shard"), F.md5("text").alias("text_md5"))


def overwrite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "overwrite")
    docs = _documents(spark, sf_dir).select("doc_id", "domain", "split")
    packed.write_overwrite(docs, path)
    packed.write_overwrite(docs.withColumn("domain", F.upper("domain")), path)
    return spark.read.parquet(path)


def ignore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ignore")
    docs = _documents(spark, sf_dir).select("doc_id", "domain", "split")
    packed.write_if_absent(docs, path)
    packed.write_if_absent(docs.withColumn("domain", F.upper("domain")), path)
    return spark.read.parquet(path)


def expert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = F.concat(F.lit("runs/train_"), "source", F.lit("_expert_m_domain_"), "lang")
    paths = table.groupBy("source", "lang").agg(F.max("doc_id").alias("last")).select(
        F.concat(folder, F.lit("/checkpoints/model_"), F.col("last").cast("string"), F.lit(".bin")).alias("path"),
        F.when(F.col("last") % 2 == 0, F.col("source")).alias("given"),
    )
    return expert_store.expert_catalog(paths, "path", "given")


def expert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "experts")
    counts = experts.fit_experts(_train(_stored(spark, sf_dir)), PLAN, ACCUM, BATCH)
    steps = F.create_map(*[F.lit(x) for name, _, _, step in PLAN for x in (name, step)])
    expert_store.write_expert(counts.withColumn("step", steps[F.col("expert")]), path)
    back = expert_store.read_experts(spark, path, [(name, step) for name, _, _, step in PLAN])
    return back.select("expert", *_big("step", "order", "ctx2", "ctx1", "tok", "n"))


# ---- rows -----------------------------------------------------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "domain", "split")
    return rows.with_index(docs, ["doc_id"], ["domain", "split"])


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)


def null_domain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.select("doc_id", F.nullif("lang", F.lit("es")).alias("domain"))
    return rows.with_index(known, ["doc_id"], ["domain"])


def row_key_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = rows.with_row_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.with_index(keyed.select("doc_id", "file_path", "row_index"), ["file_path", "row_index"]).select("doc_id", "index")


def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_text(spark, sf_dir).select("conv_id", "turn")
    return rows.with_index(turns, ["conv_id", "turn"])


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = rows.shard(_indexed(spark, sf_dir), WORLD)
    return sharded.groupBy("domain", "split", *_big("rank")).agg(F.count("*").alias("n_docs"))


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("domain", "split").agg(F.count("*").alias("n_docs"))


def shuffled_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", rows.shuffle_key("doc_id", SEED).alias("draw"))
    return rows.with_index(docs, ["draw", "doc_id"], name="position").drop("draw")


def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.read_corpus(spark, f"{sf_dir}/documents.parquet")
    shuffled = rows.shuffle_rows(docs, "doc_id", SEED, RESHARDS)
    return shuffled.select("doc_id", *_big("shard"), F.md5("text").alias("text_md5"))


def shuffle_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, target = fresh_path(spark, "packed"), fresh_path(spark, "shuffled")
    packed.write_packed(_packed(spark, sf_dir), stored, SAMPLES_PER_FILE)
    read = packed.read_packed(spark, stored)
    shuffled = rows.shuffle_rows(read, ("domain", "split", "seq_id"), SEED, RESHARDS, PARTS_PER_SHARD)
    shuffled.write.partitionBy("shard").parquet(target)
    return spark.read.parquet(target).select("domain", "split", *_big("seq_id", "shard"), _joined("label"))


def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the order of each of several epochs."""
    docs = rows.with_index(_documents(spark, sf_dir).select("doc_id"), ["doc_id"])
    each = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    place = rows.epoch_place(F.col("index"), docs.count(), SEED, F.col("epoch"))
    return each.select("doc_id", *_big("epoch"), place.alias("place"))


def reshard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.with_index(_documents(spark, sf_dir).select("doc_id"), ["doc_id"])
    return (
        rows.reshard(docs, RESHARDS, "index")
        .groupBy(F.spark_partition_id().cast("bigint").alias("shard"))
        .agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("sum_doc_id"))
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = rows.assign_batches(_packed(spark, sf_dir), EVAL_BATCH)
    return batched.groupBy("domain", "split", *_big("rank"), "batch_id").agg(
        F.count("*").alias("n_sequences"), F.max("chunk").alias("last_chunk")
    )


def eval_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = rows.assign_batches(_packed(spark, sf_dir), EVAL_BATCH, "seq_id")
    kept = rows.limit_eval_batches(numbered, EVAL_STEPS)
    return kept.groupBy("domain", "split").agg(
        F.countDistinct("batch_id").alias("n_batches"), F.count("*").alias("n_sequences")
    )


def first_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rows.first_sequences(_packed(spark, sf_dir), PRIOR_SEQUENCES)
    return kept.select("domain", "split", *_big("seq_id", "rank", "chunk"))


def train_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = _stored(spark, sf_dir).select("domain", "split", "rank", "chunk", "seq_id")
    planned = rows.training_schedule(sequences, SNAPSHOTS[-1], ACCUM, BATCH)
    return planned.groupBy("domain", "split", *_big("rank", "seq_id")).agg(
        F.count("*").alias("times_seen"),
        F.max("epoch").alias("last_epoch"),
        F.sum("micro").alias("sum_micro"),
        F.sum("step").alias("sum_step"),
    )


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = _packed(spark, sf_dir).select("domain", "split", "rank", "chunk", "seq_id")
    seen = rows.snapshots(sequences, SNAPSHOTS, ACCUM, BATCH)
    return seen.groupBy("domain", "split", *_big("rank"), "snapshot").agg(
        F.sum("times_seen").alias("n_uses"), F.max("last_micro").alias("last_micro")
    )


def times_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = _stored(spark, sf_dir).select("domain", "split", "rank", "chunk", "seq_id")
    seen = rows.times_seen(sequences, F.lit(SNAPSHOTS[0]), ACCUM, BATCH)
    return seen.select("domain", "split", *_big("rank", "seq_id", "times_seen"))


# ---- tokens ---------------------------------------------------------------------------------------------------


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(_documents(spark, sf_dir)).select("token", *_big("id", "n"))


def vocab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.vocab_summary(_documents(spark, sf_dir), VOCAB_WORDS).select("token", *_big("id", "n"))


def encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    encoded = tokens.encode(docs, _vocab(docs), VOCAB_SIZE)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _joined("ids"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = document_layout(_encoded(spark, sf_dir), "doc_id", WORLD, SEQ_LEN)
    return layout.select("doc_id", "domain", "split", *_big("rank", "index", "n_tokens", "offset"))


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = tokens.pack(document_layout(_encoded(spark, sf_dir), "doc_id", WORLD, SEQ_LEN, "ids"), SEQ_LEN)
    return windows.select("domain", "split", *_big("rank", "chunk"), _joined("tokens"))


def label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = _packed(spark, sf_dir)
    return shifted.select("domain", "split", *_big("rank", "seq_id"), _joined("input_ids"), _joined("label"))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(_packed(spark, sf_dir)).select(
        "domain", "split", *_big("seq_id", "pos", "ctx2", "ctx1", "tok")
    )


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tokens.corpus_token_stats(_packed(spark, sf_dir))
    return stats.select("domain", "split", *_big("rank", "n_sequences", "n_tokens"))


# ---- experts --------------------------------------------------------------------------------------------------


def _seed_expert(sequences: DataFrame) -> DataFrame:
    general = _pairs(_train(sequences), "domain").withColumn("expert", F.lit("seed"))
    return experts.fit_expert(general, 1)


def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_rows(_seed_expert(_packed(spark, sf_dir)))


def suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts of order 2 to 4, all orders counted from one row per position."""
    plan = spark.createDataFrame(list(DEEP_PLAN), "expert string, domain string, capacity int, steps int")
    assigned = _train(_stored(spark, sf_dir)).join(F.broadcast(plan), "domain")
    used = rows.times_seen(assigned, F.col("steps"), ACCUM, BATCH, ("expert", "domain", "split", "rank"))
    grams = suffixes.reversed_contexts(used, F.col("capacity"), "expert", "times_seen")
    counted = suffixes.suffix_counts(grams, F.col("times_seen"))
    return counted.select("expert", *_big("order", "tok", "n"), _joined("context"))


def snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts as of several steps, stored as what each step adds; the second step's deltas are folded before the third is read."""
    path = fresh_path(spark, "deltas")
    plan = [(expert, domain, order) for expert, domain, order, _ in PLAN]
    expert_store.write_deltas(experts.fit_deltas(_train(_stored(spark, sf_dir)), plan, DELTA_STEPS, ACCUM, BATCH), path)
    early, folded, late = DELTA_STEPS
    snapshots = [stage(expert_store.read_snapshot(spark, path, early), "snapshot")]
    expert_store.compact_snapshots(spark, path, folded)
    snapshots += [expert_store.read_snapshot(spark, path, step) for step in (folded, late)]
    named = [s.withColumn("expert", F.concat("expert", F.lit(f"_at_{step}"))) for s, step in zip(snapshots, DELTA_STEPS, strict=True)]
    return _count_rows(named[0].unionByName(named[1]).unionByName(named[2]))


def _bases(sequences: DataFrame) -> DataFrame:
    """A seed expert of every capacity, stored as of step 0: each is the largest one's counts up to its order."""
    general = _pairs(_train(sequences), "domain").withColumn("expert", F.lit("seed"))
    counts = experts.fit_expert(general, max(ORDERS)).withColumn("capacity", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    kept = counts.where(F.col("order") <= F.col("capacity"))
    return stage(kept.withColumns({"expert": F.concat(F.lit("seed_o"), F.col("capacity")), "step": F.lit(0)}).drop("capacity"), "seeds")


def continued_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = _stored(spark, sf_dir)
    domain = experts.fit_experts(_train(sequences), PLAN, ACCUM, BATCH)
    bases = [(name, f"seed_o{order}", 0) for name, _, order, _ in PLAN]
    return _count_rows(experts.continue_experts(_bases(sequences), domain, bases))


def expert_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed, then one domain after the other, for each capacity; every link is stored and read at its own step."""
    sequences, path = _stored(spark, sf_dir), fresh_path(spark, "chains")
    expert_store.write_expert(_bases(sequences), path)
    fitted = stage(experts.fit_experts(_train(sequences), CHAIN_PLAN, ACCUM, BATCH), "experts")
    before = [(f"seed_o{o}", 0) for o in ORDERS]
    for domain, step in CHAIN:
        names = [f"{domain}_o{o}" for o in ORDERS]
        plan = [(name, *base) for name, base in zip(names, before, strict=True)]
        stored = expert_store.read_experts(spark, path, before)
        grown = experts.continue_experts(stored, fitted.where(F.col("expert").isin(names)), plan)
        expert_store.write_expert(grown, path, step)
        before = [(name, step) for name in names]
    links = [(f"{d}_o{o}", s) for d, s in CHAIN for o in ORDERS]
    back = expert_store.read_experts(spark, path, links)
    return back.select("expert", *_big("step", "order", "ctx2", "ctx1", "tok", "n"))


def domain_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted from the stored, filled files of packed sequences."""
    path = fresh_path(spark, "packed")
    packed.write_packed(_packed(spark, sf_dir), path, SAMPLES_PER_FILE)
    train = packed.read_packed(spark, path, "domain=*/split=train")
    narrow = train.withColumns({c: F.col(c).cast("array<int>") for c in ("input_ids", "label")})
    return _count_rows(experts.fit_experts(narrow, PLAN, ACCUM, BATCH))


def _per_sequence(scores: DataFrame) -> DataFrame:
    summed = scores.groupBy("domain", "split", *_big("seq_id"), "expert").agg(
        F.count("*").alias("n_tokens"),
        F.sum("log_prob").alias("log_likelihood"),
        F.sum(F.col("log_prob") * (F.col("pos") + 1)).alias("placed"),
    )
    return _rounded(summed, 5, "log_likelihood", "placed")


def expert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_sequence(_scores(spark, sf_dir))


def bucketed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split scored in a job of its own against experts that are stored once."""
    sequences, path = _stored(spark, sf_dir), fresh_path(spark, "bucketed")
    bucketed.write_bucketed(stage(experts.fit_experts(_train(sequences), PLAN, ACCUM, BATCH), "experts"), path)
    parts = [
        experts.score_from_store(sequences.where(F.col("split") == split), path, EXPERTS, VOCAB_SIZE)
        for split in ("train", "validation", "test")
    ]
    return _per_sequence(experts.by_expert(parts[0].unionByName(parts[1]).unionByName(parts[2]), EXPERTS))


# ---- evaluation and ensembles ---------------------------------------------------------------------------------


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ensemble.logits_to_log_prob(table, "embedding", "label")


def logit_log_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_logits(spark, sf_dir).select("vec_id", *_big("label"), "log_prob"), 6, "log_prob")


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _logits(spark, sf_dir).select(*_big("label"), "log_prob")
    parts = [
        ensemble.cross_entropy(logits, LOGIT_DOMAIN, reduction).withColumn("reduction", F.lit(reduction))
        for reduction in ("mean", "sum")
    ]
    each = ensemble.cross_entropy(logits, reduction="none").groupBy("label").agg(F.max("loss").alias("loss"))
    parts.append(each.withColumn("reduction", F.lit("none_max")))
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5, "loss")


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    return _rounded(ensemble.perplexity(scores, ("domain", "split", "expert")), 4, "perplexity")


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each validation domain under every domain's expert at several steps, from one scoring job."""
    held = experts.by_expert(_scored(spark, sf_dir, CURVE_PLAN, "validation"), [p[0] for p in CURVE_PLAN])
    return _rounded(ensemble.perplexity(held, ("domain", "expert")), 4, "perplexity")


def ens_simple_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ensemble.ensemble_simple_avg(_scored(spark, sf_dir), EXPERTS), 4, "perplexity")


def expert_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    posterior = ensemble.expert_posterior(_scored(spark, sf_dir), EXPERTS)
    summed = posterior.groupBy("domain", "split", *_big("seq_id"), "expert").agg(
        F.count("*").alias("n_tokens"),
        F.avg(F.exp("log_post")).alias("mean_weight"),
        F.sum(F.col("log_post")).alias("sum_log_post"),
    )
    return _rounded(summed, 5, "mean_weight", "sum_log_post")


def ens_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ensemble.ensemble_uniform_prior(_scored(spark, sf_dir), EXPERTS), 4, "perplexity")


def seq_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    posterior = ensemble.sequence_posterior(_scored(spark, sf_dir), EXPERTS)
    wanted = posterior.select("domain", "split", *_big("seq_id"), "expert", "log_likelihood", "log_post")
    return _rounded(wanted, 5, "log_likelihood", "log_post")


def cached_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = ensemble.cached_prior(_scored(spark, sf_dir), EXPERTS, PRIOR_SEQUENCES, DECAY)
    return _rounded(prior, 5, "log_prior")


def ens_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scored(spark, sf_dir)
    return _rounded(
        ensemble.ensemble_cached_prior(scores, EXPERTS, k=PRIOR_SEQUENCES, decay=DECAY), 4, "perplexity"
    )


def ens_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = _stored(spark, sf_dir)
    counts = stage(experts.fit_experts(_train(sequences), PLAN, ACCUM, BATCH), "experts")
    scores = experts.score_sequences(sequences, counts, EXPERTS, VOCAB_SIZE)
    first = experts.score_sequences(rows.first_sequences(sequences, PRIOR_SEQUENCES), counts, EXPERTS, VOCAB_SIZE)
    return ensemble.ensemble_report(scores, EXPERTS, DOMAINS, PRIOR_SEQUENCES, DECAY, prior_scores=first)


def ens_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scored(spark, sf_dir, SETUP_PLAN)
    compared = ensemble.compare_ensembles(scores, [p[0] for p in SETUP_PLAN], ENSEMBLES, PRIOR_SEQUENCES, DECAY)
    return _rounded(compared, 4, "perplexity")


# ---- training metrics -----------------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rank = F.pmod("user_id", F.lit(METRIC_WORLD)).cast("int")
    logged = events.select("event_id", rank.alias("rank"), F.col("value").alias("loss"), F.second("ts").alias("seconds"))
    micro = rows.with_index(logged, ["event_id"], ["rank"], name="micro")
    return metrics.metrics_rollup(micro, METRIC_INTERVAL, ACCUM, METRIC_WORLD)


def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = _metrics(spark, sf_dir)
    return _rounded(rolled.select(*_big("step"), "train_loss", "time_per_step"), 8, "train_loss", "time_per_step")


def lr_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("step")
    rates = _metrics(spark, sf_dir).select(
        *_big("step"),
        metrics.warmup_rate(step, 0.5, 200).alias("warmup"),
        metrics.cosine_rate(step, 0.5, 0.05, 200, 1000).alias("cosine"),
    )
    return _rounded(rates, 8, "warmup", "cosine")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        corpus_scan, drop_empty, conversation_text, packed_roundtrip, file_manifest, first_from_store, pack_appended, verified_manifest, shuffle_in_place, overwrite_roundtrip,
        ignore_roundtrip, expert_catalog, expert_roundtrip,
        doc_index, null_domain_index, row_key_index, turn_index, shard_sizes, split_sizes, shuffled_rank, shuffled_rows, shuffle_packed, epoch_order, reshard_sizes, batches,
        eval_limit, first_sequences, train_schedule, times_seen, snapshot_counts,
        vocab, vocab_summary, encode_docs, token_offsets, pack_sequences, label_shift, training_pairs, token_stats,
        seed_counts, suffix_counts, snapshot_deltas, continued_counts, expert_chains, domain_experts, expert_scores, bucketed_scores,
        logit_log_prob, cross_entropy, perplexity, learning_curve, ens_simple_avg, expert_posterior, ens_uniform, seq_posterior,
        cached_prior, ens_cached, ens_report, ens_compare,
        metrics_rollup, lr_column,
    )
}
