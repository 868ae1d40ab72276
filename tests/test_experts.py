import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.operators import ensemble
from packloom.operators import experts as X
from packloom.operators.tokens import training_pairs
from packloom.sources import bucketed

V = 6


def packed_frame(spark, sequences):
    """``sequences``: (domain, split, rank, chunk, tokens)."""
    rows = [(d, s, r, c, c, t[:-1], t[1:]) for d, s, r, c, t in sequences]
    return spark.createDataFrame(
        rows,
        "domain string, split string, rank int, chunk bigint, seq_id bigint, "
        "input_ids array<int>, label array<int>",
    )


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(3)
    return [(d, "train", 0, c, [rng.choices(range(V), w)[0] for _ in range(9)])
            for d, w in (("a", [9, 5, 1, 1, 1, 1]), ("b", [1, 1, 1, 1, 5, 9])) for c in range(8)]


def brute_counts(sequences, order):
    counts = Counter()
    for _, _, _, _, t in sequences:
        for i in range(1, len(t)):
            counts[(0, None, None, t[i])] += 1
            if order >= 1:
                counts[(1, None, t[i - 1], t[i])] += 1
            if order >= 2 and i >= 2:
                counts[(2, t[i - 2], t[i - 1], t[i])] += 1
    return counts


def brute_log_prob(counts, w, x, y, alpha=0.1, beta=1.0):
    total = sum(n for k, n in counts.items() if k[0] == 0)
    p = (counts[(0, None, None, y)] + alpha) / (total + alpha * V)
    seen = sum(counts[(1, None, x, t)] for t in range(V))
    p = (counts[(1, None, x, y)] + beta * p) / (seen + beta)
    if w is not None:
        seen = sum(counts[(2, w, x, t)] for t in range(V))
        p = (counts[(2, w, x, y)] + beta * p) / (seen + beta)
    return math.log(p)


def as_counter(df):
    return {(r.expert, r.order, r.ctx2, r.ctx1, r.tok): r.n for r in df.collect()}


def named(counts, expert):
    return {(expert, *k): n for k, n in counts.items()}


def fitted(spark, sequences, plan):
    return X.fit_experts(packed_frame(spark, sequences), plan, accum=1, batch_size=len(sequences))


PLAN = [("a0", "a", 0, 1), ("b1", "b", 1, 1), ("b2", "b", 2, 1)]


def plan_counts(sequences):
    return {e: brute_counts([s for s in sequences if s[0] == d], o) for e, d, o, _ in PLAN}


@pytest.mark.parametrize("order", [0, 1, 2])
def test_fitting_counts_all_orders_up_to_the_capacity(spark, sequences, order):
    pairs = training_pairs(packed_frame(spark, sequences)).withColumn("expert", F.lit("e"))
    assert as_counter(X.fit_expert(pairs, order)) == named(brute_counts(sequences, order), "e")


def test_positions_are_counted_by_their_longest_n_gram(spark, sequences, plan_of):
    """Shorter n-grams come from distinct longer ones, so what is counted first is a row per position, also of mixed capacities."""
    pairs = stage(training_pairs(packed_frame(spark, sequences)), "pairs").withColumn("capacity", F.col("pos") % 3)
    counted = X.fit_expert(pairs.withColumn("expert", F.lit("e")), F.col("capacity"), F.lit(2))
    lines = plan_of(counted).splitlines()
    below = max(n for n, line in enumerate(lines) if "Exchange" in line)
    assert not [line for line in lines[below:] if "Generate" in line]
    expected = Counter()
    for _, _, _, _, t in sequences:
        for i in range(1, len(t)):
            capacity = (i - 1) % 3
            for key in [(0, None, None, t[i]), (1, None, t[i - 1], t[i]), (2, t[i - 2], t[i - 1], t[i])][: capacity + 1]:
                expected[key] += 2
    assert as_counter(counted) == named(expected, "e")


def test_a_seed_of_every_capacity_from_one_count(spark, sequences):
    from packloom.plans import registry

    packed = packed_frame(spark, sequences)
    expected = {}
    for order in registry.ORDERS:
        expected |= named(brute_counts(sequences, order), f"seed_o{order}")
    got = registry._bases(packed)
    assert as_counter(got) == expected and {r.step for r in got.collect()} == {0}


def test_plan_gives_each_expert_its_domain_size_and_budget(spark, sequences):
    expected = {}
    for expert, counts in plan_counts(sequences).items():
        expected |= named(counts, expert)
    assert as_counter(fitted(spark, sequences, PLAN)) == expected
    # three micro-batches of 3 + 3 + 2 sequences, budget of four: the first batch is seen twice
    budgeted = X.fit_experts(packed_frame(spark, sequences), [("a1", "a", 1, 2)], accum=2, batch_size=3)
    mine = [s for s in sequences if s[0] == "a"]
    assert as_counter(budgeted) == named(brute_counts(mine + mine[:3], 1), "a1")


def test_each_expert_continues_from_its_own_base(spark, sequences):
    pairs = training_pairs(packed_frame(spark, sequences))
    seeds = [X.fit_expert(pairs.withColumn("expert", F.lit(f"seed{o}")), o).withColumn("step", F.lit(o)) for o in (1, 2)]
    extra = fitted(spark, sequences, PLAN)
    plan = [("b1", "seed1", 1), ("b2", "seed2", 2), ("a0", "seed1", 9)]
    continued = as_counter(X.continue_experts(seeds[0].unionByName(seeds[1]), extra, plan))
    for expert, counts in plan_counts(sequences).items():
        base = {"a0": Counter(), "b1": brute_counts(sequences, 1), "b2": brute_counts(sequences, 2)}[expert]
        assert {k: n for k, n in continued.items() if k[0] == expert} == named(counts + base, expert)


def test_scores_equal_the_formula(spark, sequences):
    names = [p[0] for p in PLAN]
    counts = fitted(spark, sequences, PLAN)
    pairs = training_pairs(packed_frame(spark, sequences), "domain", "split", "seq_id")
    brute = plan_counts(sequences)
    expected = {}
    for d, _, _, c, t in sequences:
        for pos in range(len(t) - 1):
            w = t[pos - 1] if pos else None
            for e in names:
                expected[(d, c, pos, e)] = brute_log_prob(brute[e], w, t[pos], t[pos + 1])
    scores = X.score(pairs, counts, names, V)
    got = {(r.domain, r.seq_id, r.pos, r.expert): r.log_prob for r in scores.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_positions_meet_their_n_gram_without_strings(spark, sequences, plan_of):
    pairs = training_pairs(packed_frame(spark, sequences), "domain", "split", "seq_id")
    plan = plan_of(X.score_positions(pairs, fitted(spark, sequences, PLAN), ["a0", "b1", "b2"], V))
    for line in plan.splitlines():
        if "Exchange hashpartitioning(ctx2" in line:
            assert "domain" not in line and "split" not in line


def test_probabilities_sum_to_one(spark, sequences):
    grid = spark.range(V**3).select(
        F.floor(F.col("id") / (V * V)).cast("int").alias("ctx2"),
        F.floor(F.col("id") / V % V).cast("int").alias("ctx1"),
        (F.col("id") % V).cast("int").alias("tok"),
        F.lit(1).cast("bigint").alias("uses"),
    )
    names = [p[0] for p in PLAN]
    scored = X.gram_log_probs(grid, fitted(spark, sequences, PLAN), names, V)
    sums = scored.groupBy("ctx2", "ctx1").agg(*[F.sum(F.exp(F.get("log_probs", i))).alias(e) for i, e in enumerate(names)])
    for row in sums.collect():
        assert [row[e] for e in names] == pytest.approx([1.0] * 3)


def scored(df):
    return sorted((r.domain, r.seq_id, r.pos, [round(x, 12) for x in r.log_probs]) for r in df.collect())


def test_sequences_are_laid_out_once(spark, sequences, plan_of):
    """Scoring sequences gives what scoring their positions gives, and reads the positions from one staged table."""
    names = [p[0] for p in PLAN]
    counts, packed = stage(fitted(spark, sequences, PLAN), "experts"), packed_frame(spark, sequences)
    by_sequence = X.score_sequences(packed, counts, names, V)
    pairs = training_pairs(packed, "domain", "split", "seq_id")
    assert scored(by_sequence) == scored(X.score_positions(pairs, counts, names, V))
    assert "Generate" not in plan_of(by_sequence)
    assert any("/positions-" in file for file in by_sequence.inputFiles())


def test_counts_are_looked_up_where_the_positions_lie(spark, sequences, plan_of, monkeypatch, tmp_path):
    """Neither scoring nor grouping by sequence afterwards exchanges positions; larger counts give the same by exchanges."""
    names, path = [*(p[0] for p in PLAN), "none"], str(tmp_path / "store")
    packed = packed_frame(spark, [*sequences, (None, "train", 0, 0, [0, 1, 2, 3, 4, 5, 0, 1, 2])])
    counts = stage(fitted(spark, sequences, PLAN), "experts")
    bucketed.write_bucketed(counts, path)
    both = lambda: [X.score_sequences(packed, counts, names, V), X.score_from_store(packed, path, names, V)]
    rows = lambda df: {(r.domain, r.seq_id, r.pos): tuple(r.log_probs) for r in df.collect()}
    want = []
    for scores in both():
        plan = plan_of(ensemble.expert_posterior(scores, names))
        assert "SortMergeJoin" not in plan and not [x for x in plan.splitlines() if "Exchange" in x and "seq_id" in x]
        want.append(rows(scores))
    assert want[0] == want[1] and len(want[0]) == 17 * 8
    monkeypatch.setattr(X, "IN_PLACE_BYTES", 0)
    for scores in both():
        got = rows(scores)
        assert got.keys() == want[0].keys() and all(got[k] == pytest.approx(want[0][k], abs=1e-12) for k in got)
    bucketed.forget_bucketed(spark, path)


@pytest.fixture
def without_broadcasts(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def above_scans(plan, mark):
    """Operators between the root and each line of a plan tree that has ``mark``, nearest first."""
    lines = [(len(line) - len(line.lstrip(" :+-")), line.strip(" :+-")) for line in plan.splitlines()]
    for n, (depth, text) in enumerate(lines):
        if mark in text:
            path = []
            for before, other in reversed(lines[:n]):
                if before < depth:
                    depth = before
                    path.append(other)
            yield path


def test_stored_experts_stay_where_they_lie(spark, sequences, plan_of, tmp_path, without_broadcasts):
    names, path = [p[0] for p in PLAN], str(tmp_path / "store")
    counts, packed = stage(fitted(spark, sequences, PLAN), "experts"), packed_frame(spark, sequences)
    bucketed.write_bucketed(counts, path, buckets=8)
    want = scored(X.score_sequences(packed, counts, names, V))
    for known in (True, False):  # by the session that wrote the store, and by one that has to open it
        if not known:
            bucketed.forget_bucketed(spark, path)
        from_store = X.score_from_store(packed, path, names, V)
        assert scored(from_store) == want
        plan = plan_of(from_store)
        found = 0
        for table in bucketed.KEYS:
            for operators in above_scans(plan, f"{bucketed.table_name(path, table)}["):
                found += 1
                join = next(n for n, text in enumerate(operators) if "Join" in text)
                assert not [text for text in operators[:join] if "Exchange" in text]
        assert found >= len(bucketed.KEYS)
    bucketed.forget_bucketed(spark, path)


def test_an_expert_that_the_store_lacks_counts_nothing(spark, sequences, tmp_path):
    path, packed = str(tmp_path / "store"), packed_frame(spark, sequences)
    bucketed.write_bucketed(stage(fitted(spark, sequences, PLAN[:1]), "experts"), path)
    row = X.score_from_store(packed, path, ["a0", "none"], V).first()
    assert row.log_probs[1] == pytest.approx(math.log(1 / V))
    bucketed.forget_bucketed(spark, path)
