import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.operators import ensemble as N

EXPERTS = ["x", "y", "z"]


def log_softmax(v):
    top = v.max()
    return v - top - np.log(np.exp(v - top).sum())


def make_scores(seed=0, scale=3.0, experts=3, sequences=5, length=4):
    rng = np.random.default_rng(seed)
    return {d: -rng.gamma(2.0, scale, (sequences, length, experts)) for d in ("p", "q")}


def long_frame(spark, data, experts=EXPERTS):
    rows = [
        (d, "test", s, t, experts[e], float(a[s, t, e]))
        for d, a in data.items() for s in range(a.shape[0]) for t in range(a.shape[1]) for e in range(a.shape[2])
    ]
    return spark.createDataFrame(
        rows, "domain string, split string, seq_id bigint, pos int, expert string, log_prob double"
    ).repartition(4)


def wide_frame(spark, data):
    rows = [
        (d, "test", s, t, [float(x) for x in a[s, t]])
        for d, a in data.items() for s in range(a.shape[0]) for t in range(a.shape[1])
    ]
    return spark.createDataFrame(
        rows, "domain string, split string, seq_id bigint, pos int, log_probs array<double>"
    ).repartition(4)


def brute_prior(a, k, decay):
    prior = np.zeros(a.shape[2])
    for n, sequence in enumerate(a[:k], start=1):
        posterior = log_softmax(sequence.sum(axis=0) + prior)
        prior = np.logaddexp(n * math.log(decay) + prior, posterior)
    return log_softmax(prior)


def brute_posterior(a, prior):
    history = np.cumsum(a, axis=1) - a
    return np.apply_along_axis(log_softmax, 2, history + prior)


def brute_mixture(a, prior):
    joint = brute_posterior(a, prior) + a
    return math.exp(-np.logaddexp.reduce(joint, axis=2).mean())


def by_domain(df):
    return {r.domain: r.perplexity for r in df.collect()}


@pytest.fixture(params=["long", "wide"])
def frame(request, spark):
    build = long_frame if request.param == "long" else wide_frame
    return lambda data: build(spark, data)


def test_three_ways_of_combining(frame):
    data = make_scores()
    scores = frame(data)
    simple = by_domain(N.ensemble_simple_avg(scores, EXPERTS))
    uniform = by_domain(N.ensemble_uniform_prior(scores, EXPERTS))
    cached = by_domain(N.ensemble_cached_prior(scores, EXPERTS, k=3, decay=0.3))
    losses = {(r.domain, r.method): r.perplexity for r in N.ensemble_losses(scores, EXPERTS, 3, 0.3).collect()}
    for d, a in data.items():
        expected = [math.exp(-a.mean()), brute_mixture(a, 0.0), brute_mixture(a, brute_prior(a, 3, 0.3))]
        assert [simple[d], uniform[d], cached[d]] == pytest.approx(expected, rel=1e-9)
        assert [losses[(d, m)] for m in N.METHODS] == pytest.approx(expected, rel=1e-9)


def test_posterior_looks_only_at_earlier_positions(frame):
    data = make_scores(1)
    scores = frame(data)
    prior = N.cached_prior(scores, EXPERTS, k=2)
    got = {(r.domain, r.seq_id, r.pos, r.expert): r.log_post
           for r in N.expert_posterior(scores, EXPERTS, prior).collect()}
    for d, a in data.items():
        start = brute_prior(a, 2, 0.3)
        expected = brute_posterior(a, start)
        for s in range(a.shape[0]):
            assert [got[(d, s, 0, e)] for e in EXPERTS] == pytest.approx(list(start))
            for t in range(a.shape[1]):
                row = [got[(d, s, t, e)] for e in EXPERTS]
                assert row == pytest.approx(list(expected[s, t])) and sum(map(math.exp, row)) == pytest.approx(1)


def test_sequence_posterior_and_prior(frame):
    data = make_scores(2)
    scores = frame(data)
    prior = N.cached_prior(scores, EXPERTS, k=100)
    kept = {(r.domain, r.expert): r.log_prior for r in prior.collect()}
    for with_prior in (None, prior):
        got = {(r.domain, r.seq_id, r.expert): r.log_post
               for r in N.sequence_posterior(scores, EXPERTS, with_prior).collect()}
        for d, a in data.items():
            start = brute_prior(a, 100, 0.3)
            assert [kept[(d, e)] for e in EXPERTS] == pytest.approx(list(start))
            for s in range(a.shape[0]):
                expected = log_softmax(a[s].sum(axis=0) + (0.0 if with_prior is None else start))
                assert [got[(d, s, e)] for e in EXPERTS] == pytest.approx(list(expected))


def test_extreme_likelihoods_stay_finite(frame):
    data = make_scores(3, scale=50.0, length=30)
    scores = frame(data)
    losses = {(r.domain, r.method): r.perplexity for r in N.ensemble_losses(scores, EXPERTS, 5, 0.3).collect()}
    log_posts = [r.log_post for r in N.expert_posterior(scores, EXPERTS).collect()]
    assert all(x is not None and math.isfinite(x) for x in log_posts)
    for d, a in data.items():
        joint = brute_posterior(a, brute_prior(a, 5, 0.3)) + a
        expected = -np.logaddexp.reduce(joint, axis=2).mean()
        assert math.log(losses[(d, "cached_prior")]) == pytest.approx(expected)


def test_one_expert_or_equal_experts_make_all_methods_agree(spark):
    single = make_scores(4, experts=1)
    alone = long_frame(spark, single, ["x"])
    lone = {r.domain: r.perplexity for r in N.perplexity(alone, ("domain", "expert")).collect()}
    for r in N.ensemble_losses(alone, ["x"], 4).collect():
        assert r.perplexity == pytest.approx(lone[r.domain])
    equal = long_frame(spark, {d: np.repeat(a, 3, axis=2) for d, a in single.items()})
    for r in N.ensemble_losses(equal, EXPERTS, 4).collect():
        assert r.perplexity == pytest.approx(lone[r.domain])


def test_comparing_ensembles_of_unequal_size(spark):
    data = make_scores(5)
    ensembles = {"all": EXPERTS, "two": ["z", "x"], "one": ["y"]}
    got = {(r.ensemble, r.domain, r.method): r.perplexity
           for r in N.compare_ensembles(wide_frame(spark, data), EXPERTS, ensembles, 3).collect()}
    for name, members in ensembles.items():
        at = [EXPERTS.index(e) for e in members]
        for d, a in data.items():
            part = a[:, :, at]
            expected = [math.exp(-part.mean()), brute_mixture(part, 0.0), brute_mixture(part, brute_prior(part, 3, 0.3))]
            assert [got[(name, d, m)] for m in N.METHODS] == pytest.approx(expected)


def test_ensembles_unfold_above_the_exchange_by_sequence(spark, plan_of):
    scores = stage(wide_frame(spark, make_scores(5)), "scores")
    plan = plan_of(N.compare_ensembles(scores, EXPERTS, {"all": EXPERTS, "two": ["z", "x"]}, 3))
    lines = plan.splitlines()
    below = next(n for n, line in enumerate(lines) if "seq_id" in line and "Exchange hashpartitioning" in line)
    assert all("Generate" not in line for line in lines[below:])


def test_a_null_group_gets_its_own_prior(spark):
    rows = [(None if d == "p" else d, *rest) for d, *rest in map(tuple, long_frame(spark, make_scores(4)).collect())]
    frame = spark.createDataFrame(rows, long_frame(spark, make_scores(4)).schema)
    known = {(r.domain or "p", r.method): r.perplexity for r in N.ensemble_losses(frame, EXPERTS, 3).collect()}
    plain = {(r.domain, r.method): r.perplexity for r in N.ensemble_losses(long_frame(spark, make_scores(4)), EXPERTS, 3).collect()}
    assert known == pytest.approx(plain)


def test_report_has_a_column_per_domain(spark):
    data = make_scores(6)
    report = N.ensemble_report(wide_frame(spark, data), EXPERTS, ["p", "q", "r"], 3)
    rows = {r.method: r for r in report.collect()}
    assert rows["simple_avg"]["p"] == pytest.approx(math.exp(-data["p"].mean()), abs=0.051)
    assert set(rows) == set(N.METHODS) and rows["simple_avg"]["r"] is None


def test_posterior_exchanges_rows_once(spark, plan_of):
    data = make_scores(7)
    scores = stage(wide_frame(spark, data), "scores")
    assert plan_of(N.expert_posterior(scores, EXPERTS)).count("Exchange") == 1
    long = stage(long_frame(spark, data), "scores")
    assert plan_of(N.expert_posterior(long, EXPERTS)).count("Exchange") == 1


def test_priors_travel_to_the_positions(spark, plan_of):
    """Nothing but the exchange by sequence moves positions, also where the size of the priors is not known beforehand."""
    scores, limit = stage(wide_frame(spark, make_scores(9)), "scores"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (N.ensemble_losses(scores, EXPERTS, 3), N.compare_ensembles(scores, EXPERTS, {"all": EXPERTS}, 3)):
            assert "SortMergeJoin" not in plan_of(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_log_softmax_at_the_label_and_reductions(spark):
    rng = np.random.default_rng(8)
    logits = rng.normal(size=(6, 5)) * 300
    rows = [(i, [float(x) for x in v], i % 5) for i, v in enumerate(logits)]
    df = N.logits_to_log_prob(spark.createDataFrame(rows, "i int, v array<double>, y int"), "v", "y")
    got = {r.i: r.log_prob for r in df.collect()}
    expected = [log_softmax(v)[i % 5] for i, v in enumerate(logits)]
    assert [got[i] for i in range(6)] == pytest.approx(expected)
    assert N.cross_entropy(df).first().loss == pytest.approx(-np.mean(expected))
    assert N.cross_entropy(df, reduction="sum").first().loss == pytest.approx(-np.sum(expected))
    each = N.cross_entropy(df, reduction="none").agg(F.sum("loss").alias("s")).first().s
    assert each == pytest.approx(-np.sum(expected))
