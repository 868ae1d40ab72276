"""Evaluation of experts and of their ensembles.

``scores`` is either long, ``(*by, seq_id, pos, expert, log_prob)``, or one row per position with ``log_probs``, an
array in the order of ``experts``; the second saves a regrouping. Every expert scores every position. The ensemble
operators work on one row per position with a column per expert. Where positions before matter they exchange those
rows once, by sequence: running likelihoods, posteriors and all three ways of combining experts share that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.index import join_null_safe
from packloom.functions.numeric import log_add_exp, log_softmax, log_sum_exp, log_sum_exp_columns
from packloom.operators.rows import first_sequences

DOMAIN = ("domain", "split")
METHODS = ("simple_avg", "uniform_prior", "cached_prior")


def logits_to_log_prob(df: DataFrame, logits: str, label: str, name: str = "log_prob") -> DataFrame:
    """Log-softmax of an array of logits at a 0-based label."""
    scores = F.col(logits).cast("array<double>")
    return df.withColumn(name, F.get(scores, F.col(label)) - log_sum_exp(scores))


def cross_entropy(df: DataFrame, by: Sequence[str] = (), reduction: str = "mean", log_prob: str = "log_prob") -> DataFrame:
    """Negative log-probability as mean or sum per group, or per row with ``none``."""
    loss = -F.col(log_prob)
    if reduction == "none":
        return df.withColumn("loss", loss)
    reduce = {"mean": F.avg, "sum": F.sum}[reduction]
    return df.groupBy(*by).agg(reduce(loss).alias("loss"))


def perplexity(df: DataFrame, by: Sequence[str], log_prob: str = "log_prob") -> DataFrame:
    """``exp`` of the mean loss over tokens (not over batches) per group."""
    mean_loss = -F.sum(log_prob) / F.count("*")
    return df.groupBy(*by).agg(F.count("*").alias("n_tokens"), F.exp(mean_loss).alias("perplexity"))


def _slots(prefix: str, experts: Sequence[str]) -> list[Column]:
    return [F.col(f"{prefix}_{i}") for i in range(len(experts))]


def _wide(scores: DataFrame, experts: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per position with ``lp_i`` for expert i; NULL where an expert does not take part."""
    if "log_probs" in scores.columns:
        return scores.select(
            *by, "seq_id", "pos", *[F.get("log_probs", i).alias(f"lp_{i}") for i in range(len(experts))]
        )
    log_probs = [F.max(F.when(F.col("expert") == e, F.col("log_prob"))).alias(f"lp_{i}") for i, e in enumerate(experts)]
    return scores.groupBy(*by, "seq_id", "pos").agg(*log_probs)


def _with_history(scores: DataFrame, experts: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``_wide`` partitioned by sequence, with ``ll_i``, the sum of ``lp_i`` over earlier positions."""
    earlier = Window.partitionBy(*by, "seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return _wide(scores.repartition(*by, "seq_id"), experts, by).withColumns(
        {
            f"ll_{i}": F.when(lp.isNotNull(), F.coalesce(F.sum(lp).over(earlier), F.lit(0.0)))
            for i, lp in enumerate(_slots("lp", experts))
        }
    )


def _with_prior(wide: DataFrame, prior: DataFrame | None, experts: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds ``prior_i``; without a prior all experts weigh the same. Priors, a row per group, go to every task."""
    if prior is None:
        return wide.withColumns({f"prior_{i}": F.lit(0.0) for i in range(len(experts))})
    priors = [F.max(F.when(F.col("expert") == e, F.col("log_prior"))).alias(f"prior_{i}") for i, e in enumerate(experts)]
    return join_null_safe(wide, F.broadcast(prior.groupBy(*by).agg(*priors)), by)


def _average(log_probs: Sequence[Column]) -> Column:
    """Mean of the experts' log-probabilities: a geometric mean, not renormalised."""
    present = sum((lp.isNotNull().cast("int") for lp in log_probs), F.lit(0))
    return sum((F.coalesce(lp, F.lit(0.0)) for lp in log_probs), F.lit(0.0)) / present


def _mixture(log_probs: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Log of the posterior-weighted mean probability; ``weights`` are unnormalised log weights."""
    joint = [w + lp for w, lp in zip(weights, log_probs, strict=True)]
    return log_sum_exp_columns(joint) - log_sum_exp_columns(weights)


def _weights(experts: Sequence[str], prior: str = "prior") -> list[Column]:
    return [p + ll for p, ll in zip(_slots(prior, experts), _slots("ll", experts), strict=True)]


def ensemble_simple_avg(scores: DataFrame, experts: Sequence[str], by: Sequence[str] = DOMAIN) -> DataFrame:
    """Perplexity of the averaged log-probabilities; the average needs only the label's entry."""
    return perplexity(_wide(scores, experts, by).select(*by, _average(_slots("lp", experts)).alias("log_prob")), by)


def expert_posterior(
    scores: DataFrame, experts: Sequence[str], prior: DataFrame | None = None, by: Sequence[str] = DOMAIN
) -> DataFrame:
    """Weight of each expert at each position, from the prior and the positions before it.

    Gives ``(*by, seq_id, pos, expert, log_prob, log_post)``; at position 0 the prior alone decides.
    """
    wide = _with_prior(_with_history(scores, experts, by), prior, experts, by)
    weights = _weights(experts)
    weighed = wide.withColumn("__norm", log_sum_exp_columns(weights))
    entries = [
        F.struct(F.lit(e).alias("expert"), lp.alias("log_prob"), (w - F.col("__norm")).alias("log_post"))
        for e, lp, w in zip(experts, _slots("lp", experts), weights, strict=True)
    ]
    return weighed.select(*by, "seq_id", "pos", F.inline(F.array(*entries))).where(F.col("log_prob").isNotNull())


def ensemble_mixture(
    scores: DataFrame, experts: Sequence[str], prior: DataFrame | None = None, by: Sequence[str] = DOMAIN
) -> DataFrame:
    """Perplexity of the posterior-weighted mixture, with a prior or with the uniform one."""
    wide = _with_prior(_with_history(scores, experts, by), prior, experts, by)
    return perplexity(wide.select(*by, _mixture(_slots("lp", experts), _weights(experts)).alias("log_prob")), by)


def ensemble_uniform_prior(scores: DataFrame, experts: Sequence[str], by: Sequence[str] = DOMAIN) -> DataFrame:
    """The mixture when every expert starts with the same weight."""
    return ensemble_mixture(scores, experts, None, by)


def _sequence_totals(scores: DataFrame, experts: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``ll``: each expert's log-likelihood of a whole sequence, as an array."""
    if "log_probs" in scores.columns:
        sums = [F.sum(F.get("log_probs", i)) for i in range(len(experts))]
    else:
        sums = [F.sum(F.when(F.col("expert") == e, F.col("log_prob"))) for e in experts]
    return scores.groupBy(*by, "seq_id").agg(F.array(*sums).alias("ll"))


def _add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def _names(experts: Sequence[str]) -> Column:
    return F.array(*[F.lit(e) for e in experts]).alias("expert")


def sequence_posterior(
    scores: DataFrame, experts: Sequence[str], prior: DataFrame | None = None, by: Sequence[str] = DOMAIN
) -> DataFrame:
    """``log_post`` of each expert after a whole sequence: log-softmax of total log-likelihood plus prior."""
    totals = _with_prior(_sequence_totals(scores, experts, by), prior, experts, by)
    posterior = log_softmax(_add(F.col("ll"), F.array(*_slots("prior", experts))))
    entries = F.arrays_zip(_names(experts), F.col("ll").alias("log_likelihood"), posterior.alias("log_post"))
    return totals.select(*by, "seq_id", F.inline(entries))


def _prior_steps(scores: DataFrame, experts: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    """``steps``: the first ``k`` sequences' log-likelihoods of each group in order, one number per expert."""
    totals = _sequence_totals(first_sequences(scores, k), experts, by)
    return totals.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("seq_id", "ll")))["ll"].alias("steps"))


def _folded_prior(steps: Column, size: int, decay: float) -> Column:
    """Log-softmax of the fold over ``steps``, arrays of ``size`` log-likelihoods."""
    start = F.struct(F.lit(0).alias("n"), F.array(*[F.lit(0.0)] * size).alias("prior"))

    def update(state: Column, log_likelihood: Column) -> Column:
        n = state["n"] + 1
        posterior = log_softmax(_add(log_likelihood, state["prior"]))
        faded = F.transform(state["prior"], lambda x: x + n * F.log(F.lit(decay)))
        return F.struct(n.alias("n"), F.zip_with(faded, posterior, log_add_exp).alias("prior"))

    return log_softmax(F.aggregate(steps, start, update, lambda state: state["prior"]))


def _members_of(steps: Column, taken: Sequence[int]) -> Column:
    """The chosen entries of every step."""
    return F.transform(steps, lambda ll: F.array(*[ll[i] for i in taken]))


def cached_prior(
    scores: DataFrame, experts: Sequence[str], k: int, decay: float = 0.3, by: Sequence[str] = DOMAIN
) -> DataFrame:
    """Prior of each domain from its first ``k`` sequences: ``(*by, expert, log_prior)``.

    A fold in sequence order. Sequence n replaces the prior by its posterior plus the old prior times ``decay ** n``,
    so what came before fades ever faster. What is gathered per domain is k rows of one number per expert.
    """
    gathered = _prior_steps(scores, experts, k, by)
    prior = _folded_prior(F.col("steps"), len(experts), decay)
    entries = F.arrays_zip(_names(experts), prior.alias("log_prior"))
    return gathered.select(*by, F.inline(entries)).where(F.col("log_prior").isNotNull())


def ensemble_cached_prior(
    scores: DataFrame,
    experts: Sequence[str],
    k: int,
    prior_scores: DataFrame | None = None,
    decay: float = 0.3,
    by: Sequence[str] = DOMAIN,
) -> DataFrame:
    """The mixture under each domain's cached prior, by default taken from the same evaluation data."""
    prior = cached_prior(scores if prior_scores is None else prior_scores, experts, k, decay, by)
    return ensemble_mixture(scores, experts, prior, by)


def ensemble_losses(
    scores: DataFrame,
    experts: Sequence[str],
    k: int,
    decay: float = 0.3,
    by: Sequence[str] = DOMAIN,
    prior_scores: DataFrame | None = None,
) -> DataFrame:
    """``(*by, method, n_tokens, perplexity)`` for all three methods from one pass over the scores.

    The prior takes its first ``k`` sequences from ``prior_scores`` where given: scores of those sequences alone spare a
    second reading of all.
    """
    prior = cached_prior(scores if prior_scores is None else prior_scores, experts, k, decay, by)
    wide = _with_prior(_with_history(scores, experts, by), prior, experts, by)
    log_probs = _methods(_slots("lp", experts), _slots("ll", experts), _weights(experts))
    sums = wide.groupBy(*by).agg(F.count("*").alias("n_tokens"), *[F.sum(lp).alias(m) for m, lp in log_probs.items()])
    entries = F.array(*[_loss(m, F.col(m)) for m in METHODS])
    return sums.select(*by, "n_tokens", F.inline(entries))


def _methods(log_probs: Sequence[Column], likelihoods: Sequence[Column], weights: Sequence[Column]) -> dict[str, Column]:
    """Log-probability of a position by each method."""
    return {
        "simple_avg": _average(log_probs),
        "uniform_prior": _mixture(log_probs, likelihoods),
        "cached_prior": _mixture(log_probs, weights),
    }


def _loss(method: str, total: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), F.exp(-total / F.col("n_tokens")).alias("perplexity"))


def ensemble_report(
    scores: DataFrame,
    experts: Sequence[str],
    domains: Sequence[str],
    k: int,
    decay: float = 0.3,
    by: Sequence[str] = DOMAIN,
    prior_scores: DataFrame | None = None,
) -> DataFrame:
    """Perplexity to one decimal, a row per method (and other keys of ``by``) and a column per domain."""
    rest = [c for c in by if c != "domain"]
    losses = ensemble_losses(scores, experts, k, decay, by, prior_scores)
    return (
        losses.groupBy("method", *rest)
        .pivot("domain", list(domains))
        .agg(F.round(F.first("perplexity"), 1))
    )


def compare_ensembles(
    scores: DataFrame,
    experts: Sequence[str],
    ensembles: dict[str, Sequence[str]],
    k: int,
    decay: float = 0.3,
    by: Sequence[str] = DOMAIN,
) -> DataFrame:
    """Several ensembles on the same evaluation data in one job: ``(ensemble, *by, method, n_tokens, perplexity)``.

    Positions are exchanged once, by sequence, with a column per distinct expert; histories are shared, and every
    ensemble's sums are columns of one aggregate that is unfolded afterwards. The sequences that priors come from are
    gathered once for all ensembles; the priors, a row per group, go to every task.
    """
    at = {e: i for i, e in enumerate(experts)}
    places = {name: [at[e] for e in members] for name, members in ensembles.items()}
    priors = _prior_steps(scores, experts, k, by)
    chosen = {
        f"prior_{j}": _folded_prior(_members_of(F.col("steps"), taken), len(taken), decay)
        for j, taken in enumerate(places.values())
    }
    wide = join_null_safe(_with_history(scores, experts, by), F.broadcast(priors.withColumns(chosen).drop("steps")), by)
    sums = {}
    for j, taken in enumerate(places.values()):
        log_probs, likelihoods = [F.col(f"lp_{i}") for i in taken], [F.col(f"ll_{i}") for i in taken]
        weights = [F.get(f"prior_{j}", n) + ll for n, ll in enumerate(likelihoods)]
        sums |= {f"{m}_{j}": F.sum(lp) for m, lp in _methods(log_probs, likelihoods, weights).items()}
    totals = wide.groupBy(*by).agg(F.count("*").alias("n_tokens"), *[s.alias(c) for c, s in sums.items()])
    entries = [
        F.struct(F.lit(name).alias("ensemble"), F.array(*[_loss(m, F.col(f"{m}_{j}")) for m in METHODS]).alias("losses"))
        for j, name in enumerate(ensembles)
    ]
    unfolded = totals.select(*by, "n_tokens", F.inline(F.array(*entries)))
    return unfolded.select("ensemble", *by, "n_tokens", F.inline("losses"))
