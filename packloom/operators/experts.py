"""Count-based domain experts: fitting, continuing and scoring.

An expert is its table of n-gram counts ``(expert, order, ctx2, ctx1, tok, n)``; its capacity is the longest context
it keeps, order 0, 1 or 2. Probabilities back off with a Dirichlet prior at each level (MacKay and Peto, 1995):

    p0(y)     = (c(y) + alpha) / (N + alpha V)
    p1(y|x)   = (c(x,y) + beta p0(y)) / (c(x) + beta)
    p2(y|w,x) = (c(w,x,y) + beta p1(y|x)) / (c(w,x) + beta)

A context never counted leaves p2 = p1 and p1 = p0, so experts of any order are scored by the same expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions.staging import stage_together
from packloom.operators.rows import added_uses, times_seen
from packloom.operators.tokens import training_pairs
from packloom.sources.bucketed import KEYS, ORDERS, open_bucketed, stored_log_probs

COUNT_KEYS = ("expert", "order", "ctx2", "ctx1", "tok")
POSITION = ("domain", "split", "seq_id", "pos")
NO_TOKEN = -1
SEQUENCE = ("domain", "split", "seq_id")
#: counts that fill up to this size as hash tables are looked up where the positions lie; with larger ones n-grams are exchanged
IN_PLACE_BYTES = 512 << 20
#: about what a row of such a hash table takes beside its counts
ROW_BYTES = 80


def fit_expert(pairs: DataFrame, order: int | Column, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count n-grams of ``pairs(expert, ctx2, ctx1, tok)`` up to ``order``, which may differ by row, apart by ``by``.

    Positions are first counted by their whole n-gram, a row each; shorter ones are then summed up from these distinct
    rows. Both exchanges combine counts on the map side, so frequent n-grams do not skew them.
    """
    capacity = F.lit(order) if isinstance(order, int) else order
    nothing = F.lit(None).cast("int")

    def gram(n: int, ctx2: Column, ctx1: Column) -> Column:
        return F.struct(F.lit(n).alias("order"), ctx2.alias("ctx2"), ctx1.alias("ctx1"), F.col("tok").alias("tok"))

    grams = F.array(
        gram(0, nothing, nothing), gram(1, nothing, F.col("ctx1")), gram(2, F.col("ctx2"), F.col("ctx1"))
    )
    uses = F.lit(1) if weight is None else weight
    context = [F.when(capacity >= n, F.col(c)).alias(c) for n, c in ((2, "ctx2"), (1, "ctx1"))]
    longest = (
        pairs.select(*by, "expert", capacity.alias("capacity"), uses.alias("uses"), *context, "tok")
        .groupBy(*by, "expert", "capacity", "ctx2", "ctx1", "tok")
        .agg(F.sum("uses").alias("uses"))
    )
    return (
        longest.select(*by, "expert", "capacity", "uses", F.inline(grams))
        .where((F.col("order") <= F.col("capacity")) & ((F.col("order") < 2) | F.col("ctx2").isNotNull()))
        .groupBy(*by, *COUNT_KEYS)
        .agg(F.sum("uses").alias("n"))
    )


def continue_experts(bases: DataFrame, extra: DataFrame, plan: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Each expert of ``extra`` starts from the counts of a base of its own: ``(expert, order, ctx2, ctx1, tok, n)``.

    ``plan`` lists ``(expert, base, base_step)``; ``bases`` are stored experts with their ``step``. A base and the
    expert that continues it have the same order. An expert without a base in the plan is left as it is.
    """
    listed = extra.sparkSession.createDataFrame(list(plan), "child string, base string, base_step int")
    met = (F.col("expert") == F.col("base")) & (F.col("step") == F.col("base_step"))
    inherited = bases.join(F.broadcast(listed), met).withColumn("expert", F.col("child")).select(*COUNT_KEYS, "n")
    return inherited.unionByName(extra.select(*COUNT_KEYS, "n")).groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n"))


def fit_experts(packed: DataFrame, plan: Sequence[tuple[str, str, int, int]], accum: int, batch_size: int) -> DataFrame:
    """All experts in one job.

    ``plan`` lists ``(expert, domain, order, steps)``: each expert has its own domain, capacity and step budget.
    """
    spark = packed.sparkSession
    plan_df = spark.createDataFrame(list(plan), "expert string, domain string, `order` int, steps int")
    assigned = packed.join(F.broadcast(plan_df), "domain")
    budgeted = times_seen(assigned, F.col("steps"), accum, batch_size, ("expert", "domain", "split", "rank"))
    pairs = training_pairs(budgeted, "expert", "order", "times_seen").withColumnRenamed("order", "capacity")
    return fit_expert(pairs, F.col("capacity"), F.col("times_seen"))


def fit_deltas(
    packed: DataFrame, plan: Sequence[tuple[str, str, int]], steps: Sequence[int], accum: int, batch_size: int
) -> DataFrame:
    """What each step of training adds to the step before: ``(step, expert, order, ctx2, ctx1, tok, n)``.

    ``plan`` lists ``(expert, domain, order)``; ``steps`` rise. All experts and steps are fitted in one job, and a sequence
    takes part in a step only if it was used since the one before.
    """
    listed = packed.sparkSession.createDataFrame(list(plan), "expert string, domain string, `order` int")
    assigned = packed.join(F.broadcast(listed), "domain")
    used = added_uses(assigned, steps, accum, batch_size, ("expert", "domain", "split", "rank"))
    pairs = training_pairs(used, "step", "expert", "order", "uses").withColumnRenamed("order", "capacity")
    return fit_expert(pairs, F.col("capacity"), F.col("uses"), ("step",))


def expert_names(counts: DataFrame) -> list[str]:
    """The experts in a count table, in name order."""
    return sorted(row["expert"] for row in counts.select("expert").distinct().collect())


def _with_counts(
    asked: DataFrame, counts: DataFrame, order: int, context: Sequence[str], experts: Sequence[str]
) -> DataFrame:
    """Distinct ``(*context, tok, uses)`` rows with ``c_i`` and ``s_i``: counts of the n-gram and of its context.

    N-grams asked for and n-grams counted meet in one exchange by context instead of in joins. Both are distinct, so
    a context, however frequent, has no more rows than there are words.
    """
    columns = [f"c_{i}" for i in range(len(experts))]
    known = counts.where(F.col("order") == order).select(
        *context,
        "tok",
        F.lit(0).cast("bigint").alias("uses"),
        *[F.when(F.col("expert") == e, F.col("n")).otherwise(0).alias(c) for c, e in zip(columns, experts, strict=True)],
    )
    wanted = asked.select(*context, "tok", "uses", *[F.lit(0).cast("bigint").alias(c) for c in columns])
    in_context = Window.partitionBy(*context)
    return (
        wanted.unionByName(known)
        .repartition(*context)
        .groupBy(*context, "tok")
        .agg(F.sum("uses").alias("uses"), *[F.sum(c).alias(c) for c in columns])
        .select("*", *[F.sum(c).over(in_context).alias(f"s_{i}") for i, c in enumerate(columns)])
        .where(F.col("uses") > 0)
    )


def gram_log_probs(
    grams: DataFrame, counts: DataFrame, experts: Sequence[str], vocab_size: int, alpha: float = 0.1, beta: float = 1.0
) -> DataFrame:
    """``(ctx2, ctx1, tok, uses, log_probs)`` for distinct ``(ctx2, ctx1, tok, uses)`` rows, an entry per expert."""
    places = range(len(experts))
    unigrams = counts.where(F.col("order") == 0)
    totals = {r["expert"]: r["n"] for r in unigrams.groupBy("expert").agg(F.sum("n").alias("n")).collect()}
    by_word = unigrams.groupBy("tok").agg(
        *[F.sum(F.when(F.col("expert") == e, F.col("n")).otherwise(0)).alias(f"u_{i}") for i, e in enumerate(experts)]
    )

    def backed_off(i: int, lower: Column) -> Column:
        return (F.col(f"c_{i}") + F.lit(beta) * lower) / (F.col(f"s_{i}") + F.lit(beta))

    def p0(i: int) -> Column:
        seen = F.coalesce(f"u_{i}", F.lit(0)) + F.lit(alpha)
        return seen / F.lit(totals.get(experts[i], 0) + alpha * vocab_size)

    asked = grams.groupBy("ctx1", "tok").agg(F.sum("uses").alias("uses"))
    pairs = _with_counts(asked, counts, 1, ["ctx1"], experts).join(by_word, "tok", "left").select(
        "ctx1", "tok", *[backed_off(i, p0(i)).alias(f"p1_{i}") for i in places]
    )
    triples = _with_counts(grams, counts, 2, ["ctx2", "ctx1"], experts).join(pairs, ["ctx1", "tok"])
    log_probs = F.array(*[F.log(backed_off(i, F.col(f"p1_{i}"))) for i in places])
    return triples.select("ctx2", "ctx1", "tok", "uses", log_probs.alias("log_probs"))


def _group_codes(rows: DataFrame) -> DataFrame:
    """``(group, domain, split)``: a digest of 64 bits for each domain and split of ``rows``."""
    groups = rows.select("domain", "split").distinct().withColumn("group", F.xxhash64("domain", "split")).groupBy("group")
    clash = F.raise_error(F.lit("two pairs of domain and split share a digest")).cast("string")
    return groups.agg(F.when(F.count("*") > 1, clash).otherwise(F.first("domain")).alias("domain"), F.first("split").alias("split"))


def _scored(located: DataFrame, groups: DataFrame, table: DataFrame) -> DataFrame:
    return located.join(table, ["ctx2", "ctx1", "tok"]).join(groups, "group").select(*POSITION, "log_probs")


def _located(pairs: DataFrame) -> DataFrame:
    code = F.xxhash64("domain", "split").alias("group")
    return pairs.select(code, "seq_id", "pos", F.coalesce("ctx2", F.lit(NO_TOKEN)).alias("ctx2"), "ctx1", "tok")


def _positions(packed: DataFrame) -> DataFrame:
    """The positions of packed rows, staged so that those of a sequence lie together; only token arrays are exchanged."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = packed.repartition(parts, *SEQUENCE).sortWithinPartitions(*SEQUENCE)
    return stage_together(training_pairs(together, *SEQUENCE), "positions", SEQUENCE)


def _fit_in_place(spark: SparkSession, rows: dict[str, int], columns: dict[str, int]) -> bool:
    """Whether hash tables of so many rows and counts a row may go to every task; a session can forbid broadcasts."""
    forbidden = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    return not forbidden and sum(n * (ROW_BYTES + 8 * columns[table]) for table, n in rows.items()) <= IN_PLACE_BYTES


def _count_columns(table: str, taken: Sequence[int], n: Callable[[int], Column]) -> list[Column]:
    return [n(i).alias(f"{table}_{i}") for i in taken]


def _scored_in_place(
    positions: DataFrame,
    tables: dict[str, DataFrame],
    totals: dict[str, int],
    experts: Sequence[str],
    vocab_size: int,
    alpha: float,
    beta: float,
) -> DataFrame:
    """``score_positions`` by lookups in broadcast ``tables``, counts by the keys of ``KEYS`` in columns ``{table}_{i}``.

    Nothing is exchanged: positions stay in the order and partitioning they have. Tables hold what ``IN_PLACE_BYTES``
    admits; one that is not there counts nothing.
    """
    found = positions.where(F.col("ctx1").isNotNull() & F.col("tok").isNotNull())
    for table, counted in tables.items():
        found = found.join(F.broadcast(counted), list(KEYS[table]), "left")

    def n(table: str, i: int) -> Column:
        return F.coalesce(f"{table}_{i}", F.lit(0)) if f"{table}_{i}" in found.columns else F.lit(0)

    def log_prob(i: int) -> Column:
        p = (n("words", i) + F.lit(alpha)) / F.lit(totals.get(experts[i], 0) + alpha * vocab_size)
        for gram, context in (("pairs", "after_one"), ("triples", "after_two")):
            p = (n(gram, i) + F.lit(beta) * p) / (n(context, i) + F.lit(beta))
        return F.log(p)

    return found.select(*POSITION, F.array(*[log_prob(i) for i in range(len(experts))]).alias("log_probs"))


def score_positions(
    pairs: DataFrame,
    counts: DataFrame,
    experts: Sequence[str],
    vocab_size: int,
    alpha: float = 0.1,
    beta: float = 1.0,
) -> DataFrame:
    """``(domain, split, seq_id, pos, log_probs)``: the label's log-probability, one array entry per expert.

    Probabilities are worked out once per distinct n-gram; positions then look theirs up by an exchange on the
    n-gram, where adaptive execution splits hot ones. Domain and split travel as one digest of 64 bits and come back
    by a lookup of their distinct pairs; two pairs with the same digest would raise an error. ``pairs`` and ``counts``
    are read twice; give stored ones.
    """
    located = _located(pairs)
    grams = located.groupBy("ctx2", "ctx1", "tok").agg(F.count("*").alias("uses"))
    table = gram_log_probs(grams, counts, experts, vocab_size, alpha, beta).drop("uses")
    return _scored(located, _group_codes(pairs), table)


def score_sequences(
    packed: DataFrame,
    counts: DataFrame,
    experts: Sequence[str],
    vocab_size: int,
    alpha: float = 0.1,
    beta: float = 1.0,
) -> DataFrame:
    """``score_positions`` of packed rows, whose positions are laid out once and staged; domains come from the rows.

    Step budgets bound what experts hold, not the rows scored. While all counts fit into ``IN_PLACE_BYTES`` they go to
    every task as hash tables and positions stay where they lie, partitioned by sequence; else n-grams are exchanged.
    ``counts`` is read several times; give a stored one.
    """
    spark, positions = packed.sparkSession, _positions(packed)
    asked = counts.where(F.col("expert").isin(list(experts)))
    sizes = asked.groupBy("expert", "order").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    held = {(r["order"], r["expert"]): (r["rows"], r["n"]) for r in sizes.collect()}
    taken = {t: [i for i, e in enumerate(experts) if (o, e) in held] for t, o in ORDERS.items()}
    rows = {t: sum(held[o, experts[i]][0] for i in taken[t]) for t, o in ORDERS.items()}
    if _fit_in_place(spark, rows, {t: len(places) for t, places in taken.items()}):

        def counted(table: str) -> DataFrame:
            sums = _count_columns(table, taken[table], lambda i: F.sum(F.when(F.col("expert") == experts[i], F.col("n"))))
            return asked.where(F.col("order") == ORDERS[table]).groupBy(*KEYS[table]).agg(*sums)

        tables = {table: counted(table) for table in KEYS if taken[table]}
        totals = {e: held[0, e][1] for e in experts if (0, e) in held}
        return _scored_in_place(positions, tables, totals, experts, vocab_size, alpha, beta)
    located = _located(positions)
    grams = located.groupBy("ctx2", "ctx1", "tok").agg(F.count("*").alias("uses"))
    table = gram_log_probs(grams, counts, experts, vocab_size, alpha, beta).drop("uses")
    return _scored(located, _group_codes(packed), table)


def score_from_store(
    packed: DataFrame, path: str, experts: Sequence[str], vocab_size: int, alpha: float = 0.1, beta: float = 1.0
) -> DataFrame:
    """``score_sequences`` with the experts of a bucketed store, which stay where they lie.

    A store within ``IN_PLACE_BYTES`` is looked up by every task; with a larger one only asked n-grams are exchanged.
    """
    spark, positions = packed.sparkSession, _positions(packed)
    store = open_bucketed(spark, path)
    rows = {table: store[table].count() for table in KEYS}
    if _fit_in_place(spark, rows, dict.fromkeys(KEYS, len(experts))):

        def counted(table: str) -> DataFrame:
            of_expert = _count_columns(table, range(len(experts)), lambda i: F.try_element_at("n", F.lit(experts[i])))
            return store[table].select(*KEYS[table], *of_expert)

        totals = {r["expert"]: r["n"] for r in store["totals"].collect()}
        return _scored_in_place(positions, {table: counted(table) for table in KEYS}, totals, experts, vocab_size, alpha, beta)
    located = _located(positions)
    grams = located.select("ctx2", "ctx1", "tok").distinct()
    return _scored(located, _group_codes(packed), stored_log_probs(grams, path, experts, vocab_size, alpha, beta))


def by_expert(positions: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Long form of ``log_probs`` arrays: a row per position and expert."""
    names = F.array(*[F.lit(e) for e in experts])
    entries = F.arrays_zip(names.alias("expert"), F.col("log_probs").alias("log_prob"))
    return positions.select(*POSITION, F.inline(entries))


def score(pairs: DataFrame, counts: DataFrame, experts: Sequence[str], vocab_size: int, **options: float) -> DataFrame:
    """``(domain, split, seq_id, pos, expert, log_prob)`` of every label under every expert."""
    return by_expert(score_positions(pairs, counts, experts, vocab_size, **options), experts)
