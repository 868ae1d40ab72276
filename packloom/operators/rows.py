"""Row operators: filter, index, shard, split, shuffle, batch, schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.index import Bounds, join_null_safe, running_total
from packloom.functions.numeric import whole_div


def drop_empty(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop NULL and ``''``; text of blanks only stays."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def with_index(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "index", bounds: Bounds | None = None
) -> DataFrame:
    """Dense 0-based position in the order of the unique key ``order``, within ``by``."""
    return running_total(df, F.lit(1), order, by, name, bounds)


def shard(df: DataFrame, world_size: int, rank: int | None = None, index: str = "index") -> DataFrame:
    """``rank = index % world_size``; with ``rank`` given, only that shard is read.

    Apply before ``drop_empty``: an empty document still uses up an index.
    """
    sharded = df.withColumn("rank", F.pmod(F.col(index), F.lit(world_size)).cast("int"))
    return sharded if rank is None else sharded.where(F.col("rank") == rank)


def split_corpus(df: DataFrame, key: str, weights: tuple[int, int, int] = (8, 1, 1)) -> DataFrame:
    """Train, validation and test by a stable hash of the key, so a rerun gives the same split."""
    train, validation, test = weights
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    draw = F.pmod(digits, F.lit(train + validation + test))
    name = F.when(draw < train, "train").when(draw < train + validation, "validation").otherwise("test")
    return df.withColumn("split", name)


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds ``file_path`` and ``row_index``, a composite order key for files that carry none of their own.

    ``df`` comes straight from files; the key is the same on every read as long as they are not changed.
    """
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def shuffle_key(key: str | Sequence[str], seed: int) -> Column:
    """Random but repeatable sort key of a row; NULL parts of the key count as empty."""
    parts = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def shuffle_shard(draw: Column, shards: int) -> Column:
    """Which of ``shards`` equal stretches of the random order a key drawn by ``shuffle_key`` falls into."""
    place = F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(place * F.lit(shards), 32).cast("int")


def shuffle_rows(df: DataFrame, key: str | Sequence[str], seed: int, shards: int, parts: int = 1) -> DataFrame:
    """Random order over the whole table, with ``shard``: ``shards`` stretches that follow each other in it.

    The draw is uniform, so the stretches are known beforehand: one exchange and no sampling pass. Each shard is dealt
    to ``parts`` tasks that follow each other, so that a shard may be larger than a task. ``key`` is unique.
    """
    keys = [key] if isinstance(key, str) else list(key)
    drawn = df.withColumn("__draw", shuffle_key(keys, seed))
    return (
        drawn.repartitionById(shards * parts, shuffle_shard(F.col("__draw"), shards * parts))
        .sortWithinPartitions("__draw", *keys)
        .withColumn("shard", shuffle_shard(F.col("__draw"), shards))
        .drop("__draw")
    )


def reshard(df: DataFrame, shards: int, index: str | None = None) -> DataFrame:
    """Exactly ``shards`` output partitions of even size.

    With a dense ``index`` column the shard of a row is ``index % shards``, so a rerun fills each one alike.
    """
    if index is None:
        return df.repartition(shards)
    return df.repartitionById(shards, F.pmod(F.col(index), F.lit(shards)).cast("int"))


def assign_batches(df: DataFrame, batch_size: int, index: str = "chunk") -> DataFrame:
    """Consecutive rows of a rank form a batch; a short last batch is kept. ``index`` is dense within the rank."""
    return df.withColumn("batch_id", whole_div(F.col(index), F.lit(batch_size)))


def limit_eval_batches(df: DataFrame, eval_steps: int) -> DataFrame:
    """Batches 0 to ``eval_steps`` inclusive; 0 or less keeps all."""
    return df.where(F.col("batch_id") <= eval_steps) if eval_steps > 0 else df


def first_sequences(df: DataFrame, k: int, index: str = "seq_id") -> DataFrame:
    """The first ``k`` sequences of every domain, all domains in one pass."""
    return df.where(F.col(index) < k)


def _batches_per_rank(df: DataFrame, batch_size: int, by: Sequence[str]) -> DataFrame:
    batches = df.groupBy(*by).agg(whole_div(F.count("*") + F.lit(batch_size - 1), F.lit(batch_size)).alias("__batches"))
    batched = assign_batches(df, batch_size)
    return join_null_safe(batched, batches, by, "inner")


def training_schedule(
    df: DataFrame, steps: int, accum: int, batch_size: int, by: Sequence[str] = ("domain", "split", "rank")
) -> DataFrame:
    """Which sequence is used in which step, cycling through each rank's data until the budget is spent.

    A budget is ``steps * accum`` micro-batches per rank and accumulation carries over the end of an epoch.
    ``df`` needs ``chunk``, the dense position within the rank.
    """
    budget = F.lit(steps * accum).cast("bigint")
    rows = _batches_per_rank(df, batch_size, by).where(F.col("batch_id") < budget)
    last_epoch = whole_div(budget - 1 - F.col("batch_id"), F.col("__batches"))
    return (
        rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last_epoch)))
        .withColumn("micro", F.col("epoch") * F.col("__batches") + F.col("batch_id"))
        .withColumn("step", whole_div(F.col("micro"), F.lit(accum)) + 1)
        .drop("__batches")
    )


def times_seen(
    df: DataFrame,
    steps: Column,
    accum: int,
    batch_size: int,
    by: Sequence[str] = ("domain", "split", "rank"),
) -> DataFrame:
    """The schedule without its rows: how often each sequence is used within ``steps`` (a column or literal)."""
    budget = (steps * F.lit(accum)).cast("bigint")
    rows = _batches_per_rank(df, batch_size, by).where(F.col("batch_id") < budget)
    uses = whole_div(budget - 1 - F.col("batch_id"), F.col("__batches")) + 1
    return rows.withColumn("times_seen", uses.cast("bigint")).drop("__batches")


def snapshot(schedule: DataFrame, step: int) -> DataFrame:
    """What an expert had seen when it was saved at ``step``."""
    return schedule.where(F.col("step") <= step)


def snapshots(
    df: DataFrame, steps: Sequence[int], accum: int, batch_size: int, by: Sequence[str] = ("domain", "split", "rank")
) -> DataFrame:
    """How often each sequence was used by each of several steps, ``times_seen``, and its ``last_micro``.

    One pass in closed form: a row per sequence and step that has used it.
    """
    rows = _batches_per_rank(df, batch_size, by)
    each = rows.withColumn("snapshot", F.explode(F.array(*[F.lit(s).cast("bigint") for s in steps])))
    budget = F.col("snapshot") * F.lit(accum)
    uses = whole_div(budget - 1 - F.col("batch_id"), F.col("__batches")) + 1
    return (
        each.where(F.col("batch_id") < budget)
        .withColumn("times_seen", uses)
        .withColumn("last_micro", (F.col("times_seen") - 1) * F.col("__batches") + F.col("batch_id"))
        .drop("__batches")
    )


def added_uses(
    df: DataFrame, steps: Sequence[int], accum: int, batch_size: int, by: Sequence[str] = ("domain", "split", "rank")
) -> DataFrame:
    """How often each sequence was used since the step before: a row per sequence and step of ``steps`` that used it.

    Adds ``step`` and ``uses``. Steps rise; the first counts from the beginning. Closed form, like ``snapshots``.
    """
    rows = _batches_per_rank(df, batch_size, by)
    zero = F.lit(0).cast("bigint")

    def until(step: int) -> Column:
        budget = F.lit(step * accum).cast("bigint")
        return F.when(F.col("batch_id") < budget, whole_div(budget - 1 - F.col("batch_id"), F.col("__batches")) + 1).otherwise(zero)

    entries = [
        F.struct(F.lit(step).alias("step"), (until(step) - (until(before) if before else zero)).alias("uses"))
        for before, step in zip([0, *steps], steps, strict=False)
    ]
    each = rows.withColumn("__entry", F.explode(F.array(*entries))).select("*", "__entry.*")
    return each.where(F.col("uses") > 0).drop("__entry", "__batches", "batch_id")


def epoch_place(index: Column, rows: Column | int, seed: int, epoch: Column | int, rounds: int = 32) -> Column:
    """Place of row ``index`` of ``rows`` in the order of an epoch: a keyed permutation of 0 to ``rows`` - 1, without a sort.

    Swap-or-not (Hoang, Morris and Rogaway, 2012): each round pairs places by a key and swaps a pair or not by one bit of
    a digest of its greater place, so every round is a bijection for any number of rows. Each row's place is worked out
    from its index alone; about six rounds per doubling of ``rows`` make the order look random in every respect.
    """
    size, at = (F.lit(rows) if isinstance(rows, int) else rows).cast("bigint"), index.cast("bigint")
    name = F.concat(F.lit(f"{seed}:"), (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"), F.lit(":"))

    def drawn(text: Column) -> Column:
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

    def swapped(place: Column, turn: Column) -> Column:
        keyed = F.concat(name, turn.cast("string"))
        other = F.pmod(drawn(keyed) % size - place, size)
        draw = drawn(F.concat(keyed, F.lit(":"), F.greatest(place, other).cast("string")))
        return F.when(draw % 2 == 1, other).otherwise(place)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at, swapped)
