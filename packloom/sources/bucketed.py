"""Stored experts laid out for scoring, so that scoring an evaluation set does not move them.

Counts are kept by what scoring looks up: words, pairs and triples of tokens, and the contexts of the last two, each with
its counts by expert in one row. Every table is bucketed and sorted by its key; a join on that key exchanges the asked
n-grams into the same buckets and reads the stored side where it lies, for any number of evaluation sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the key of each table; its row has the counts of that key by expert
KEYS: dict[str, tuple[str, ...]] = {
    "words": ("tok",),
    "pairs": ("ctx1", "tok"),
    "triples": ("ctx2", "ctx1", "tok"),
    "after_one": ("ctx1",),
    "after_two": ("ctx2", "ctx1"),
}
#: the order whose counts each table sums up
ORDERS = {"words": 0, "pairs": 1, "triples": 2, "after_one": 1, "after_two": 2}


def table_name(path: str, table: str) -> str:
    """The catalog's name of one table of the store at ``path``."""
    return f"packloom_{zlib.crc32(path.encode()):08x}_{table}"


def write_bucketed(counts: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store experts ``(expert, order, ctx2, ctx1, tok, n)`` at ``path`` as bucketed tables, replacing what is there.

    ``buckets`` is the number of shuffle partitions unless given: with fewer, Spark may prefer to exchange both sides.
    Totals by expert, one row each, lie beside them. ``counts`` is read once per table; give a stored one.
    """
    spark = counts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table, keys in KEYS.items():
        of_order = counts.where(F.col("order") == ORDERS[table])
        summed = of_order.groupBy("expert", *keys).agg(F.sum("n").alias("n"))
        rows = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("expert", "n"))).alias("n"))
        writer = rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", f"{path}/{table}").saveAsTable(table_name(path, table))
    totals = counts.where("`order` = 0").groupBy("expert").agg(F.sum("n").alias("n"))
    totals.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/totals")


def open_bucketed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a store by name, and its ``totals``; a session that does not know them enters them in its catalog."""
    totals = spark.read.parquet(f"{path}/totals")
    opened = {"totals": totals}
    for table, keys in KEYS.items():
        name = table_name(path, table)
        if not spark.catalog.tableExists(name):
            columns = ", ".join([f"{k} int" for k in keys] + ["n map<string, bigint>"])
            key, buckets = ", ".join(keys), totals.first()["buckets"]
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
                f"LOCATION '{path}/{table}'"
            )
        opened[table] = spark.table(name)
    return opened


def forget_bucketed(spark: SparkSession, path: str) -> None:
    """Take a store's tables out of the session's catalog; its files stay."""
    for table in KEYS:
        spark.sql(f"DROP TABLE IF EXISTS {table_name(path, table)}")


def stored_log_probs(
    grams: DataFrame, path: str, experts: Sequence[str], vocab_size: int, alpha: float = 0.1, beta: float = 1.0
) -> DataFrame:
    """``(ctx2, ctx1, tok, log_probs)`` for distinct ``grams (ctx2, ctx1, tok)``, an array entry per expert.

    The same probabilities as ``gram_log_probs``, from the store at ``path``. Only asked n-grams are exchanged.
    """
    store = open_bucketed(grams.sparkSession, path)
    totals = {r["expert"]: r["n"] for r in store["totals"].collect()}
    places = range(len(experts))

    def with_counts(asked: DataFrame, table: str) -> DataFrame:
        stored = store[table].withColumnRenamed("n", table)
        return asked.join(stored, list(KEYS[table]), "left")

    def n(table: str, i: int):
        return F.coalesce(F.try_element_at(table, F.lit(experts[i])), F.lit(0).cast("bigint"))

    def p0(i: int):
        return (n("words", i) + F.lit(alpha)) / F.lit(totals.get(experts[i], 0) + alpha * vocab_size)

    def p1(i: int):
        return (n("pairs", i) + F.lit(beta) * p0(i)) / (n("after_one", i) + F.lit(beta))

    asked = grams.select("ctx1", "tok").distinct()
    pairs = with_counts(with_counts(with_counts(asked, "words"), "after_one"), "pairs")
    pairs = pairs.select("ctx1", "tok", *[p1(i).alias(f"p1_{i}") for i in places])
    triples = with_counts(with_counts(grams, "after_two"), "triples").join(pairs, ["ctx1", "tok"])
    log_probs = [
        F.log((n("triples", i) + F.lit(beta) * F.col(f"p1_{i}")) / (n("after_two", i) + F.lit(beta))) for i in places
    ]
    return triples.select("ctx2", "ctx1", "tok", F.array(*log_probs).alias("log_probs"))
