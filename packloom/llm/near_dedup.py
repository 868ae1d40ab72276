"""Near duplicates: SuperMinHash signatures, banding, exact confirmation, union of confirmed links.

SuperMinHash gives every element of a set a rank in a random permutation of the signature's places plus a fraction.
Level j of all elements is worked out before level j + 1: a place that some element reached at an earlier level can
no longer change, so the work stops as soon as every place has been reached, after one or two levels for long texts.

Documents with the same set form one node. Nodes that share a band form a bucket. All nodes of a bucket are compared
with one of them, its pivot, the node with most company in all its buckets, so the work is linear in a bucket's size.
What the pivots leave open is only compared between nodes that no links connect yet. In small buckets that is done pair
by pair, where the distances to the pivot allow a link: 1 - similarity is a metric, so two nodes whose distances to
the pivot differ by more than the permitted distance cannot be linked. For nodes of large buckets an exact prefix
filter finds the pairs: two linked sets must share one of their rarest shingles, at places that leave enough behind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.staging import discard, stage
from packloom.llm.batches import bound_batches
from packloom.llm.bit_filter import key_filter
from packloom.llm.components import connected
from packloom.llm.hot import lookup_groups

WORDS = 5
BANDS = 25
ROWS = 5
#: words whose digests a worker remembers
WORDS_KEPT = 200_000
#: bytes of a word up to which it is remembered
WORD_BYTES_KEPT = 64
#: size of a bucket up to which its open nodes are compared pair by pair; beyond it the pairs of a bucket outnumber
#: the shingles of its nodes, and the prefix filter, as exact, is cheaper
FEW = 40
RESULTS = ("id", "n_shingles", "component_id", "kept")

GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(n: int) -> np.uint64:
    return np.uint64((n + 1) * GOLDEN % (1 << 64))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES_KEPT:
            self[word] = value
        return value


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit digests of a text's word shingles; all words as one if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, _seed(1000 + n))
    for k in range(n):
        total = mix(total + _seed(k)) + each[k : k + len(total)]
    return np.unique(mix(total))


def signature(elements: np.ndarray, places: int) -> np.ndarray:
    """The SuperMinHash signature of a set that is not empty."""
    best = np.full(places, np.inf)
    ranks: np.ndarray | None = None
    rows = np.arange(len(elements))
    for level in range(places):
        fraction = (mix(elements + _seed(2 * level)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        draw = mix(elements + _seed(2 * level + 1)) >> np.uint64(32)
        swap = (level + ((draw * np.uint64(places - level)) >> np.uint64(32))).astype(np.int64)
        if ranks is None:
            place = swap
        else:
            place = ranks[rows, swap]
            ranks[rows, swap] = ranks[rows, level]
        np.minimum.at(best, place, level + fraction)
        if np.isfinite(best).all():
            break
        if ranks is None:
            ranks = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
            ranks[rows, swap] = 0
    return best


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band; the band's number is part of it."""
    parts = best[: bands * rows].view(np.uint64).reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(GOLDEN))
    for k in range(rows):
        key = mix(key ^ parts[:, k]) + _seed(k)
    return key.view(np.int64)


def features(
    docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int, carried: Sequence[str] = ()
) -> DataFrame:
    """``(id, n, node, bands)`` per row: set size, digest of the whole set, band keys; null and none for empty sets.

    Columns of ``docs`` that ``carried`` names follow, as ``carried_0``, ``carried_1`` and so on.
    """
    others = [f"carried_{k}" for k in range(len(carried))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes, width) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "n": [len(s) for s in sets],
                    "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [band_keys(signature(s, bands * rows), bands, rows) if len(s) else [] for s in sets],
                    **{c: batch[c] for c in others},
                }
            )

    kept = [F.col(f"`{c}`").alias(o) for c, o in zip(carried, others, strict=True)]
    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *kept)
    types = "".join(f", {o} {chosen.schema[o].dataType.simpleString()}" for o in others)
    return chosen.mapInPandas(work, f"id bigint, n bigint, node binary, bands array<bigint>{types}")


def node_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, shingles)`` for ``nodes (node, id)``, each from the text of one document that has it.

    A bit filter of the ids finds the texts where they lie; a text that it wrongly lets through is dropped by its node.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes, width) for t in batch["text"]]
            yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    _, wanted = key_filter(nodes, F.xxhash64("id")).split(texts, F.xxhash64("id"))
    found = wanted.select("text").mapInPandas(work, "node binary, shingles array<bigint>")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with ``both``, the number of shingles they share, and ``either``."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return met.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


def _least_overlap(x: Column, y: Column, percent: int) -> Column:
    """Shingles that linked sets of sizes ``x`` and ``y`` share at least."""
    return F.ceil(percent * (x + y) / (100 + percent) - 1e-9)


def _pairs_in_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of open nodes of one small bucket that sizes and distances to the pivot allow."""
    reach = 1 - percent / 100 + 1e-9
    others = rows.select("bucket", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("d").alias("bd"), F.col("comp").alias("bc"))
    fit = 100 * F.least("n", "bn") >= percent * F.greatest("n", "bn")
    apart = (F.col("comp") != F.col("bc")) & (F.col("node") < F.col("b")) & (F.abs(F.col("d") - F.col("bd")) <= reach)
    return rows.join(others, "bucket").where(apart & fit).select(F.col("node").alias("a"), "b")


def _pairs_by_prefix(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of ``nodes (node, comp, n)`` of different components that may be linked, by rare shingles.

    Shingles are ordered by frequency, then value. A shingle at place i of a set is of use only if the set's rest
    could still reach the overlap that a link with the smallest holder of that shingle needs, and if holders of
    another component are left.
    """
    held = nodes.join(sets, "node").select("node", "comp", "n", F.explode("shingles").alias("t"))
    counts = held.groupBy("t").agg(F.count("*").alias("f"))
    order = Window.partitionBy("node").orderBy("f", "t")
    placed = held.join(counts, "t").withColumn("i", F.row_number().over(order) - 1)
    prefix = stage(placed.where(F.col("n") - F.col("i") >= F.ceil(percent * F.col("n") / 100 - 1e-9)), "prefixes")
    least = prefix.groupBy("t").agg(F.min("n").alias("least"))
    useful = prefix.join(least, "t").where(F.col("n") - F.col("i") >= _least_overlap(F.col("n"), F.col("least"), percent))
    mixed = useful.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t")
    rows = stage(useful.drop("least").join(mixed, "t", "left_semi"), "useful-prefixes")
    others = rows.select("t", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("i").alias("bi"), F.col("comp").alias("bc"))
    behind = F.least(F.col("n") - F.col("i"), F.col("bn") - F.col("bi"))
    may = (F.col("comp") != F.col("bc")) & (F.col("node") < F.col("b")) & (behind >= _least_overlap(F.col("n"), F.col("bn"), percent))
    return rows.join(others, "t").where(may).select(F.col("node").alias("a"), "b")


def near_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, comp)``: components of the links between nodes that share a bucket, for nodes that have a link.

    ``members (bucket, node, n, size)`` are nodes in buckets of two or more, with the bucket's size.
    """
    linked = 100 * F.col("both") >= percent * F.col("either")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = members.join(company, "node")
    first_of = F.min(F.struct((-F.col("company")).alias("r"), F.col("node"))).alias("p")
    pivots = ranked.groupBy("bucket").agg(first_of).select("bucket", F.col("p.node").alias("pivot"))
    pivoted = stage(members.join(pivots, "bucket"), "pivoted")
    first = pivoted.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    met = stage(_compared(first, sets), "pivot-distances")
    links = met.where(linked).select("a", "b")
    comps = connected(links)
    distance = met.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("both") / F.col("either")).alias("d"))
    known = pivoted.join(distance, ["node", "pivot"], "left").join(comps, "node", "left")
    labelled = known.select("bucket", "node", "n", "size", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("comp", "node").alias("comp"))
    labelled = stage(labelled, "labelled")
    several = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rows = stage(labelled.join(several, "bucket", "left_semi"), "open-buckets")
    discard(pivoted, labelled)
    pairs = _pairs_in_buckets(rows.where(F.col("size") <= FEW), percent)
    large = rows.where(F.col("size") > FEW)
    if not large.isEmpty():
        pairs = pairs.union(_pairs_by_prefix(large.select("node", "comp", "n").distinct(), sets, percent))
    pairs = stage(pairs.distinct(), "open-pairs")
    discard(rows)
    if pairs.isEmpty():
        return comps
    found = stage(_compared(pairs, sets).where(linked).select("a", "b"), "open-links")
    return comps if found.isEmpty() else connected(links.union(found))


def near_dedup(
    docs: DataFrame,
    percent: int = 85,
    bands: int = BANDS,
    rows: int = ROWS,
    width: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carried: Sequence[str] = (),
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``, then its columns ``carried``.

    Two rows are linked when their sets share ``percent`` of their union or more; components follow links. Rows
    without words are linked with nothing and stay. ``component_id`` is the smallest id of a component and ``kept``
    marks the rows that have it. Rows without an id are linked by equal sets only: a row with an id has the smaller one,
    and where none has, all stay.
    Rows that repeat the id of the kept row stay with it. Ids are whole numbers. An empty table gives an empty table.
    Other columns are not read; a carried column named like a result is left out. A link is found with probability
    ``1 - (1 - s ** rows) ** bands``: at 0.85, all but 5 in 10 million.

    Equal sets are one node before bands are looked at. Texts are read where they lie and never exchanged: bit filters
    of at most 32 MB find the band keys that several nodes have and the texts whose sets are compared.
    """
    bound_batches(docs.sparkSession)
    carried = [c for c in carried if c not in RESULTS]
    seen = stage(features(docs, id_col, text_col, bands, rows, width, carried), "features")
    one = F.any_value("n").alias("n"), F.any_value("bands").alias("bands")
    nodes = stage(seen.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("docs"), *one), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = stage(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared-buckets")
    _, likely = key_filter(shared, F.col("bucket")).split(banded, F.col("bucket"))
    members = stage(likely.join(shared, "bucket"), "members")
    wanted = stage(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id"), "wanted")
    sets = stage(node_sets(docs, wanted, id_col, text_col, width), "sets")
    comps = near_components(members, sets, percent)
    named = nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "id", "docs")
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_node = stage(named.join(least, "comp").select("node", "component_id", "docs"), "of-node")
    discard(shared, members, wanted, sets, nodes)
    placed = lookup_groups(seen, of_node, "node", "docs", seen.count())
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return placed.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
        *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carried)],
    )
