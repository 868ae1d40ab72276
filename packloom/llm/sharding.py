"""Shards by a hierarchical weighted hash tree: every row descends region, rack and shard by weighted hash draws.

At each level every child draws a number from the row's key and its own name, ``-ln(u) / weight``, and the smallest
draw takes the row. A child is chosen in proportion to its weight, and a change of one weight moves rows only into or
out of that child: the draws of its siblings stay as they are. Movement therefore stays inside the subtrees whose
weights change; a shard that comes with a region of its own takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]

RACK_SHARDS = 4
REGION_SHARDS = 8
BASE_SHARDS = 16


def even_tree(shards: int) -> list[Leaf]:
    """Sixteen equal shards in two regions of two racks; each further shard comes as a region with one rack."""

    def leaf(s: int) -> Leaf:
        region = s // REGION_SHARDS if s < BASE_SHARDS else s - BASE_SHARDS + BASE_SHARDS // REGION_SHARDS
        rack = s // RACK_SHARDS if s < BASE_SHARDS else s
        return f"region{region}", f"rack{rack}", s, 1.0

    return [leaf(s) for s in range(shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 52 bits of a digest of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _choose(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; ties go to the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, name, weight) for name, weight, _ in children]
    least = F.least(*draws)
    return F.coalesce(*[F.when(d == least, value) for d, (_, _, value) in zip(draws, children, strict=True)])


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard that ``key`` (a string, not null) reaches; leaves without weight take nothing."""
    regions: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in tree:
        if weight > 0:
            regions.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
    top = []
    for region, racks in regions.items():
        level = []
        for rack, leaves in racks.items():
            inner = _choose(key, [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in leaves])
            level.append((f"{region}/{rack}", sum(w for _, w in leaves), inner))
        top.append((region, sum(w for _, w, _ in level), _choose(key, level)))
    return _choose(key, top)


def with_shards(
    docs: DataFrame, tree: Sequence[Leaf], id_col: str = "doc_id", text_col: str = "text", slot_parts: int = 1024
) -> DataFrame:
    """All rows of ``docs`` with ``size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus one (null: one); the digest of a null text is that of the empty one. A
    null key hashes as an empty key. Slots count from 0 within a shard: a shard is cut by a digest of the key into
    ``slot_parts`` parts, rows are numbered within a part, and the totals of earlier parts, at most shards times
    ``slot_parts`` numbers, are added. Rows that repeat key and text take neighbouring slots. An empty table stays
    empty. Columns of ``docs`` named like a result are replaced. Only native expressions run, and the texts
    themselves are not shuffled unless ``docs`` carries them on.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), key)), 1, 8), 16, 10).cast("bigint") % slot_parts
    keyed = docs.withColumns({"shard": shard_of(key, tree).cast("int"), "__part": part})
    sums = (
        keyed.groupBy("shard", "__part")
        .agg(F.count("*").alias("__n"))
        .withColumn("__base", F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n"))
        .select(F.col("shard").alias("__s"), F.col("__part").alias("__p"), "__base")
    )
    rows = keyed.withColumns({"size": F.octet_length(text).cast("bigint") + 1, "text_crc32": F.crc32(text.cast("binary"))})
    within = Window.partitionBy("shard", "__part").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("__k", F.row_number().over(within) - 1)
    same = [F.col("shard") == F.col("__s"), F.col("__part") == F.col("__p")]
    placed = numbered.join(F.broadcast(sums), reduce(Column.__and__, same))
    return placed.withColumn("slot", (F.col("__base") + F.col("__k")).cast("bigint")).drop("__part", "__k", "__s", "__p", "__base")
