"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions.staging import discard, stage


def connected(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of the links ``(a, b)``; ``comp`` is the smallest node it reaches.

    Every node takes the smallest label among its neighbours, then its label's label, until nothing changes. Labels
    and links stay tables in the shared folder; only the number of changed labels comes back. Null ends are ignored.
    """
    links = links.dropna().where("a <> b")
    ways = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "ways")
    labels = stage(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (
            ways.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        lower = stage(lower, "lower")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        before = labels
        labels = stage(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        discard(before, lower)
        if labels.where("comp <> old").isEmpty():
            discard(ways)
            return labels.select("node", "comp")
