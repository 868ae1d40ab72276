"""N-gram counts of every order from one row per position, by suffix counting (Berberich and Bedathur, 2013).

Each position gives one row: its token followed by the tokens before it, nearest first, as many as the expert's
capacity allows. An n-gram of any order is a beginning of such rows. Equal rows are counted on the map side, sorted,
and one walk over each sorted stretch counts all beginnings at once. Only beginnings that lie across two stretches, at
most two per order and stretch, are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.staging import stage

COUNTED = "expert string, `order` int, context array<int>, tok int, n bigint"
FIELDS = pa.schema(
    [("expert", pa.string()), ("order", pa.int32()), ("context", pa.list_(pa.int32())), ("tok", pa.int32()), ("n", pa.int64()), ("edge", pa.bool_())]
)


def reversed_contexts(packed: DataFrame, order: int | Column, *keep: str) -> DataFrame:
    """``(*keep, gram)``: per position of a packed row its label, then up to ``order`` inputs before it, nearest first.

    Contexts do not reach into the sequence before. ``order`` may differ by row.
    """
    longest = F.lit(order) if isinstance(order, int) else order
    at = F.sequence(F.lit(0), F.size("label") - 1)

    def gram(p: Column) -> Column:
        first = F.greatest(F.lit(1), p + 2 - longest)
        return F.concat(F.array(F.get("label", p)), F.reverse(F.slice("input_ids", first, F.least(p + 1, longest))))

    return packed.where(F.size("label") > 0).select(*keep, F.explode(F.transform(at, gram)).alias("gram"))


class Walk:
    """Counts of all beginnings of sorted ``(expert, gram, uses)`` rows; a run goes on over batches."""

    def __init__(self) -> None:
        self.open: dict[int, tuple[str, tuple[int, ...], int, bool]] = {}
        self.rows: list[tuple] = []

    def _emit(self, expert: str, gram: tuple[int, ...], n: int, edge: bool) -> None:
        self.rows.append((expert, len(gram) - 1, list(gram[1:]), gram[0], n, edge))

    def add(self, experts: list[str], grams: pa.ListArray, uses: np.ndarray) -> None:
        sizes = np.diff(grams.offsets.to_numpy())
        flat = grams.flatten().to_numpy()
        table = np.full((len(sizes), int(sizes.max())), -1, np.int64)
        table[np.arange(table.shape[1]) < sizes[:, None]] = flat
        _, codes = np.unique(np.array(experts, dtype=object), return_inverse=True)
        for size in range(1, table.shape[1] + 1):
            rows = np.flatnonzero(sizes >= size)
            if not len(rows):
                continue
            key = np.column_stack([codes[rows], table[rows, :size]])
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            sums = np.add.reduceat(uses[rows], starts).tolist()
            for first, n in zip(rows[starts].tolist(), sums, strict=True):
                expert, gram = experts[first], tuple(table[first, :size].tolist())
                pending = self.open.get(size)
                if pending and pending[:2] == (expert, gram):
                    self.open[size] = (expert, gram, pending[2] + n, pending[3])
                else:
                    if pending:
                        self._emit(*pending)
                    self.open[size] = (expert, gram, n, pending is None)

    def taken(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(FIELDS)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, FIELDS, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=FIELDS)

    def close(self) -> None:
        for expert, gram, n, _ in self.open.values():
            self._emit(expert, gram, n, True)


def suffix_counts(grams: DataFrame, weight: Column | None = None) -> DataFrame:
    """``(expert, order, context, tok, n)`` of all beginnings of ``grams (expert, gram)``; contexts nearest first.

    ``order`` is the context's length. What is exchanged is at most one row per task and distinct longest gram, twice:
    to be counted and to be sorted, by the whole gram, so that a frequent token is no hot key. Rows may carry a
    ``weight``. No grams give no counts.
    """
    uses = F.lit(1) if weight is None else weight
    longest = grams.groupBy("expert", "gram").agg(F.sum(uses).cast("bigint").alias("uses"))
    longest = stage(longest, "longest-grams")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Walk()
        for batch in batches:
            if batch.num_rows:
                run.add(batch.column("expert").to_pylist(), batch.column("gram"), batch.column("uses").to_numpy())
                yield run.taken()
        run.close()
        yield run.taken()

    ranges = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = longest.repartitionByRange(ranges, "expert", "gram").sortWithinPartitions("expert", "gram")
    walked = stage(ordered.mapInArrow(walk, f"{COUNTED}, edge boolean"), "suffix-counts")
    across = walked.where("edge").groupBy("expert", "order", "context", "tok").agg(F.sum("n").alias("n"))
    return walked.where("not edge").drop("edge").unionByName(across)
