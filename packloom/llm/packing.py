"""Packing into fixed windows by the sum-of-squares rule.

A document is cut into full windows and a rest. A rest goes to the fill level that makes the sum, over all levels, of
the squared number of partially filled windows least; the level array holds these numbers. Few windows then stay
open. When a task ends, its open windows are cut into each other until one is left, which is cut at powers of two. A task
that has more than ``max_open`` windows open does the same with all but the last of them and goes on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.llm.batches import bound_batches
from packloom.llm.token_ids import encode_all, word_ids

#: a document's id, its tokens before the piece, all its tokens, the piece's ids
Piece = tuple[int | None, int, int, bytes]
PIECES = (
    "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, sequence bigint, `offset` bigint"
)

FIELDS = pa.schema(
    [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("doc_tokens", pa.int64()), ("part", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int64())]
)
#: closed windows, with their ids, that wait to be written out
DONE_KEPT = 1000
#: open windows of one task; at 2,048 tokens each they hold 128 MB of ids at most
MAX_OPEN = 16_384


class Packer:
    """Windows of ``size`` tokens; ``done`` gathers closed windows, each a list of pieces."""

    def __init__(self, size: int, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.done: list[list[Piece]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.size
        for at in range(0, full, self.size):
            self.done.append([(doc, at, total, ids[4 * at : 4 * (at + self.size)])])
        if full < total:
            self._place((doc, full, total, ids[4 * full :]))

    def _level_for(self, n: int) -> int:
        """The fill level to raise by ``n``, 0 for a new window; the fullest of equally good ones."""
        counts = self.levels[: self.size - n + 1]
        above = self.levels[n:].copy()
        above[-1] = 0
        change = np.where(counts > 0, 2 * (above - counts) + 2, np.iinfo(np.int64).max)
        change[0] = 2 * above[0] + 1
        if counts[-1] > 0:
            change[-1] = 1 - 2 * counts[-1]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _place(self, piece: Piece) -> None:
        n = len(piece[3]) // 4
        level = self._level_for(n)
        window: list[Piece] = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        window.append(piece)
        if level + n == self.size:
            self.done.append(window)
            return
        self.levels[level + n] += 1
        self.open.setdefault(level + n, []).append(window)
        if self.levels.sum() > self.max_open:
            for rest in self._merged():
                fill = sum(len(p[3]) for p in rest) // 4
                self.levels[fill] += 1
                self.open.setdefault(fill, []).append(rest)

    def _merged(self) -> list[list[Piece]]:
        """Empty the open windows into full ones; what is left, at most one window."""
        held = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.levels = {}, np.zeros(self.size + 1, np.int64)
        window: list[Piece] = []
        room = self.size
        for doc, start, total, ids in (p for w in held for p in w):
            while ids:
                take, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, total, take))
                start += len(take) // 4
                room -= len(take) // 4
                if not room:
                    self.done.append(window)
                    window, room = [], self.size
        return [window] if window else []

    def finish(self) -> None:
        """Close everything; the last window becomes windows of powers of two."""
        for rest in self._merged():
            left = sum(len(p[3]) for p in rest) // 4
            window: list[Piece] = []
            room = 1 << (left.bit_length() - 1)
            for doc, start, total, ids in rest:
                while ids:
                    take, ids = ids[: 4 * room], ids[4 * room :]
                    window.append((doc, start, total, take))
                    n = len(take) // 4
                    start, room, left = start + n, room - n, left - n
                    if not room:
                        self.done.append(window)
                        window, room = [], 1 << max(0, left.bit_length() - 1)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every task packs its own rows as they come, so nothing is exchanged; it holds its open windows only, ``max_open`` at
    most: beyond that they are cut into full ones, which loses no token and no fill but leaves the rule for a moment. The
    pieces
    are staged once, then the sequences of earlier tasks, one number each, are added. Null texts count as empty and
    give the end id alone; ids are whole numbers, may be null or repeated, and a row's pieces always belong to one row. An empty table gives
    no piece. Only the two named columns are read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, packer, closed = word_ids(tokenizer_file), TaskContext.get().partitionId(), Packer(size, max_open), 0

        def emitted() -> pa.RecordBatch:
            nonlocal closed
            rows = []
            for number, window in enumerate(packer.done, closed):
                at = 0
                for doc, start, total, ids in window:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), total, part, number, at))
                    at += n
            closed += len(packer.done)
            packer.done.clear()
            columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=FIELDS)

        for batch in batches:
            for n, (i, ids) in enumerate(zip(batch["id"].to_pylist(), encode_all(words, batch["text"], end_id), strict=True)):
                packer.add(i, ids)
                if len(packer.done) >= DONE_KEPT or n == len(batch) - 1:
                    yield emitted()
        packer.finish()
        if packer.done:
            yield emitted()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    staged = stage(rows.mapInArrow(pieces, PIECES), "pieces")
    parts = staged.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return staged.join(F.broadcast(parts), "part").select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset"
    )
