"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds whole documents in ascending id order::

    magic "PFOR", u32 block size, u32 documents, u32 blocks, u64 tokens
    i64 ids, u8 id-is-null flags, u32 token counts       one per document
    u64 block starts                                     blocks + 1, from the end of this index
    blocks

    block: u32 minimum, u8 width, u16 exceptions, values less the minimum packed at that width, little-endian,
           u16 exception places, u32 exception values

The width of a block is the width of a percentile of its values; values that need more bits are stored in its
exception list, their low bits packed as if they fitted. Segments are rows of a Parquet table, so that Spark's
committer publishes them and any store Spark writes to will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches
from packloom.llm.token_ids import encode_all, word_ids

MAGIC = b"PFOR"
BLOCK = 1024
PERCENTILE = 90
#: a segment is closed once it holds so many tokens
SEGMENT_TOKENS = 1 << 20
HEAD = struct.Struct("<4sIIIQ")
BLOCK_HEAD = struct.Struct("<IBH")
SEGMENTS = "part int, segment int, first bigint, n_tokens bigint, payload binary"
SEGMENT_FIELDS = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]
)


def _bits_needed(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(values: np.ndarray, size: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ``size`` unsigned 32-bit values each, the last one of the rest.

    All blocks are worked out together, those of one width in one step.
    """
    whole = len(values) - len(values) % size
    if whole < len(values):
        rest = pack_blocks(values[whole:], len(values) - whole, percentile)
        return pack_blocks(values[:whole], size, percentile) + rest
    rows = values.reshape(-1, size)
    least = rows.min(axis=1, initial=2**32 - 1)
    less = (rows - least[:, None]).astype("<u4")
    bits = _bits_needed(less)
    width = np.sort(bits, axis=1)[:, int(np.ceil(size * percentile / 100)) - 1]
    row, place = np.nonzero(bits > width[:, None])
    outliers = less[row, place]
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        unpacked = np.unpackbits(less[chosen].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=w)
        for n, line in zip(chosen.tolist(), np.packbits(unpacked.reshape(len(chosen), -1), axis=1, bitorder="little"), strict=True):
            packed[n] = line.tobytes()
    return [
        BLOCK_HEAD.pack(least[n], width[n], ends[n + 1] - ends[n])
        + packed[n]
        + place[ends[n] : ends[n + 1]].astype("<u2").tobytes()
        + outliers[ends[n] : ends[n + 1]].tobytes()
        for n in range(len(rows))
    ]


def unpack_blocks(payload: bytes, starts: np.ndarray, total: int, size: int = BLOCK) -> np.ndarray:
    """The values of the blocks that start at ``starts``; those of one width are unpacked in one step."""
    out = np.zeros(len(starts) * size, "<u4").reshape(len(starts), size)
    heads = [BLOCK_HEAD.unpack_from(payload, at) for at in starts.tolist()]
    width = np.array([w for _, w, _ in heads], np.int64)
    counts = np.full(len(starts), size)
    if len(starts):
        counts[-1] = total - (len(starts) - 1) * size
    for w in np.unique(width).tolist():
        for whole in (True, False):
            chosen = np.flatnonzero((width == w) & ((counts == size) == whole))
            if not len(chosen) or not w:
                continue
            n = int(counts[chosen[0]])
            length = (n * w + 7) // 8
            spare = bytes(8)
            lines = b"".join(payload[at : at + length] + spare for at in (starts[chosen] + BLOCK_HEAD.size).tolist())
            rows = np.frombuffer(lines, np.uint8).reshape(-1, length + 8)
            first, shift = np.divmod(np.arange(n, dtype=np.uint64) * np.uint64(w), np.uint64(8))
            wide = np.zeros((len(rows), n), np.uint64)
            for k in range((w + 14) // 8):
                wide |= rows[:, first.astype(np.int64) + k].astype(np.uint64) << np.uint64(8 * k)
            out[chosen, :n] = (wide >> shift) & np.uint64((1 << w) - 1)
    for n, (least, w, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[n]) + BLOCK_HEAD.size + (int(counts[n]) * w + 7) // 8
            places = np.frombuffer(payload, "<u2", exceptions, at)
            out[n, places] = np.frombuffer(payload, "<u4", exceptions, at + 2 * exceptions)
    out += np.array([least for least, _, _ in heads], "<u4")[:, None]
    return out.reshape(-1)[:total]


def pack_segment(ids: list[int | None], tokens: list[bytes], block: int = BLOCK) -> bytes:
    """The bytes of one segment; ``tokens`` holds each document's ids as little-endian unsigned 32-bit bytes."""
    values = np.frombuffer(b"".join(tokens), "<u4")
    blocks = pack_blocks(values, block)
    starts = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, block, len(ids), len(blocks), len(values)),
            np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], np.uint8).tobytes(),
            np.array([len(t) // 4 for t in tokens], "<u4").tobytes(),
            starts.tobytes(),
            *blocks,
        ]
    )


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids, token counts, and all tokens of a segment."""
    magic, block, n_docs, n_blocks, n_tokens = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("no token segment")
    at = HEAD.size
    ids = np.frombuffer(payload, "<i8", n_docs, at)
    null = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, at)
    at += 8 * (n_blocks + 1)
    tokens = unpack_blocks(payload, starts[:-1].astype(np.int64) + at, n_tokens, block)
    named = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
    return named, counts, tokens


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text and write segments in ascending id order.

    Rows are dealt by ranges of the id and sorted inside, nulls first; rows that repeat an id follow a digest of
    their text. Only the text moves; a task holds one open segment. A null text counts as empty and gives the end id
    alone. An empty table gives a table without segments. Only the two named columns are read.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer_file), TaskContext.get().partitionId()
        ids: list[int | None] = []
        tokens: list[bytes] = []
        number = first = held = 0

        def closed() -> pa.RecordBatch:
            row = {"part": part, "segment": number, "first": first, "n_tokens": held, "payload": pack_segment(ids, tokens)}
            return pa.RecordBatch.from_pylist([row], SEGMENT_FIELDS)

        for batch in batches:
            for i, encoded in zip(batch["id"].to_pylist(), encode_all(words, batch["text"], end_id), strict=True):
                ids.append(i)
                tokens.append(encoded)
                held += len(encoded) // 4
                if held >= SEGMENT_TOKENS:
                    yield closed()
                    first, held, number, ids, tokens = first + held, 0, number + 1, [], []
        if ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` per document, ids as little-endian unsigned 32-bit bytes.

    Tokens before a segment are those of earlier parts, one number for each task of the writer, and of earlier
    segments of its part, which it carries itself.
    """
    stored = spark.read.schema(SEGMENTS).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload in zip(batch["start"], batch["payload"], strict=True):
                ids, counts, tokens = unpack_segment(payload)
                ends = np.cumsum(counts, dtype=np.int64)
                yield pd.DataFrame(
                    {
                        "id": pd.array(ids, dtype="Int64"),
                        "start": int(start) + ends - counts,
                        "n_tokens": counts.astype(np.int64),
                        "ids": [tokens[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)],
                    }
                )

    placed = stored.join(F.broadcast(parts), "part").select((F.col("before") + F.col("first")).alias("start"), "payload")
    return placed.mapInPandas(documents, "id bigint, start bigint, n_tokens bigint, ids binary")
