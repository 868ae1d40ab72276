"""Quality of a text by a convolutional network over its bytes, trained and run in numpy.

Each byte becomes a short vector; learned filters look at overlapping chunks of bytes that cover the whole text; the
largest response of each filter anywhere is kept, and one layer turns these into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches

PAD = 256
#: bytes whose responses are held at once
SPAN = 1 << 16


@dataclass
class ByteNet:
    """``embed`` (257, d), ``filters`` (chunk * d, f), ``bias`` (f), ``out`` (f), ``offset`` (1)."""

    chunk: int
    stride: int
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, chunk: int, stride: int, dims: int, filters: int, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        f = np.float32
        return cls(
            chunk,
            stride,
            rng.normal(0, 1, (PAD + 1, dims)).astype(f),
            rng.normal(0, (chunk * dims) ** -0.5, (chunk * dims, filters)).astype(f),
            np.zeros(filters, f),
            rng.normal(0, filters**-0.5, filters).astype(f),
            np.zeros(1, f),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.offset]

    def padded(self, text: str | None) -> np.ndarray:
        """Byte values, closed by padding so that chunks end where the text does; an empty text is one chunk."""
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        chunks = 1 + max(0, -(-(len(raw) - self.chunk) // self.stride))
        values = np.full(self.chunk + (chunks - 1) * self.stride, PAD, np.int16)
        values[: len(raw)] = raw
        return values

    def pooled(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response and the chunk that gives it."""
        best = np.full(len(self.bias), -np.inf, np.float32)
        where = np.zeros(len(self.bias), np.int64)
        dims = self.embed.shape[1]
        chunks = 1 + (len(values) - self.chunk) // self.stride
        step = max(1, SPAN // self.stride)
        for first in range(0, chunks, step):
            n = min(step, chunks - first)
            part = self.embed[values[first * self.stride : (first + n - 1) * self.stride + self.chunk]]
            view = np.lib.stride_tricks.as_strided(
                part, (n, self.chunk * dims), (self.stride * dims * part.itemsize, part.itemsize), writeable=False
            )
            response = view @ self.filters
            top = response.argmax(axis=0)
            high = response[top, np.arange(len(best))]
            where = np.where(high > best, top + first, where)
            best = np.maximum(best, high)
        return best + self.bias, where

    def score(self, text: str | None) -> float:
        best, _ = self.pooled(self.padded(text))
        z = float(np.maximum(best, 0) @ self.out + self.offset[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, values: np.ndarray, label: float, sums: list[np.ndarray]) -> None:
        """Add one text's gradients; only the chunks that were kept take part."""
        best, where = self.pooled(values)
        active = np.maximum(best, 0)
        z = float(active @ self.out + self.offset[0])
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        back = np.where(best > 0, error * self.out, 0).astype(np.float32)
        places = where[:, None] * self.stride + np.arange(self.chunk)
        seen = values[places]
        inputs = self.embed[seen].reshape(len(where), -1)
        np.add.at(sums[0], seen.ravel(), (back[:, None] * self.filters.T).reshape(-1, self.embed.shape[1]))
        sums[1] += inputs.T * back
        sums[2] += back
        sums[3] += error * active
        sums[4] += error


def train(
    texts: list[str | None],
    labels: list[int],
    chunk: int = 16,
    stride: int = 8,
    dims: int = 8,
    filters: int = 32,
    epochs: int = 12,
    batch: int = 16,
    rate: float = 0.004,
    decay: float = 1e-4,
    seed: int = 7,
) -> ByteNet:
    """Fit by Adam on the log loss. Without texts the network stays as drawn; with one class it learns that class."""
    net = ByteNet.fresh(chunk, stride, dims, filters, seed)
    rng = np.random.default_rng(seed)
    data = [net.padded(t) for t in texts]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(data), batch):
            sums = [np.zeros_like(w) for w in net.weights()]
            chosen = order[at : at + batch]
            for i in chosen:
                net.gradients(data[i], float(labels[i]), sums)
            step += 1
            for w, g, m, v in zip(net.weights(), sums, first, second, strict=True):
                g = g / len(chosen) + decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def is_held_out(id_col: str):
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 3000,
    longest: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> ByteNet:
    """Train on at most ``sample_rows`` labelled rows that are not held out, drawn by a digest of their id.

    Whole texts teach. Rows with more than ``longest`` code points are not drawn, which bounds what the driver holds;
    rows without a label, id or text take no part. An id with several labels has the least of them, one with several
    texts the first in order.
    """
    draw = F.md5(F.col("__id").cast("string"))
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .dropna()
        .where(~is_held_out("__id"))
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"))
    )
    short = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") <= longest)
    present = short.select("__id").distinct()
    chosen = known.join(present, "__id", "left_semi").orderBy(draw, "__id").limit(sample_rows)
    rows = short.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text")).collect()
    rows.sort(key=lambda r: (r["__id"], r["__text"]))
    return train([r["__text"] for r in rows], [r["__label"] for r in rows])


def with_quality(docs: DataFrame, net: ByteNet, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up), from its text alone.

    Whole texts are scored, piece by piece, so memory does not grow with their length. Null counts as empty; empty
    texts get the score of padding. An empty table stays empty; columns of ``docs`` named like a result are replaced.
    """
    docs = docs.drop("score", "predicted")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sent.value.score(t) for t in batch], dtype="float64")

    scored = docs.withColumn("score", score(F.col(text_col)))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
