"""Ranked lexical search by dense blocked matrix products.

The terms of the asked items form a compact vocabulary. One pass over the documents counts those terms, so that a
document becomes a short list of (term, occurrences). Items are dealt into tiles; the documents of a batch become a
matrix of impacts over a tile's own vocabulary, which is multiplied with the tile's matrix of term weights in float64.
Impacts and weights are whole numbers. A product takes only as many terms as keep every partial sum below 2 ** 53, so
each is exact, and the products are added up as 64-bit integers. Of every tile the best ``k`` documents per item stay,
ties at the border broken by id, so nothing that belongs to the result is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from packloom.functions.index import running_total
from packloom.functions.staging import stage
from packloom.llm.batches import bound_batches
from packloom.llm.text_slices import slices

#: bytes of item texts whose vocabulary a worker holds at once; more items take further rounds over the documents
BLOCK_BYTES = 4 << 20
#: items of one tile
TILE_ITEMS = 64
#: terms of one product at most
TILE_TERMS = 4096
#: partial results per item that one task merges
SALTS = 64
#: no impact is as large: 1000000000 * tf div (1000 * tf + 20 * m) with m above 0
IMPACT_BOUND = 1_000_000
#: whole numbers below this are exact in float64
EXACT = 1 << 53

#: bytes that belong to terms stay, letters A to Z in lower case; all others become blanks
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def count_terms(text: str | None, vocabulary: dict[bytes, int] | None = None) -> tuple[int, Counter[bytes]]:
    """Number of all terms of a text, and the occurrences of those in ``vocabulary`` (of all without one)."""
    blob = (text or "").encode("utf-8", "replace").translate(TERM_BYTES)
    n, found = 0, Counter()
    for start, end in slices(blob):
        words = blob[start:end].split()
        n += len(words)
        seen = Counter(words)
        if vocabulary is None:
            found.update(seen)
        else:
            for term in seen.keys() & vocabulary.keys():
                found[term] += seen[term]
    return n, found


def term_weight(documents: int, holding: int) -> int:
    """``floor(1000 * ln((2 N + 2) / (2 df + 1)))``."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Tile:
    """Items ``items`` with the terms ``terms`` of their own: a 0-1 matrix ``holds`` (terms, items)."""

    items: np.ndarray
    terms: np.ndarray
    holds: np.ndarray


def tiles_of(asked: Sequence[tuple[int, Sequence[int]]], weights: np.ndarray, items: int = TILE_ITEMS) -> list[Tile]:
    """Tiles of ``(item, its terms)``; terms of weight 0 add nothing and are left out."""
    out = []
    for first in range(0, len(asked), items):
        part = asked[first : first + items]
        terms = np.array(sorted({t for _, ts in part for t in ts if weights[t] > 0}), np.int64)
        holds = np.zeros((len(terms), len(part)), bool)
        for column, (_, ts) in enumerate(part):
            holds[np.isin(terms, np.array(list(ts), np.int64)), column] = True
        out.append(Tile(np.array([i for i, _ in part], np.int64), terms, holds))
    return out


def tile_scores(rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, docs: int, tile: Tile, weights: np.ndarray) -> np.ndarray:
    """Scores (docs, items) of documents given as triples; exact, as every product's sums stay below 2 ** 53."""
    scores = np.zeros((docs, len(tile.items)), np.int64)
    if not len(tile.terms):
        return scores
    step = min(TILE_TERMS, max(1, (EXACT - 1) // (int(weights.max()) * IMPACT_BOUND)))
    at = np.minimum(np.searchsorted(tile.terms, terms), len(tile.terms) - 1)
    held = tile.terms[at] == terms
    rows, at, impacts = rows[held], at[held], impacts[held]
    for low in range(0, len(tile.terms), step):
        mine = (at >= low) & (at < low + step)
        dense = np.zeros((docs, min(step, len(tile.terms) - low)))
        dense[rows[mine], at[mine] - low] = impacts[mine]
        weighed = tile.holds[low : low + step] * weights[tile.terms[low : low + step], None].astype(np.float64)
        scores += (dense @ weighed).astype(np.int64)
    return scores


class Best:
    """The best ``k`` documents of every item of a tile: score first, then id, rows without an id last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.found = np.zeros((4, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if len(scores) > self.k:
            border = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            floor = np.maximum(self.floor, border)
        else:
            floor = self.floor
        doc, item = np.nonzero(scores >= floor)
        if not len(doc):
            return
        new = np.stack([item, scores[doc, item], missing[doc], ids[doc]])
        both = np.concatenate([self.found, new], axis=1)
        both = both[:, np.lexsort((both[3], both[2], -both[1], both[0]))]
        first = np.searchsorted(both[0], both[0])
        place = np.arange(both.shape[1]) - first
        self.found = both[:, place < self.k]
        last = place == self.k - 1
        self.floor[both[0][last]] = both[1][last]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, counts)`` for every row of ``docs``: all its terms' number, and those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                n, found = count_terms(text, known)
                sizes.append(n)
                terms.append([known[t] for t in found])
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["id", "n", "terms", "counts"],
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(work, "id bigint, n bigint, terms array<int>, counts array<bigint>")


def best_documents(held: DataFrame, tiles: list[Tile], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(item, id, score)``: of each task's documents the best ``k`` per item."""
    sent = held.sparkSession.sparkContext.broadcast((tiles, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, weights = sent.value
        best = [Best(len(t.items), k) for t in tiles]
        for batch in batches:
            sizes = [50 + (50 * n * documents) // length for n in batch.column("n").to_pylist()]
            terms = batch.column("terms")
            per_doc = np.diff(terms.offsets.to_numpy())
            flat = terms.flatten().to_numpy().astype(np.int64)
            tf = batch.column("counts").flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), per_doc)
            m = np.array(sizes, np.int64)[rows]
            impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
            ids = batch.column("id")
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for tile, kept in zip(tiles, best, strict=True):
                kept.add(tile_scores(rows, flat, impacts, batch.num_rows, tile, weights), ids, missing)
        for tile, kept in zip(tiles, best, strict=True):
            item, score, missing, ids = kept.found
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile.items[item]), pa.array(ids, mask=missing.astype(bool)), pa.array(score)], ["item", "id", "score"]
            )

    return held.where(F.size("terms") > 0).mapInArrow(work, "item bigint, id bigint, score bigint")


def _blocks(items: DataFrame, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """``items`` with ``__block``, each of about ``block_bytes`` of text or one item, and the number of blocks."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    total = items.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    if total <= block_bytes:
        return items.withColumn("__block", F.lit(0)), 1 if total else 0
    before = running_total(items.select("__item", size.alias("__size")), F.col("__size"), ["__item"], [], "__before")
    block = F.call_function("div", F.col("__before"), F.lit(block_bytes).cast("bigint")).cast("int")
    return items.join(before.select("__item", block.alias("__block")), "__item"), total // block_bytes + 1


def _search(docs: DataFrame, rows: list[Row], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """``(item, id, score)`` of one block of items; none where no item or no document has a term."""
    asked = [(r["__item"], count_terms(r["text"])[1].keys()) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in asked for t in ts}))}
    held = stage(postings(docs, vocabulary, id_col, text_col), "postings")
    totals = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    if not vocabulary or not totals["documents"]:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for term, holding in held.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[term] = term_weight(totals["documents"], holding)
    tiles = tiles_of([(item, [vocabulary[t] for t in ts]) for item, ts in asked if ts], weights)
    return best_documents(held, tiles, weights, totals["documents"], totals["length"], k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(item_id, rank, id, score)``: for each row of ``items`` its ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters (in lower case), digits and characters beyond ASCII; null texts have none. The
    score of a document sums ``w * (1000000000 tf div (1000 tf + 20 m))`` over the item's distinct terms, where
    ``w = floor(1000 ln((2N + 2) / (2df + 1)))`` and ``m = 50 + 50 n N div L``. Equal scores go by ascending id, rows
    without an id last; rows that repeat an id are documents of their own, and rows of ``items`` that repeat an id are
    items of their own. Document ids are whole numbers. Items without terms, and empty tables, give no rows; other
    columns are not read.

    Documents are read once per ``block_bytes`` of item texts; the vocabulary and the weights of one such block are what
    a worker holds. Every task hands on at most ``k`` rows per item, which meet in two steps.
    """
    bound_batches(docs.sparkSession)
    numbered = items.select(F.col(item_col).alias("__id"), F.col(item_text_col).alias("text"), F.monotonically_increasing_id().alias("__item"))
    numbered = stage(numbered, "items")
    blocked, blocks = _blocks(numbered, "text", block_bytes)
    parts = []
    for block in range(blocks):
        rows = blocked.where(F.col("__block") == block).select("__item", "text").collect()
        found = _search(docs, sorted(rows), k, id_col, text_col) if rows else None
        if found is not None:
            parts.append(found)
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], "item bigint, id bigint, score bigint")]
    order = [F.desc("score"), F.asc_nulls_last("id")]
    merged = []
    for part in parts:
        salted = part.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        place = F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))
        merged.append(salted.withColumn("rank", place).where(F.col("rank") <= k).select("item", "id", "score"))
    every = merged[0]
    for part in merged[1:]:
        every = every.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    ranked = every.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(numbered.select("__item", F.col("__id").alias(item_col)), F.col("item") == F.col("__item")).select(
        item_col, "rank", "id", "score"
    )
