"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised windows, one scan per text.

Texts are normalised byte by byte: A-Z become lower case, every other ASCII character that is no digit or letter
becomes a space. Normalised text has the original's length, so a word's place in it is its place in the original.

The automaton's letters are whole words: the benchmark's distinct words are numbered, a text becomes one character per
word, and all words that the benchmark lacks are one character that no window has. A window of 13 words then takes 13
nodes at most, however long its words are, and only runs of known words as long as the shortest window are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.llm.batches import bound_batches

WINDOW = 13
#: normalised benchmark bytes in one automaton; a larger benchmark is scanned for block by block
BLOCK_BYTES = 2 << 20
#: the character of words that the benchmark lacks
FOREIGN = "\x01"
HITS = "array<struct<start:int,end:int,item:string>>"
SCANNED = f"struct<n:bigint,hits:{HITS}>"

TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(TABLE)


def windows(text: str | None, length: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of ``length`` words of an item; all its words if it has fewer, nothing if it has none."""
    words = normalised(text).split()
    if not words:
        return set()
    return {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))}


class Letters(dict):
    """One character per word of the benchmark, FOREIGN for any other."""

    def add(self, word: bytes) -> str:
        if word not in self:
            place = len(self) + 2
            self[word] = chr(place if place < 0xD800 else place + 0x800)  # surrogates are no characters
        return self[word]

    def spell(self, words: Iterable[bytes]) -> str:
        return "".join(map(self.get, words, repeat(FOREIGN)))


class Machine:
    """The automaton of a block of ``(item, text)``; items without an id are found like others, but not named."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], length: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, text in items:
            for window in windows(text, length):
                owners.setdefault(window, set()).add(item)
        self.letters = Letters()
        self.automaton = ahocorasick.Automaton()
        for window, having in owners.items():
            named = tuple(sorted(i for i in having if i is not None))
            self.automaton.add_word("".join(map(self.letters.add, window)), (len(window), named or (None,)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()
            self.runs = re.compile(f"[^{FOREIGN}]{{{min(map(len, owners))},}}")

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str | None]]]:
        """Number of words, and ``(first word, end word, item)`` of every occurrence of a window, in a normalised text."""
        words = text.split()
        if self.empty or not words:
            return len(words), []
        line = self.letters.spell(words)
        found = []
        for run in self.runs.finditer(line):
            for last, (n, items) in self.automaton.iter(line, run.start(), run.end()):
                found += [(last + 1 - n, last + 1, item) for item in items]
        return len(words), found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    block: list[tuple[str | None, str]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scanner(items: Broadcast, length: int):
    @F.pandas_udf(SCANNED)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = Machine(items.value, length)
        for batch in texts:
            found = [machine.scan(normalised(t)) for t in batch]
            yield pd.DataFrame({"n": [n for n, _ in found], "hits": pd.Series([h for _, h in found], dtype=object)})

    return scan


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words`` and ``hits``: ``(start, end, item)`` of each occurrence, in words.

    The benchmark is read in blocks of bounded size; each becomes one broadcast automaton that scans every text once,
    without an exchange. With several blocks the rows are staged between them. Null and empty texts have no words and
    no hits; a benchmark item without text or words finds nothing, an empty benchmark nothing at all. An item without
    id marks words like any other; its hits carry a null item, unless a named item has the same window. Items that
    share a window are all reported, repeated items once. An empty table stays empty; columns of ``docs`` named like
    a result are replaced.
    """
    docs = docs.drop("n_words", "hits")
    own, spark = [F.col(f"`{c}`") for c in docs.columns], docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.struct(*own or [F.lit(0)]).alias("row"), F.col(text_col).alias("text"))
    none = F.from_json(F.lit("[]"), HITS)
    rows = rows.withColumns({"n": F.lit(None).cast("bigint"), "hits": none})
    scanned = False
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if scanned:
            rows = stage(rows, "benchmark-hits")
        found = rows.withColumn("found", _scanner(spark.sparkContext.broadcast(block), length)(F.col("text")))
        rows = found.select("row", "text", F.col("found.n").alias("n"), F.concat("hits", "found.hits").alias("hits"))
        scanned = True
    if not scanned:
        rows = rows.withColumn("n", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("bigint"))
    back = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*back, F.col("n").alias("n_words"), "hits")


def original_spans(text: str, hits: Iterable[tuple[int, int, str | None]]) -> list[tuple[int, int, str | None]]:
    """Hits in words as code points of the original text, end exclusive."""
    flat = normalised(text)
    places = [m.span() for m in WORD.finditer(flat)]
    raw = text.encode("utf-8", "replace")
    chars = lambda at: len(raw[:at].decode("utf-8", "ignore"))
    return [(chars(places[a][0]), chars(places[b - 1][1]), item) for a, b, item in hits]


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """``n_hit``, ``items`` and ``contaminated`` from ``hits``: hit words make up one ``share``-th of all or more.

    Hits come in any order; their spans are walked by start and united.
    """
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    hit = F.when(F.size("hits") == 0, 0).otherwise(walk).cast("bigint")
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item"]), lambda i: i.isNotNull())))
    out = found.withColumns({"n_hit": hit, "items": items})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
