"""A vocabulary in bounded memory: frequent words by mergeable summaries, then an exact count of what is left.

Every task keeps at most ``keep`` counters (Misra and Gries, 1982). When there are more, the largest count beyond them
is taken off all and added to the task's error, so a counter is never above the true count and below it by the error at
most. Summaries of tasks are added up, errors too (Agarwal et al., 2012). Words whose bound reaches the vocabulary's
last place are counted exactly; if the error could hide a word, a further round keeps more counters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.staging import discard, stage
from packloom.operators.tokens import numbered_words, words

WORD = re.compile(r"[^ \t\n\r]+")
#: counters per word of the vocabulary that the first round keeps, and how many times more each further one has
KEEP_PER_WORD = 4
GROWTH = 8


class Summary:
    """Counts that fall short of the true ones by ``error`` at most, for at most ``2 * keep`` words at any time."""

    def __init__(self, keep: int):
        self.keep, self.error = keep, 0
        self.counts: Counter[str] = Counter()

    def add(self, seen: Counter[str]) -> None:
        for word, n in seen.items():
            self.counts[word] += n
            if len(self.counts) >= 2 * self.keep:
                self.shrink()

    def shrink(self) -> None:
        """Down to ``keep`` counters."""
        if len(self.counts) <= self.keep:
            return
        off = sorted(self.counts.values(), reverse=True)[self.keep]
        self.counts = Counter({w: n - off for w, n in self.counts.items() if n > off})
        self.error += off


def word_summaries(df: DataFrame, keep: int) -> DataFrame:
    """``(token, n)``: each task's summary of the words of ``text``; the row without a token has its error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(keep)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                summary.add(Counter(m.group() for m in WORD.finditer(text or "")))
        summary.shrink()
        rows = [(None, summary.error), *summary.counts.items()]
        tokens, counts = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "n"])

    return df.select("text").mapInArrow(work, "token string, n bigint")


def candidates(df: DataFrame, size: int, specials: Sequence[str], keep: int) -> tuple[DataFrame, DataFrame, bool]:
    """``(token, n)`` of words that may be among the ``size`` most frequent, the merged summary they are read from, and whether
    no other word can be."""
    named = ~F.col("token").isin(list(specials))
    merged = word_summaries(df, keep).groupBy("token").agg(F.sum("n").alias("n"))
    merged = stage(merged, "word-summary")
    error = merged.where("token is null").first()
    error = error["n"] if error else 0
    known = merged.where(F.col("token").isNotNull() & named)
    kinds = known.groupBy("n").agg(F.count("*").alias("words"))
    reach = F.sum("words").over(Window.orderBy(F.desc("n")))
    last = kinds.withColumn("reach", reach).where(F.col("reach") >= size).agg(F.max("n").alias("n")).first()["n"]
    least = last or 0
    return known.where(F.col("n") + error >= least).select("token"), merged, error == 0 or error < least


def vocab_summary(df: DataFrame, size: int, specials: Sequence[str] = ("<unk>",), keep: int | None = None) -> DataFrame:
    """``(token, id, n)`` as ``build_vocab`` gives it, without an exchange of all distinct words.

    A task holds ``2 * keep`` counters (``keep`` is ``4 * size`` at first), exchanges at most ``keep`` of them, and then at most
    one row per candidate. Each round reads the texts once, the exact count once more. A round whose error reaches the
    count of the vocabulary's last word is followed by one with eight times the counters. Ties at the last place are all
    counted and settled in token order. An empty corpus has the specials alone.
    """
    keep = KEEP_PER_WORD * max(1, size) if keep is None else keep
    while True:
        asked, merged, certain = candidates(df, size, specials, keep)
        if certain:
            break
        discard(merged)
        keep *= GROWTH
    occurrences = df.select(F.explode(words(F.col("text"))).alias("token"))
    counted = occurrences.join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return numbered_words(stage(counted, "candidate-counts"), size, specials)
