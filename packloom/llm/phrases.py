"""Phrases whose words belong together, by best-first branch-and-bound growth.

A phrase of two to five words scores as its weakest cut: ``floor(1000 a n / (l r))`` with its own count ``a``, the counts
``l`` and ``r`` of the two parts, and ``n`` words in its language. ``a`` is at most ``l`` and at most ``r``, so cutting off
the first or the last word shows that no phrase scores more than ``1000 n / f`` for the count ``f`` of either: the count
of its first word bounds all that can grow from it. Rare words therefore promise most. Growth starts from the rarest
words that are frequent enough, counts the phrases that begin and end there, and goes on to more frequent words only
while one of them could still reach the last place of its language's list, ties included.

Words are counted as strings. Pairs are first counted by 64-bit digests, which costs numbers only: a pair that is
frequent always has a frequent digest, and a collision lets one more through. Longer phrases grow from such pairs, and
whatever is grown is counted as a string. Bit filters of bounded size carry these sets to the workers; a wrongly
admitted phrase costs one row and is dropped by its count. That all occurrences of a phrase have the same neighbour,
which drops it, is told by the neighbours' digests of 62 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.staging import discard, stage
from packloom.llm.batches import bound_batches
from packloom.llm.bit_filter import key_filter
from packloom.llm.exact_dedup import BITMAP_BITS
from packloom.llm.near_dedup import mix
from packloom.llm.text_slices import slices

LONGEST = 5
UNKNOWN = "und"
#: growth starts from the rarest words that make up one in so many words of a language
FIRST_SHARE = 8
#: distinct words, and bytes of text, that a worker gathers before it hands counts on
DISTINCT_KEPT = 300_000
BYTES_KEPT = 32 << 20
#: words from which on a worker forgets their digests; it also does from BYTES_KEPT bytes of words on
WORDS_KEPT = 300_000

#: stands for any mark that ends a piece; no word has it
BREAK = b"."
#: A to Z in lower case, marks and line ends as BREAK, tabs as blanks
PIECE_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)
)
FREQUENT, END = 1, 2
PLAIN = ~np.uint64(3)
WORD_FIELDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
GROWN = "lang string, phrase string, size int, n bigint, l_lo bigint, l_hi bigint, r_lo bigint, r_hi bigint"
GROWN_FIELDS = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())]
    + [(c, pa.int64()) for c in ("l_lo", "l_hi", "r_lo", "r_hi")]
)


def prepared(text: str | None) -> bytes:
    """Words between blanks, with BREAK as a word of its own between pieces."""
    return (text or "").encode("utf-8", "replace").translate(PIECE_BYTES).replace(BREAK, b" . ")


def words_ahead(blob: bytes, at: int, count: int) -> list[bytes]:
    """The next ``count`` words from ``at`` on, BREAK beyond the end."""
    out: list[bytes] = []
    while len(out) < count and at < len(blob):
        end = blob.find(b" ", at + 1)
        end = len(blob) if end < 0 else end
        word = blob[at:end].strip()
        if word:
            out.append(word)
        at = end
    return out + [BREAK] * (count - len(out))


def stretches(blob: bytes) -> Iterator[list[bytes]]:
    """The words of a text in stretches that a worker can hold, each with one word before and LONGEST words after it."""
    before = BREAK
    for start, end in slices(blob):
        words = blob[start:end].split()
        if words:
            yield [before, *words, *words_ahead(blob, end, LONGEST)]
            before = words[-1]


def digests(lang: str, words: Sequence[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def digest_of(values: Sequence[np.ndarray]) -> np.ndarray:
    """Digests of phrases from those of their words in order, whose two low bits do not count."""
    total = np.full(len(values[0]), len(values), np.uint64)
    for v in values:
        total = mix(total) + (v & PLAIN)
    return mix(total)


@dataclass
class BitFilter:
    """Two bits per key. A key that was put in tests true; few others do."""

    bits: int
    table: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in (keys & np.uint64(self.bits - 1), (keys >> np.uint64(32)) & np.uint64(self.bits - 1)):
            found &= (self.table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(keys: DataFrame) -> BitFilter:
    """A filter of the stored ``keys (digest)``; its bitmaps, 32 MB at most, come to the driver and go to the workers."""
    made = key_filter(keys, F.col("digest"))
    table = np.zeros(max(made.bits, BITMAP_BITS) // 8, np.uint8)
    for row in made.bitmaps.toLocalIterator():
        at = (row["bucket"] - 1) * BITMAP_BITS // 8
        table[at : at + BITMAP_BITS // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return BitFilter(made.bits, table)


def phrase_digests(phrases: DataFrame) -> DataFrame:
    """``(digest)`` of ``phrases (lang, phrase)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                words = phrase.encode().split(b" ")
                alike.setdefault((lang, len(words)), []).append(words)
            keys = [digest_of([digests(lang, w) for w in zip(*of, strict=True)]) for (lang, _), of in alike.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))], ["digest"])

    return phrases.select("lang", "phrase").mapInArrow(work, "digest bigint")


@dataclass
class Admitted:
    """Sets that a round works with: frequent words, the ends that growth may have, and what it has found so far."""

    frequent: BitFilter
    ends: BitFilter
    found: BitFilter | None = None


class Numbers(dict):
    """A number for every word, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """Digests of one language's words, with FREQUENT and END in their low bits."""

    def __init__(self, lang: str, admitted: Admitted):
        self.lang, self.admitted = lang, admitted
        self.forget()

    def forget(self) -> None:
        self.numbers, self.known, self.bytes = Numbers(), np.zeros(0, np.uint64), 0

    def values(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > WORDS_KEPT or self.bytes > BYTES_KEPT:
            self.forget()
        seen = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > seen:
            new = list(islice(self.numbers, seen, None))
            self.bytes += sum(map(len, new))
            plain = digests(self.lang, new)
            key = digest_of([plain])
            frequent = self.admitted.frequent.holds(key)
            if BREAK in self.numbers and self.numbers[BREAK] >= seen:
                frequent[self.numbers[BREAK] - seen] = False
            end = frequent & self.admitted.ends.holds(key)
            marked = (plain & PLAIN) | frequent * np.uint64(FREQUENT) | end * np.uint64(END)
            self.known = np.concatenate([self.known, marked])
        return self.known[at]


@dataclass
class Stretch:
    """One stretch: its words, their digests, and which words and neighbours in it are frequent."""

    words: list[bytes]
    values: np.ndarray

    def __post_init__(self) -> None:
        self.frequent = self.values & np.uint64(FREQUENT) > 0
        self.end = self.values & np.uint64(END) > 0
        self.together = self.frequent[:-1] & self.frequent[1:]
        self.own = len(self.words) - LONGEST

    def key(self, at: np.ndarray, size: int) -> np.ndarray:
        return digest_of([self.values[at + k] for k in range(size)])

    def pair_keys(self) -> np.ndarray:
        """Digests of the pairs of frequent words with an end."""
        at = np.flatnonzero(self.together & (self.end[:-1] | self.end[1:]))
        return self.key(at[(at > 0) & (at < self.own)], 2)

    def grown(self, pairs: BitFilter) -> Iterator[tuple[int, np.ndarray]]:
        """Size and places of phrases between two ends, all of whose pairs with an end are frequent."""
        together = self.together.copy()
        asked = np.flatnonzero(together & (self.end[:-1] | self.end[1:]))
        together[asked] = pairs.holds(self.key(asked, 2))
        run = together[: self.own].copy()
        run[0] = False
        for size in range(2, LONGEST + 1):
            if size > 2:
                run &= together[size - 2 : size - 2 + self.own]
            at = np.flatnonzero(run & self.end[: self.own] & self.end[size - 1 : size - 1 + self.own])
            if len(at):
                yield size, at

    def listed(self, parts: BitFilter) -> Iterator[tuple[int, np.ndarray]]:
        """Size and places of phrases shorter than the longest, with an end first or last, that ``parts`` holds."""
        run = self.together[: self.own].copy()
        run[0] = False
        for size in range(2, LONGEST):
            if size > 2:
                run &= self.together[size - 2 : size - 2 + self.own]
            at = np.flatnonzero(run & (self.end[: self.own] | self.end[size - 1 : size - 1 + self.own]))
            at = at[parts.holds(self.key(at, size))]
            if len(at):
                yield size, at

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """For the phrases at these places: a place of each, its occurrences, and the range of its neighbours' digests.

        A neighbour that is not frequent, or none, has digest 0.
        """
        key = self.key(at, size)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        differ = key[1:] != key[:-1]
        for k in range(size):  # two phrases of one digest stay apart
            differ |= self.values[at[1:] + k] != self.values[at[:-1] + k]
        starts = np.flatnonzero(np.r_[True, differ])
        out = [at[starts], np.diff(np.r_[starts, len(at)])]
        for beside in (at - 1, at + size):
            near = np.where(self.frequent[beside], self.values[beside] & PLAIN, np.uint64(0)).view(np.int64)
            out += [np.minimum.reduceat(near, starts), np.maximum.reduceat(near, starts)]
        return tuple(out)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The batch's texts of each language as one."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        texts.setdefault(lang, []).append(prepared(text))
    for lang, blobs in texts.items():
        yield lang, b" . ".join(blobs)


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, n)`` of the words that occur ``least`` times in ``docs (lang, text)``.

    The row of a language without a phrase has the number of all its words.
    """

    def rows_of(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(BREAK, None)
            total = sum(found.values())
            words = pa.array(found.keys(), pa.binary()).cast(pa.string())
            phrases = pa.concat_arrays([words, pa.nulls(1, pa.string())])
            n = pa.array([*found.values(), total], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)), phrases, n], schema=WORD_FIELDS)
        counts.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        read = 0
        for batch in batches:
            for lang, blob in _by_language(batch):
                for start, end in slices(blob):
                    counts.setdefault(lang, Counter()).update(blob[start:end].split())
                    read += end - start
                    if read >= BYTES_KEPT or sum(map(len, counts.values())) >= DISTINCT_KEPT:
                        yield from rows_of(counts)
                        read = 0
        yield from rows_of(counts)

    counted = docs.mapInArrow(work, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | F.col("phrase").isNull())


def pair_digests(docs: DataFrame, admitted: Admitted, least: int) -> DataFrame:
    """``(digest)`` of all pairs of frequent words with an end that may occur ``least`` times in ``docs (lang, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(admitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: dict[str, Words] = {}
        for batch in batches:
            for lang, blob in _by_language(batch):
                known = caches.setdefault(lang, Words(lang, sent.value))
                for words in stretches(blob):
                    keys, n = np.unique(Stretch(words, known.values(words)).pair_keys(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["digest", "n"])

    counted = docs.mapInArrow(work, "digest bigint, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("digest")


def count_phrases(docs: DataFrame, admitted: Admitted, least: int, parts: bool = False) -> DataFrame:
    """``(lang, phrase, size, n, l_lo, l_hi, r_lo, r_hi)`` of phrases that occur ``least`` times in ``docs (lang, text)``.

    Phrases grow between two ends from the pairs that ``admitted`` has found, or with ``parts`` are those it has found.
    The other columns are the least and greatest digest of the words before and after it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(admitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = sent.value
        caches: dict[str, Words] = {}
        for batch in batches:
            for lang, blob in _by_language(batch):
                known = caches.setdefault(lang, Words(lang, allowed))
                for words in stretches(blob):
                    here = Stretch(words, known.values(words))
                    for size, at in here.listed(allowed.found) if parts else here.grown(allowed.found):
                        first, *numbers = here.counted(at, size)
                        phrases = [b" ".join(words[f : f + size]) for f in first.tolist()]
                        strings = pa.array(phrases, pa.binary()).cast(pa.string())
                        columns = [pa.repeat(lang, len(phrases)), strings, pa.array(np.full(len(phrases), size, np.int32))]
                        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, numbers)], schema=GROWN_FIELDS)

    ranges = [F.min(c).alias(c) if c.endswith("lo") else F.max(c).alias(c) for c in ("l_lo", "l_hi", "r_lo", "r_hi")]
    counted = docs.mapInArrow(work, GROWN).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"), *ranges)
    return counted.where(F.col("n") >= least)


def _part(first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def _cuts(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, k, left, right)``: every way to cut ``phrases (lang, phrase, size, n)`` after ``k`` words."""
    words = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    each = words.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    left, right = _part(1, F.col("k")), _part(F.col("k") + 1, F.col("size") - F.col("k"))
    return each.select("lang", "phrase", "size", "a", "k", left.alias("left"), right.alias("right"))


def weakest_cuts(cuts: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, l, r, n, score, first, last)`` of phrases given by all their ``cuts``.

    ``l`` and ``r`` are of the lowest-scoring cut, of the shorter first part if scores are equal; ``first`` and ``last``
    are the counts of the end words. ``counts (lang, phrase, n)`` has all parts.
    """
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    whole = totals.select("lang", F.col("n").cast("bigint").alias("n"))
    score = F.expr(
        "(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)))"
        " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    )
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(F.broadcast(whole), "lang")
    cut = F.struct(score.alias("score"), "k", "l", "r")
    return (
        scored.groupBy("lang", "phrase", "size", "a", "n")
        .agg(
            F.min(cut).alias("cut"),
            F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first"),
            F.max(F.when(F.col("k") == F.col("size") - 1, F.col("r"))).alias("last"),
        )
        .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score", "first", "last")
    )


def _settling(alive: DataFrame, limits: dict[str, int], largest: dict[str, int], top: int) -> list[str]:
    """Languages whose lists this round may settle: full ones, and those whose words have all joined."""
    full = alive.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= top).collect()
    return sorted({r["lang"] for r in full} | {lang for lang, limit in limits.items() if limit >= largest[lang]})


def _grown(
    docs: DataFrame, words: DataFrame, totals: DataFrame, limits: dict[str, int], largest: dict[str, int], least: int, top: int
) -> DataFrame:
    """The best ``top`` surviving phrases of each language of ``limits`` whose end words occur at most that often.

    A language with words left and too few phrases to fill its list has none: it needs a further round anyway.
    """
    spark = docs.sparkSession
    limit = F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, most bigint"))
    mine = words.join(limit, "lang")
    texts = docs.where(F.col("lang").isin(list(limits)))
    keys = stage(phrase_digests(mine), "word-digests"), stage(phrase_digests(mine.where(F.col("n") <= F.col("most"))), "end-digests")
    admitted = Admitted(*map(filter_of, keys))
    pairs = stage(pair_digests(texts, admitted, least), "pair-digests")
    admitted.found = filter_of(pairs)
    grown = stage(count_phrases(texts, admitted, least), "grown")
    same = ((F.col("l_lo") == F.col("l_hi")) & (F.col("l_lo") != 0)) | ((F.col("r_lo") == F.col("r_hi")) & (F.col("r_lo") != 0))
    alive = grown.where((F.col("size") == LONGEST) | ~same)
    enough = _settling(alive, limits, largest, top)
    cuts = stage(_cuts(alive.where(F.col("lang").isin(enough))), "cuts")
    counts = words.select("lang", "phrase", "n").unionByName(grown.select("lang", "phrase", "n"))
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct()
    missing = stage(parts.join(counts, ["lang", "phrase"], "left_anti"), "missing-parts")
    if not missing.isEmpty():
        needed = stage(phrase_digests(missing), "part-digests")
        further = count_phrases(texts.where(F.col("lang").isin(enough)), Admitted(admitted.frequent, admitted.ends, filter_of(needed)), least, parts=True)
        further = stage(further.join(missing, ["lang", "phrase"], "left_semi").select("lang", "phrase", "n"), "parts")
        counts = counts.unionByName(further)
    scored = weakest_cuts(cuts, counts, totals).join(limit, "lang")
    scored = scored.where(F.greatest("first", "last") <= F.col("most"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_phrases(
    docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases.

    Words stand between blanks and tabs inside pieces, which end at ``. , ; : ! ?`` and line ends; A to Z are lowered. A
    phrase has two to five words of one piece and occurs ``least`` times or more in its language, overlaps included. It
    is dropped if a longer phrase that contains it occurs as often, which then holds for one of just one word more.
    Order: score, then ``a``, both descending, then the phrase by its bytes. Null languages count as ``und``, null texts as
    empty; a language without such a phrase, and an empty table, give no rows. Repeated rows all count; other columns
    are not read.

    Documents are read once for single words and three times per round of growth. A round's end words occur at most
    ``limit`` times; with any other a phrase can reach ``1000 n / (limit + 1)`` at best. A full list whose last score is
    above that is settled, and so are its ties; else its last score tells up to which count words must join, which settles
    it in one more round. Where the first round does not fill a list, the second has all words. The driver holds a few
    numbers per language.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    counted = stage(count_words(texts, least), "words")
    totals = counted.where(F.col("phrase").isNull()).select("lang", "n")
    words = counted.where(F.col("phrase").isNotNull())
    known = {r["lang"]: r["n"] for r in totals.collect()}
    by_count = words.groupBy("lang", "n").agg(F.sum("n").alias("mass"))
    so_far = F.sum("mass").over(Window.partitionBy("lang").orderBy("n"))
    running = by_count.withColumn("so_far", so_far).join(totals.select("lang", F.col("n").alias("total")), "lang")
    share = F.min(F.when(F.col("so_far") * F.lit(FIRST_SHARE) >= F.col("total"), F.col("n")))
    bounds = running.groupBy("lang").agg(F.max("n").alias("largest"), F.coalesce(share, F.max("n")).alias("first")).collect()
    largest = {r["lang"]: r["largest"] for r in bounds}
    limits = {r["lang"]: r["first"] for r in bounds}
    settled = []
    while limits:
        best = stage(_grown(texts, words, totals, limits, largest, least, top), "phrases")
        last = {r["lang"]: r for r in best.groupBy("lang").agg(F.count("*").alias("places"), F.min("score").alias("score")).collect()}
        further = {}
        for lang, limit in limits.items():
            if limit >= largest[lang]:
                continue
            if lang not in last or last[lang]["places"] < top:
                further[lang] = largest[lang]
            elif last[lang]["score"] <= 1000 * known[lang] // (limit + 1):
                further[lang] = min(largest[lang], 1000 * known[lang] // max(1, last[lang]["score"]))
        settled.append(best.where(F.col("lang").isin([lang for lang in limits if lang not in further])))
        limits = further
    if not settled:
        schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
        return docs.sparkSession.createDataFrame([], schema)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out
