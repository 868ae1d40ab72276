"""Language of a text by cross-parsing entropy (Ziv and Merhav, 1993).

A sample of labelled text per language becomes a suffix automaton, which knows every substring of the sample. A text is
parsed against it: each phrase is the longest match from where the last one ended. Few phrases mean that the sample
predicts the text well: phrases times the logarithm of the sample's length estimate the bits that the text costs, and
the language that needs least wins.

Parsing runs in numpy over many stretches at once: texts are cut into stretches of at most ``STRETCH`` bytes, a phrase
ends with its stretch, and each step moves all stretches, under all languages, by one byte. The automata lie in one
table where rows of transitions are shifted into each other's gaps, so it stays about as large as their samples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches

#: labelled rows drawn per language at most
SAMPLE_ROWS = 256
#: characters of whole texts that a language's sample has at most, if it has a text that short
SAMPLE_CHARS = 40_000
#: bytes of a text that are parsed in one go
STRETCH = 1024
#: stretches that are parsed together
LANES = 4096
UNKNOWN = "und"
#: marks, digits and white space, which say nothing about the language
OTHERS = re.compile(r"[\W\d_]+")


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts the substrings of ``text``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


def shifted_rows(rows: Sequence[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``owner``, ``target``: row r moves by symbol s to ``target[base[r] + s]`` if ``owner`` there is r.

    Rows with many symbols come first. A row looks for its place from that of the last row of as many symbols on, so
    each place is tried about once per number of symbols; rows of one symbol fill what is left.
    """
    base = np.zeros(len(rows), np.int32)
    owner = [-1] * (2 * width)
    target = [0] * (2 * width)
    start, degree = 0, 0
    for row in sorted(range(len(rows)), key=lambda r: -len(rows[r])):
        symbols = sorted(rows[row])
        if not symbols:
            continue
        if len(symbols) == degree:
            shift = start
        else:
            shift, degree = max(0, owner.index(-1) - symbols[-1]), len(symbols)
        while any(owner[shift + s] >= 0 for s in symbols):
            shift += 1
            if shift + 2 * width >= len(owner):
                owner += [-1] * len(owner)
                target += [0] * len(target)
        start = shift
        base[row] = shift
        for s in symbols:
            owner[shift + s], target[shift + s] = row, rows[row][s]
    used = max((i for i, o in enumerate(owner) if o >= 0), default=0) + width + 1
    owner += [-1] * max(0, used - len(owner))
    target += [0] * max(0, used - len(target))
    return base, np.array(owner[:used], np.int32), np.array(target[:used], np.int32)


@dataclass
class Parser:
    """Automata of all ``languages``; ``symbol`` numbers the bytes that samples have, 0 being all others.

    ``restart[l, s]`` is the state of language l after symbol s alone, or its dead end, which has no transitions.
    """

    languages: list[str]
    bits: np.ndarray
    symbol: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    restart: np.ndarray

    @classmethod
    def of(cls, samples: dict[str, bytes]) -> Parser:
        languages = sorted(samples)
        symbol = np.zeros(256, np.int32)
        seen = sorted({b for text in samples.values() for b in text})
        symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        rows: list[dict[int, int]] = [{}]
        restart = np.zeros((len(languages), width), np.int32)
        for n, language in enumerate(languages):
            start = len(rows)
            for moves in suffix_automaton(samples[language]):
                rows.append({int(symbol[b]): start + t for b, t in moves.items()})
            for s, state in rows[start].items():
                restart[n, s] = state
        bits = np.array([np.log2(max(2, len(samples[c]))) for c in languages])
        return cls(languages, bits, symbol, *shifted_rows(rows, width), restart)

    def phrases(self, texts: Sequence[bytes]) -> np.ndarray:
        """Number of phrases (texts, languages)."""
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        which: list[int] = []
        pieces: list[bytes] = []
        for n, text in enumerate(texts):
            for at in range(0, len(text), STRETCH):
                which.append(n)
                pieces.append(text[at : at + STRETCH])
                if len(pieces) == LANES:
                    self._parse(pieces, which, counts)
                    which, pieces = [], []
        if pieces:
            self._parse(pieces, which, counts)
        return counts

    def _parse(self, pieces: list[bytes], which: list[int], counts: np.ndarray) -> None:
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[order[0]])
        lanes = np.zeros((len(pieces), longest), np.uint8)
        for lane, n in enumerate(order):
            lanes[lane, : sizes[n]] = np.frombuffer(pieces[n], np.uint8)
        steps = np.ascontiguousarray(self.symbol[lanes].T)
        active = len(pieces) - np.searchsorted(sizes[order][::-1], np.arange(longest), side="right")
        found = np.zeros((len(self.languages), len(pieces)), np.int64)
        for n in range(len(self.languages)):
            state, count, again = np.zeros(len(pieces), np.int32), found[n], self.restart[n]
            for step, k in zip(steps, active.tolist(), strict=True):
                symbols, now = step[:k], state[:k]
                slot = self.base[now] + symbols
                broken = self.owner[slot] != now
                count[:k] += broken
                state[:k] = np.where(broken, again[symbols], self.target[slot])
        np.add.at(counts, np.array(which)[order], found.T)

    def judge(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Each text's language and the share of probability that its code length gives it among all languages."""
        told = [UNKNOWN] * len(texts)
        scores = [0.0] * len(texts)
        lettered = [n for n, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.languages or not lettered:
            return told, scores
        counts = self.phrases([normalised(texts[n]) for n in lettered])
        cost = counts * self.bits
        best = cost.argmin(axis=1)
        spare = (cost - cost.min(axis=1, keepdims=True)) * np.log(2)
        share = 1 / np.exp(-np.minimum(spare, 700)).sum(axis=1)
        for row, n in enumerate(lettered):
            told[n], scores[n] = self.languages[best[row]], float(share[row])
        return told, scores


def normalised(text: str) -> bytes:
    """Letters in lower case, in UTF-8; whatever stands between letters is one blank."""
    return OTHERS.sub(" ", text.lower()).encode("utf-8", "replace")


def is_held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def draw_samples(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int, sample_chars: int
) -> dict[str, bytes]:
    """A bounded sample per language, from whole texts of rows that are not held out.

    Rows fall into ``sample_rows`` slots by a digest of id and text, and each slot gives the one with the least second
    digest, so no more rows are ever fetched per language, and draws combine on the map side. Texts of more than
    ``sample_chars`` characters are drawn only for a language without shorter ones; then its shortest text is the
    sample. Drawn texts are taken in order of their digest while they fit.
    """
    text = F.col(text_col)
    digest = F.xxhash64(F.col(id_col), text, F.lit(2))
    rows = docs.where(text.isNotNull() & F.col(lang_col).isNotNull() & ~is_held_out(id_col)).where(F.trim(text) != "")
    size = F.length(text)
    short = size <= sample_chars
    slot = F.when(short, F.pmod(F.xxhash64(F.col(id_col), text, F.lit(1)), F.lit(sample_rows))).otherwise(-1)
    first = F.struct(F.when(short, 0).otherwise(size).alias("long"), digest.alias("digest"))
    drawn = rows.groupBy(F.col(lang_col).alias("__lang"), slot.alias("__slot")).agg(F.min(first).alias("first"))
    chosen: dict[str, list[tuple[int, int, int]]] = {}
    for row in drawn.collect():
        chosen.setdefault(row["__lang"], []).append((row["__slot"] < 0, row["first"]["long"], row["first"]["digest"]))
    wanted = [(lang, d) for lang, all_of in chosen.items() for long, _, d in all_of if not long or len(all_of) == 1]
    if not wanted:
        return {}
    listed = docs.sparkSession.createDataFrame(wanted, "__lang string, __digest bigint")
    met = (F.col(lang_col) == F.col("__lang")) & (digest == F.col("__digest"))
    texts = rows.join(F.broadcast(listed), met).groupBy("__lang", "__digest").agg(F.min(text).alias("__text")).collect()
    samples: dict[str, bytes] = {}
    room = {lang: sample_chars for lang in chosen}
    for row in sorted(texts, key=lambda r: (r["__lang"], r["__digest"])):
        lang, words = row["__lang"], row["__text"]
        if len(words) <= room[lang] or lang not in samples:
            samples[lang] = samples.get(lang, b"") + b" " + normalised(words)
            room[lang] -= len(words)
    return samples


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
) -> Parser:
    """A parser for every language of ``docs`` that has a row to learn from.

    At most ``sample_rows`` whole texts of at most ``sample_chars`` characters together, or one longer text, teach a
    language. Rows without a text or language, and held-out rows, teach nothing; id and language never enter a score.
    """
    return Parser.of(draw_samples(docs, id_col, text_col, lang_col, sample_rows, sample_chars))


def with_language(docs: DataFrame, parser: Parser, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), from its whole text alone.

    A null text, one without a letter, and any text where no language was learned gives ``und`` and 0. Equal costs go
    to the language first in order. An empty table stays empty; columns of ``docs`` named like a result are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            told, scores = sent.value.judge(batch.tolist())
            yield pd.DataFrame({"lang_pred": told, "score": scores})

    own = docs.columns
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in own] or [F.lit(0)]).alias("__row"), judge(F.col(text_col)).alias("__told"))
    return judged.select(*[F.col("__row").getField(c).alias(c) for c in own], "__told.lang_pred", "__told.score")
