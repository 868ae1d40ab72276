import os
import random
import zlib

import numpy as np
import pytest

from packloom.llm import language, queries
from packloom.llm.language import Parser, draw_samples, fit, normalised, shifted_rows, suffix_automaton, with_language

TABLES = "/root/testdata/sf0.001"
SYLLABLES = {
    "aa": ["ka", "lo", "mi", "tu", "re"],
    "bb": ["sch", "en", "ung", "ver", "ä"],
    "cc": ["ты", "мо", "ра", "ни"],
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, sentence(rng, lang, rng.randint(3, 60)), lang))
    return out


def phrases_by_hand(text, sample, stretch):
    """Longest matches by plain substring search."""
    n = 0
    for first in range(0, len(text), stretch):
        piece = text[first : first + stretch]
        at = 0
        while at < len(piece):
            size = 1
            while at + size < len(piece) and piece[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
    return n


def test_phrases_against_substring_search(monkeypatch):
    rng = random.Random(1)
    samples = {lang: normalised(sentence(rng, lang, 60)) for lang in SYLLABLES}
    texts = [normalised(sentence(rng, rng.choice(sorted(SYLLABLES)), rng.randint(1, 80)) + rng.choice(["", "€ 12", "zz"])) for _ in range(40)]
    texts.append(b"")
    for stretch, lanes in ((1024, 4096), (7, 5), (1, 3)):
        monkeypatch.setattr(language, "STRETCH", stretch)
        monkeypatch.setattr(language, "LANES", lanes)
        got = Parser.of(samples).phrases(texts)
        want = [[phrases_by_hand(t, samples[lang], stretch) for lang in sorted(samples)] for t in texts]
        assert got.tolist() == want


def test_automaton_accepts_just_the_substrings():
    text = b"abcbcabbcabcacbbab"
    moves = suffix_automaton(text)
    rng = random.Random(2)
    base, owner, target = shifted_rows([{s: t for s, t in m.items()} for m in moves], 256)
    for _ in range(3000):
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6)))
        at, packed = 0, 0
        for s in word:
            at = moves[at].get(s) if at is not None else None
            if packed is not None:
                slot = base[packed] + s
                packed = target[slot] if owner[slot] == packed else None
        assert (at is not None) == (packed is not None) == (word in text)


def test_held_out_accuracy_and_labels(spark):
    rows = corpus(3, 400)
    held = {n for n in range(400) if zlib.crc32(str(n).encode()) % 3 == 1}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    found = {r.doc_id: r for r in with_language(docs, fit(docs)).collect()}
    right = [found[n].lang_pred == lang for n, _, lang in rows if n in held]
    assert len(right) > 80 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.doc_id for r in docs.where(language.is_held_out("doc_id")).collect()} == held
    turned = [(n, t, "xx" if n in held else lang) for n, t, lang in rows]
    other = spark.createDataFrame(turned, "doc_id bigint, text string, lang string")
    a, b = fit(docs), fit(other)
    assert a.languages == b.languages == sorted(SYLLABLES) and np.array_equal(a.target, b.target)


def test_sample_is_bounded_and_whole(spark):
    rows = [(n, f"kurz {'abcdefg'[n % 7]} {n}", "de") for n in range(200)] + [(900, "lang " * 100, "long"), (903, "lang " * 90, "long")]
    rows += [(n, None, "no") for n in range(5)] + [(n, "x", None) for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    samples = draw_samples(docs, "doc_id", "text", "lang", 16, 100)
    assert set(samples) == {"de", "long"}
    assert len(samples["de"]) <= 120 and samples["long"].split() in ([b"lang"] * 90, [b"lang"] * 100)
    assert samples["de"].decode().count("kurz") > 3


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_query_against_substring_search(spark):
    """The registered query, language by language, with longest matches found by plain search in the samples."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    samples = draw_samples(docs, "doc_id", "text", "lang", language.SAMPLE_ROWS, language.SAMPLE_CHARS)
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    right = []
    for row in queries.op11_language(spark, TABLES).collect():
        text, lang = texts[row.doc_id]
        cost = {
            name: phrases_by_hand(normalised(text), sample, language.STRETCH) * np.log2(len(sample)) for name, sample in samples.items()
        }
        assert row.lang_pred == min(sorted(cost), key=cost.get)
        assert np.isclose(row.score, 1 / sum(2.0 ** (min(cost.values()) - c) for c in cost.values()))
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        if row.held_out:
            right.append(row.lang_pred == lang)
    assert np.mean(right) > 0.97


def test_edges(spark, edge, nothing):
    learned = fit(spark.createDataFrame(corpus(5, 60), "doc_id bigint, text string, lang string"))
    odd = edge.withColumnsRenamed({"kept": "lang_pred"})
    found = with_language(odd, learned).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert dict(with_language(odd, learned).dtypes)["score"] == "double"
    assert with_language(nothing, learned).count() == 0
    unlearned = fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in with_language(edge, unlearned).collect()} == {("und", 0.0)}
    only_held = next(n for n in range(99) if zlib.crc32(str(n).encode()) % 3 == 1)
    assert not fit(spark.createDataFrame([(only_held, "abc", "x")], "doc_id bigint, text string, lang string")).languages
