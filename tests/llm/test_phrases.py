import random
import re
from collections import Counter

import pytest

from packloom.llm import phrases
from packloom.llm.phrases import BitFilter, digest_of, digests, filter_of, mine_phrases, phrase_digests, prepared, words_ahead

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    """The whole rule over all phrases, without any pruning."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for size in range(1, 6):
                for i in range(len(ws) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i : i + size])] += 1
    out = []
    for lang, found in counts.items():
        n = total[lang]
        frequent = {p: a for p, a in found.items() if a >= least and len(p) > 1}
        dropped = set()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inner = p[i : i + size]
                    if a >= found[inner]:
                        dropped.add(inner)
        kept = []
        for p, a in frequent.items():
            if p in dropped:
                continue
            score, k = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def mined(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["The", "of", "Ünd", "x-y", "(a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = [" ".join(rng.choices(words, k=rng.randint(2, 7))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, weights, k=rng.randint(1, 9))))
        rows.append((i, rng.choice(["de", "en", None]), rng.choice([". ", ", ", "  ", "\t", "\n", "\r\n"]).join(parts)))
    return rows


@pytest.mark.parametrize(("least", "top", "share"), [(5, 2000, 8), (4, 10, 3), (3, 7, 10**6)])
def test_against_brute_force(spark, monkeypatch, least, top, share):
    """Small lists make growth stop early; a small share starts it from the rarest words alone."""
    monkeypatch.setattr(phrases, "FIRST_SHARE", share)
    rows = corpus(7, 150) + [(900, "en", None), (901, None, ""), (902, "fr", "w1"), (903, "fr", " . ; ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)
    got = mined(mine_phrases(docs, least, top))
    assert got and got == by_hand([(lang, text) for _, lang, text in rows], least, top)


def test_growth_stops_early(spark, monkeypatch):
    """Where rare words fill the list, frequent ones are never grown."""
    limits = []
    grown = phrases._grown
    monkeypatch.setattr(phrases, "_grown", lambda d, w, t, most, *rest: limits.append(dict(most)) or grown(d, w, t, most, *rest))
    rows = [(n, "en", f"{n} rare{n % 40} pair{n % 40} x{n} the of the of and the of") for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = mined(mine_phrases(docs, 10, 20))
    assert got == by_hand([(lang, text) for _, lang, text in rows], 10, 20)
    assert len(limits) <= 2 and all(m["en"] < 400 for m in limits)


def test_slices_and_flushes_do_not_matter(spark, monkeypatch):
    rows = corpus(9, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(2)
    want = by_hand([(lang, text) for _, lang, text in rows], 4, 50)

    def small(blob, size=40):
        from packloom.llm.text_slices import slices

        return slices(blob, size)

    monkeypatch.setattr(phrases, "DISTINCT_KEPT", 20)
    monkeypatch.setattr(phrases, "slices", small)
    assert mined(mine_phrases(docs, 4, 50)) == want


def test_words():
    assert prepared("Ab, C\td\x0be É").split() == [b"ab", b".", b"c", b"d", b".", b"e", "É".encode()]
    blob = b"aa bb  cc dd"
    assert words_ahead(blob, 2, 2) == [b"bb", b"cc"] and words_ahead(blob, len(blob), 2) == [b".", b"."]
    assert words_ahead(blob, 2, 4) == [b"bb", b"cc", b"dd", b"."]
    assert list(phrases.stretches(b"aa bb")) == [[b".", b"aa", b"bb", *[b"."] * 5]] and not list(phrases.stretches(b"  "))


def test_filter_holds_what_was_put_in(spark):
    keys = [("de", f"w{n} x{n % 7}") for n in range(500)]
    made = filter_of(phrase_digests(spark.createDataFrame(keys, "lang string, phrase string")))
    of = lambda lang, text: digest_of([digests(lang, [w]) for w in text.encode().split()])
    assert all(made.holds(of(*k))[0] for k in keys)
    assert sum(made.holds(of("en", k[1]))[0] for k in keys) < 50
    assert isinstance(made, BitFilter)


def test_edges(spark, edge, nothing):
    named = edge.withColumnRenamed("score", "lang")
    rows = [(r.lang, r.text) for r in named.collect()]
    assert mined(mine_phrases(named, 2)) == by_hand(rows, 2, 2000)
    assert mine_phrases(nothing.withColumnRenamed("score", "lang")).count() == 0
    assert mine_phrases(named, 10**6).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
