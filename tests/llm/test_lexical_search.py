import math
import random
import re

import numpy as np
import pytest

from packloom.llm import lexical_search
from packloom.llm.lexical_search import Best, count_terms, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k):
    """Every item's ranking straight from the rule."""
    split = [(doc, terms(text)) for doc, text in docs]
    n_docs, length = sum(bool(ws) for _, ws in split), sum(len(ws) for _, ws in split)
    out = []
    for item, text in items:
        asked = set(terms(text))
        weight = {}
        for t in asked:
            df = sum(t in ws for _, ws in split)
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        scored = []
        for doc, ws in split:
            score = 0
            for t in asked:
                tf = ws.count(t)
                if tf:
                    m = 50 + (50 * len(ws) * n_docs) // length
                    score += weight[t] * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else doc, -score))
    return sorted(out, key=repr)


def corpus(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "ALPHA", "x1", "日本"]
    text = lambda m: rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randint(0, m)))
    docs = [(n, text(40)) for n in range(n_docs)]
    docs += [(n_docs + n, docs[5][1]) for n in range(30)]
    return docs, [(n, text(12)) for n in range(n_items)]


def ranked(df):
    return sorted(((r.item_id, r["rank"], r.id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 3)
    docs, items = corpus(1, 120, 9)
    docs += [(None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (400, None), (401, ""), (402, "--- !!")]
    items += [(50, None), (51, "..."), (52, "nowhere"), (None, "w1 w1 w2")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    assert ranked(search(d, i, 20, block_bytes=block_bytes)) == by_hand(docs, items, 20)


def test_products_stay_exact(monkeypatch):
    """Cutting the terms of a product finer changes nothing."""
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 30_000, 500)
    asked = [(n, set(rng.integers(0, 500, 40).tolist())) for n in range(10)]
    tile = lexical_search.tiles_of(asked, weights)[0]
    rows, cols = np.nonzero(rng.random((20, 500)) < 0.3)
    impacts = rng.integers(1, lexical_search.IMPACT_BOUND, len(rows))
    want = np.zeros((20, 10), np.int64)
    for r, c, x in zip(rows, cols, impacts, strict=True):
        for j, (_, ts) in enumerate(asked):
            want[r, j] += int(weights[c]) * int(x) if c in ts else 0
    for bound in (lexical_search.EXACT, 1 << 36):
        monkeypatch.setattr(lexical_search, "EXACT", bound)
        assert np.array_equal(lexical_search.tile_scores(rows, cols, impacts, 20, tile, weights), want)


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 4, (300, 5)), rng.permutation(300)
    best = Best(5, 10)
    for at in range(0, 300, 37):
        best.add(scores[at : at + 37], ids[at : at + 37], np.zeros(len(ids[at : at + 37]), np.int64))
    for item in range(5):
        got = [(s, i) for it, s, _, i in best.found.T if it == item]
        want = sorted((-s, i) for s, i in zip(scores[:, item], ids, strict=True) if s > 0)[:10]
        assert got == [(-s, i) for s, i in want]


def test_long_text_in_slices(monkeypatch):
    text = " ".join(random.Random(2).choice(["aa", "Bb", "cc,dd", "é"]) for _ in range(5000))
    whole = count_terms(text)
    monkeypatch.setattr(lexical_search.slices, "__defaults__", (64,))
    assert count_terms(text) == whole and whole[0] == len(terms(text))


def test_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "alpha LONG", 3)], "item_id bigint, text string, score int")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert ranked(search(edge, items)) == by_hand(docs, [(1, "alpha LONG")], 50)
    assert search(nothing, items).count() == 0 and search(edge, items.limit(0)).count() == 0
    assert search(edge, items).columns == ["item_id", "rank", "id", "score"]
