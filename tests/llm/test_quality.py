import math
import os
import random
import zlib

import numpy as np
import pytest

from packloom.llm import queries
from packloom.llm.quality import PAD, ByteNet, fit, is_held_out, train, with_quality

TABLES = "/root/testdata/sf0.001"


def samples(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        out.append((" ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    return out


def test_learns_from_bytes():
    seen, held = samples(300, 1), samples(200, 2)
    net = train([t for t, _ in seen], [y for _, y in seen], epochs=6)
    assert np.mean([(net.score(t) >= 0.7) == y for t, y in held]) > 0.97


def test_pieces_do_not_change_a_score(monkeypatch):
    net = ByteNet.fresh(16, 8, 4, 6, 0)
    text = "some text with änd ünd " * 400
    whole = net.score(text)
    monkeypatch.setattr("packloom.llm.quality.SPAN", 256)
    assert np.isclose(net.score(text), whole, atol=1e-6)
    assert net.score(text + "!!!!!!!!!!!!!!!!!!!!") != whole or net.score("!" * 40) != net.score("a" * 40)


def test_gradients_match_differences():
    net = ByteNet.fresh(4, 2, 3, 5, 3)
    for w in net.weights():
        w += np.random.default_rng(1).normal(0, 0.3, w.shape).astype(np.float32)
    net = ByteNet(net.chunk, net.stride, *[w.astype(np.float64) for w in net.weights()])
    values = net.padded("gradient check text")
    sums = [np.zeros_like(w) for w in net.weights()]
    net.gradients(values, 1.0, sums)
    for w, g in zip(net.weights(), sums, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        losses = []
        for step in (1e-3, -2e-3, 1e-3):
            w[at] += step
            losses.append(-np.log(net.score("gradient check text")))
        assert np.isclose((losses[0] - losses[1]) / 2e-3, g[at], rtol=0.1, atol=2e-3)


def test_held_out_labels_are_not_learned(spark, edge, nothing):
    rows = samples(240, 5)
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    labels = [(n, y) for n, (_, y) in enumerate(rows)]
    held = {n for n in range(240) if zlib.crc32(str(n).encode()) % 4 == 2}
    turned = [(n, 1 - y if n in held else y) for n, y in labels] + [(None, 1), (3, None)]
    schema = "doc_id bigint, quality int"
    a, b = (fit(docs, spark.createDataFrame(x, schema), sample_rows=120) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a.weights(), b.weights(), strict=True))
    got = {r.doc_id for r in docs.where(is_held_out("doc_id")).collect()}
    assert got == held
    scored = with_quality(edge, a)
    found = scored.collect()
    assert dict(scored.dtypes)["score"] == "double" and len(found) == edge.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert len({r.score for r in found if not r.text}) == 1
    assert with_quality(nothing, a).count() == 0
    assert fit(docs, spark.createDataFrame([], schema)).score("x") == ByteNet.fresh(16, 8, 8, 32, 7).score("x")


def by_hand(net, text):
    """Chunk after chunk of the whole text, without views, spans or padding in advance."""
    raw = list((text or "").encode())
    best = [-math.inf] * len(net.bias)
    at = 0
    while True:
        chunk = raw[at : at + net.chunk]
        chunk += [PAD] * (net.chunk - len(chunk))
        response = np.concatenate([net.embed[b] for b in chunk]) @ net.filters
        best = [max(a, float(b)) for a, b in zip(best, response, strict=True)]
        if at + net.chunk >= len(raw):
            break
        at += net.stride
    z = float(net.offset[0])
    for value, bias, out in zip(best, net.bias, net.out, strict=True):
        z += max(0.0, value + float(bias)) * float(out)
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_query_against_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    net = fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = queries.op4_quality(spark, TABLES).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.score == pytest.approx(by_hand(net, texts[r.doc_id]), abs=1e-4)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_whole_texts_teach_and_labels_are_settled(spark):
    """What makes a long text bad may stand anywhere in it; repeated ids and labels give the same network each time."""
    rng = random.Random(8)
    ids = [n for n in range(400) if zlib.crc32(str(n).encode()) % 4 != 2][:200]
    clean = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(300))
    rows = [(n, clean() + ("" if n % 2 else " " + "!" * 40), n % 2) for n in ids]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, y) for n, _, y in rows], "doc_id bigint, quality int")
    net = fit(docs, labels)
    assert np.mean([(net.score(t) >= 0.5) == bool(y) for _, t, y in rows]) > 0.95
    twice = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame([(ids[0], "zzz")], docs.schema))
    both = labels.unionByName(spark.createDataFrame([(ids[0], 1), (ids[1], 0)], labels.schema))
    a, b = (fit(twice.repartition(k), both.repartition(k)) for k in (2, 5))
    assert all(np.array_equal(x, y) for x, y in zip(a.weights(), b.weights(), strict=True))
    assert fit(docs, labels, longest=10).score("x") == ByteNet.fresh(16, 8, 8, 32, 7).score("x")
