import random
from collections import defaultdict

import numpy as np

from packloom.llm import near_dedup as N
from packloom.llm.components import connected


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def edited(rng, base, share):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in base]


def brute(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    for group in range(6):  # bases with near copies around the limit, chains, exact copies
        base = words(rng, 60 + 40 * group)
        for _ in range(25):
            texts[n] = " ".join(edited(rng, base, rng.choice([0, 0.005, 0.012, 0.02, 0.03])))
            n += 1
    link = words(rng, 200)
    for k in range(12):  # each is near the one before, the ends are far apart
        link = link[:200 - 3] + words(rng, 3) if k % 2 else words(rng, 3) + link[3:]
        texts[n] = " ".join(link)
        n += 1
    for k in range(40):  # unrelated texts that share a passage
        texts[n] = " ".join(words(rng, 30) + ["shared", "passage", "of", "many", "texts", "all", "alike"] + words(rng, 30))
        n += 1
    for t in (None, "", " \t", "one", "ONE", "a b c d", "A b\nc D", "a b c d e", "a b c d f"):
        texts[n] = t
        n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    want = brute(texts)
    got = {r.id: r for r in N.near_dedup(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.id == r.component_id) for r in got.values())


def test_large_buckets_by_prefix(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 150)
    texts = {n: " ".join(edited(rng, base, 0.02)) for n in range(70)}
    twin = edited(rng, base, 0.05)  # far from the others, but near each other
    texts |= {70 + n: " ".join(edited(rng, twin, 0.004)) for n in range(5)}
    monkeypatch.setattr(N, "FEW", 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in N.near_dedup(docs).collect()}
    assert got == brute(texts)


def test_signature():
    rng = np.random.default_rng(2)
    (one,) = [N.signature(np.array([7], np.uint64), 50)]
    assert sorted(np.floor(one)) == list(range(50))  # one element reaches every place, each at a level of its own
    for size in (5, 80, 2000):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, size, dtype=np.uint64)
            a = np.concatenate([both, rng.integers(0, 2**63, size // 4 + 1, dtype=np.uint64)])
            share = len(both) / len(a)
            errors.append((N.signature(a, 128) == N.signature(both, 128)).mean() - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05


def test_edges(edge, nothing):
    rows = N.near_dedup(edge).collect()
    assert len(rows) == edge.count()
    by = defaultdict(list)
    for r in rows:
        by[r.id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(2, 1, True)] and by[2] == [(2, 1, False)] * 2
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[None] == [(1, None, True)] and by[8] == [(1, 8, True)]
    assert N.near_dedup(nothing).count() == 0


def test_connected(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(0, 40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame([*links, (None, 3), (7, 7)], "a int, b int")).collect()}
    parent = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in range(100):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
