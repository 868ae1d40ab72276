import hashlib
from collections import defaultdict

from tests.llm.edges import EDGE_ROWS

from packloom.llm.exact_dedup import exact_dedup, filter_bits


def test_against_brute_force(spark):
    texts = [None if n % 50 == 0 else "" if n % 51 == 0 else f"text {n % 37 if n < 400 else n}" for n in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    groups = defaultdict(list)
    for n, text in enumerate(texts):
        groups[text or ""].append(n)
    for bits in (1 << 15, 1 << 20):  # with many false positives, with hardly any
        rows = exact_dedup(docs, max_filter_bits=bits).collect()
        assert len(rows) == len(texts)
        for r in rows:
            group = groups[r.text or ""]
            assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
            assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_edges(edge, nothing):
    rows = exact_dedup(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    twins = [r for r in rows if r.text and r.text.startswith("alpha")]
    assert {(r.keep_id, r.group_size) for r in twins} == {(2, 3)}
    assert sorted((r.doc_id, r.kept) for r in twins) == [(1, False), (2, False), (2, True)]
    empty = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows if not r.text}
    assert empty == {3: (4, 2, False), 4: (4, 2, True)}
    (alone,) = [r for r in rows if r.doc_id is None]
    assert (alone.keep_id, alone.group_size, alone.kept) == (None, 1, True)
    assert exact_dedup(nothing).count() == 0


def test_filter_is_bounded():
    assert filter_bits(0, 16, 1 << 28) == 1 << 15
    assert filter_bits(1 << 40, 16, 1 << 28) == 1 << 28
