import math
import random
import time
from itertools import combinations

from packloom.llm.licenses import TEMPLATES, align, find, with_licenses, words_of

LISTED = {name: tuple(words_of(t)) for name, t in TEMPLATES.items()}


def names(text, least=0.8):
    return [f[0] for f in find(text, LISTED, least)]


def test_align():
    assert align("a b c d".split(), "a b c d".split()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert align("x a y b z".split(), "a q b".split()) == [(1, 0), (3, 2)]
    # anchors first (p, q stand once in both), then the gap between them, where a is alone again
    assert align("a p a q a".split(), "p a q".split()) == [(1, 0), (2, 1), (3, 2)]
    pairs = align("one two three four five".split(), "four five one two three".split())
    assert [p[0] for p in pairs] == [0, 1, 2]  # the longer rising run wins


def test_templates_are_found_whole_and_edited():
    rng = random.Random(1)
    filler = " ".join(f"f{rng.randrange(500)}" for _ in range(300))
    for name, text in TEMPLATES.items():
        assert names(f"{filler}\n{text.upper()}\n{filler}") == [name]
        words = text.split()
        if len(words) > 20:
            broken = [w for n, w in enumerate(words) if n % 9]
            assert names(f"{filler} {' '.join(broken)} {filler}") == [name]
            assert names(" ".join(words[: len(words) // 2])) in ([], ["apache-2.0-notice"])


def test_repeats_and_overlaps():
    notice = TEMPLATES["mit-notice"]
    found = find(f"{notice} x y z {notice} w " * 2, LISTED, 0.8)
    assert [f[0] for f in found] == ["mit-notice"] * 4
    assert all(f[3] - f[2] == 5 and f[1] == 1 for f in found)
    assert names("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0-notice"]
    assert names("the license of the text is under version 2 of that") == []


def test_notices_that_miss_just_what_may_be_missing():
    for text in ("Licensed under the MIT License.", "Distributed under the MIT License."):
        assert [f[:2] for f in find(f"a b c {text} d e f", LISTED, 0.8)] == [("mit-notice", 0.8)]
    for length in range(5, 16):
        for least in (0.6, 0.7, 0.8, 0.9):
            template = tuple(f"t{n}" for n in range(length))
            need = math.ceil(least * length - 1e-9)
            for gone in combinations(range(length), min(3, length - need)):
                words = ["x", "y", *[w for n, w in enumerate(template) if n not in gone], "z"]
                pairs = align(words, template)
                assert len(pairs) >= need
                assert find(" ".join(words), {"one": template}, least) == [("one", len(pairs) / length, 2, len(words) - 1)]


def test_many_notices_and_interrupted_ones():
    notice = TEMPLATES["mit-notice"]
    started = time.monotonic()
    assert len(find(f"{notice} x " * 16_000, LISTED, 0.8)) == 16_000
    assert time.monotonic() - started < 15
    template = {"t": tuple(f"t{n}" for n in range(40))}
    for foreign, found in ((8, True), (200, False)):
        words = [f"t{n}" for n in range(20)] + [f"x{n}" for n in range(foreign)] + [f"t{n}" for n in range(20, 40)]
        assert bool(find(" ".join(words), template, 0.8)) == found
    assert find(" ".join(words), template, 0.8, slack_share=6)


def test_edges(spark, edge, nothing):
    rows = with_licenses(edge.selectExpr("*", "1 licenses"))
    assert rows.count() == edge.count() and all(r.licenses == [] for r in rows.collect())
    assert with_licenses(nothing).count() == 0
    one = spark.createDataFrame([(1, TEMPLATES["bsd-clause"])], "doc_id int, text string")
    assert with_licenses(one, {"none": " .", "b": TEMPLATES["bsd-clause"]}).first().licenses[0].license == "b"
