import re
import subprocess
import sys
from collections import defaultdict

from packloom.llm.decontam import FOREIGN, Letters, find_benchmark, judged, original_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"q{n}" for n in range(20))


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute(text, items):
    words, hit, found = WORD.findall(low(text or "")), set(), set()
    windows = defaultdict(set)
    for item, body in items:
        w = WORD.findall(low(body or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(item)
    for window, having in windows.items():
        n = len(window)
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) == window:
                hit |= set(range(k, k + n))
                found |= {str(item) for item in having if item is not None}
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


ITEMS = [(1, LONG), (2, "q3 q4"), (10, "Über straße!"), (3, None), (4, " .,; "), (5, LONG.upper()), (2, "q3 q4"), (6, "x x x"), (None, "n1 n2 n3"), (None, "Über straße")]
TEXTS = [
    f"before {LONG} after",
    "Q0-q1/q2 q3, q4? q5 q6 q7 q8 q9 q10 q11\nq12 q13 end",
    "q3 q4 q3 q4q3 q4" + " filler" * 100,
    "ÜBER über straße q3\x00q4",
    "x x x x x",
    "q1 q2",
    "",
    None,
    "!!",
    "a n1 n2 n3 b",
    "n1 n2",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    for block_bytes in (1 << 20, 40):  # one block, several
        got = judged(find_benchmark(docs, bench, block_bytes=block_bytes)).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == brute(TEXTS[r.doc_id], ITEMS)


def test_original_spans(spark):
    text = "é! Über--Straße, q3 (Q4)."
    docs = spark.createDataFrame([(0, text)], "doc_id int, text string")
    (row,) = find_benchmark(docs, spark.createDataFrame(ITEMS, "item_id int, text string")).collect()
    spans = original_spans(text, [(h.start, h.end, h["item"]) for h in row.hits])
    assert sorted((text[a:b], item) for a, b, item in spans) == [("q3 (Q4", "2"), ("Über--Straße", "10")]


def test_memory_of_a_large_block():
    """A whole block of benchmark text stays within 500 MB of a worker."""
    code = (
        "import random, resource; from packloom.llm.decontam import BLOCK_BYTES, Machine; r = random.Random(1); "
        "word = lambda: ''.join(r.choices('etaoinshrdlu', k=r.randint(2, 9))); "
        "texts = [' '.join(word() for _ in range(2000)) for _ in range(BLOCK_BYTES // 13000)]; "
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m = Machine(list(enumerate(texts))); "
        "print(sum(map(len, texts)), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    size, used = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, text=True).stdout.split())
    assert size > 1_800_000 and used < 500


def test_words_beyond_the_surrogates():
    letters = Letters()
    spelled = "".join(letters.add(str(n).encode()) for n in range(70_000))
    assert len(spelled) == len(set(spelled)) == 70_000 and spelled.encode("utf-8")
    assert letters.spell([b"5", b"none"]) == spelled[5] + FOREIGN


def test_edges(spark, edge, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    rows = judged(find_benchmark(edge.selectExpr("*", "1 hits", "2 n_words"), bench))
    assert rows.count() == edge.count() and not rows.where("contaminated").count()
    assert find_benchmark(nothing, bench).count() == 0
    none = judged(find_benchmark(edge, bench.limit(0))).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none)
