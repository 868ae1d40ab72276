import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packloom.functions.staging import fresh_path
from packloom.llm import packing, token_ids, token_store
from tests.llm.edges import EDGE_ROWS

FILE = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(FILE)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stredlv.,!<|>\x1c\x85\xa0éÉßẞİK")), max_size=60))
def test_words_put_together_are_the_whole(text):
    assert np.frombuffer(token_ids.encode(token_ids.word_ids(FILE), text, 1), "<u4").tolist() == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab,.é \t\n\x0b\x0c\r\x1c\x85\xa0'1"), max_size=30)), max_size=8), st.integers(1, 40))
def test_slices_equal_single_texts(texts, size):
    words = token_ids.word_ids(FILE)
    token_ids.SLICE_BYTES, before = size, token_ids.SLICE_BYTES
    got = list(token_ids.encode_all(words, pa.array(texts, pa.string()), 1))
    token_ids.SLICE_BYTES = before
    assert got == [token_ids.encode(words, t, 1) for t in texts]


def test_a_file_with_other_rules_encodes_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    words, whole = token_ids.WordIds(other), Tokenizer.from_file(other)
    assert token_ids.word_ids(FILE).by_word and not words.by_word
    texts = ["Hello  World, it's\nme", "", None, " lead and trail ", "Straße 12"]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    got = list(token_ids.encode_all(words, pa.array(texts, pa.string()), 1))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def test_long_words_are_not_remembered():
    words = token_ids.WordIds(FILE)
    text = "a" * 500 + " " + "é" * 400 + " b"
    assert np.frombuffer(token_ids.encode(words, text, 1), "<u4").tolist() == ids_of(text)
    assert set(words) == {b"b"} and max(map(len, words.pieces)) <= 64


def test_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(token_ids, "WORDS_KEPT", 3)
    text = "the cat sat on the mat, the cat sat"
    assert np.frombuffer(token_ids.encode(token_ids.WordIds(FILE), text, 1), "<u4").tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=1024))
def test_block_round_trip(values):
    v = np.array(values, np.uint32)
    (block,) = token_store.pack_blocks(v, len(v))
    assert np.array_equal(token_store.unpack_blocks(block, np.array([0]), len(v), len(v)), v)


def test_outliers_do_not_widen_a_block():
    v = np.arange(1024, dtype=np.uint32) % 16
    v[[3, 700]] = 2**31
    assert len(token_store.pack_blocks(v)[0]) < 1024 // 2 + 40


def test_segment_round_trip():
    rng = np.random.default_rng(0)
    tokens = [rng.integers(0, 49408, n).astype("<u4").tobytes() for n in (1, 5000, 2, 1023)]
    ids, counts, values = token_store.unpack_segment(token_store.pack_segment([None, -5, 7, 7], tokens))
    assert ids == [None, -5, 7, 7] and counts.tolist() == [1, 5000, 2, 1023] and values.tobytes() == b"".join(tokens)
    with pytest.raises(ValueError):
        token_store.unpack_segment(b"x" * 40)


def test_store(spark, edge, nothing, monkeypatch):
    for docs in (edge, edge.repartition(3)):
        path = fresh_path(spark, "tokens")
        token_store.write_tokens(docs, path, FILE)
        rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
        assert [r.id for r in rows] == sorted((r[0] for r in EDGE_ROWS), key=lambda i: (i is not None, i))
        texts = defaultdict(list)
        for r in EDGE_ROWS:
            texts[r[0]].append(ids_of(r[1]))
        at = 0
        for r in rows:
            assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() in texts[r.id]
            at += r.n_tokens
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(nothing, path, FILE)
    assert token_store.read_tokens(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), min_size=1, max_size=200), st.integers(1, 20))
def test_packer_keeps_every_token(sizes, max_open):
    packer = packing.Packer(32, max_open)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in sizes]
    for d, ids in enumerate(docs):
        packer.add(d, ids)
    packer.finish()
    seen = defaultdict(list)
    fills = []
    for window in packer.done:
        fills.append(sum(len(p[3]) // 4 for p in window))
        for doc, start, total, ids in window:
            assert total == sizes[doc] and ids
            seen[doc].append((start, ids))
    for d, ids in enumerate(docs):
        assert b"".join(x for _, x in sorted(seen[d])) == ids
    assert all(f == 32 or f in (1, 2, 4, 8, 16) for f in fills) and sum(f != 32 for f in fills) <= 5


def test_level_rule():
    packer = packing.Packer(10)
    for d, n in enumerate([6, 6, 4]):
        packer.add(d, bytes(4 * n))
    assert len(packer.done) == 1  # the 4 closes one of the two equal windows
    for level in range(1, 10):
        counts = packer.levels.copy()

        def squares(change, counts=counts):
            c = counts.copy()
            for at, by in change:
                c[at] += by
            return int((c[1:10] ** 2).sum())

        best = min([squares([(level, 1)])] + [squares([(f, -1), (f + level, 1)]) for f in range(1, 11 - level) if counts[f]])
        chosen = packer._level_for(level)
        assert squares([(level, 1)] if not chosen else [(chosen, -1), (chosen + level, 1)]) == best


def test_packing(spark, edge, nothing):
    rows = packing.pack_documents(edge.repartition(3), FILE, 64).collect()
    want = defaultdict(list)
    for r in EDGE_ROWS:
        want[r[0]].append(ids_of(r[1]))
    fills = defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in want[r.id]}
        assert r.doc_tokens == len(want[r.id][0])
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    assert sorted(fills) == list(range(len(fills)))
    for pieces in fills.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or (at < 64 and at & (at - 1) == 0)
    assert packing.pack_documents(nothing, FILE, 64).count() == 0
