"""Token ids of whole texts by a public tokenizer file, once per distinct word a task meets.

The tokenizer's pieces never span white space, so a text's ids are those of its words put together. Words of plain
Latin letters with closing punctuation are cut further into those two pieces, which go to the file's own model; every
other word goes through the whole tokenizer. This rests on the file's rules for normalising and splitting; a file with
other rules is told by them, and encodes whole texts. Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: words and pieces of words remembered by one worker; beyond, it starts afresh
WORDS_KEPT = 250_000
PIECES_KEPT = 600_000
#: bytes of a word or piece up to which it is remembered
WORD_BYTES_KEPT = 64
#: bytes of text whose distinct words are looked up together
SLICE_BYTES = 4 << 20
#: letters whose lower case and composed form are single code points
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: punctuation that forms one piece where it closes a word
CLOSING = b"-.,;:!?#$%&*()\"+=/"


#: The rules of a tokenizer file under which words may be encoded one by one.
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level model uses for each byte: printable ones stand for themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """UTF-8 word to the bytes of its ids, filled on demand."""

    def __init__(self, tokenizer_file: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_word = all(rules.get(name) == rule for name, rule in WORD_RULES.items())
        self.model = Tokenizer(self.whole.model)
        self.pieces: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def _piece(self, piece: bytes) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
            spelled = piece.decode("latin-1")
            if not piece.isascii():
                spelled = spelled.translate(self.letters)
            ids = _bytes(self.model.encode(spelled, add_special_tokens=False).ids)
            if len(piece) <= WORD_BYTES_KEPT:
                self.pieces[piece] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        """Ids of a whole text by the tokenizer itself."""
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        low = word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()
        stem = low.rstrip(CLOSING)
        if stem.isalpha() or LETTERS.fullmatch(stem.decode()):
            ids = self._piece(stem)
            if len(stem) < len(low):
                ids += self._piece(low[len(stem) :])
        else:
            ids = _bytes(self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(word) <= WORD_BYTES_KEPT:
            self[word] = ids
        return ids


@cache
def word_ids(tokenizer_file: str) -> WordIds:
    """One per worker process and file."""
    return WordIds(tokenizer_file)


def encode(words: WordIds, text: str | None, end_id: int) -> bytes:
    """The ids of a text (null: of an empty one), closed by ``end_id``."""
    if not words.by_word:
        return words.of_text(text or "") + _bytes([end_id])
    return b"".join(map(words.__getitem__, (text or "").encode("utf-8", "replace").split())) + _bytes([end_id])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``SLICE_BYTES`` together; a longer text stands alone."""
    sizes = np.asarray(pc.binary_length(texts))
    first, held = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield texts[first:n]
            first, held = n, 0
        held += size
    if first < len(texts):
        yield texts[first:]


def encode_all(words: WordIds, texts: pa.Array, end_id: int) -> Iterator[bytes]:
    """``encode`` of every text of an Arrow array, in order.

    The distinct words of a slice are looked up once; the slice's ids are then gathered word by word.
    """
    if not words.by_word:
        yield from (encode(words, text, end_id) for text in texts.to_pylist())
        return
    for part in _slices(pc.fill_null(texts, "")):
        split = pc.ascii_split_whitespace(part)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = [words[w] if w else b"" for w in distinct]
        ids = np.frombuffer(b"".join([*known, _bytes([end_id])]), "<u4")
        lengths = np.array([*map(len, known), 4], np.int64) // 4
        starts = np.cumsum(lengths) - lengths
        counts = np.asarray(pc.list_value_length(split)).astype(np.int64)
        order = np.insert(np.asarray(coded.indices), np.cumsum(counts), len(known))
        taken = lengths[order]
        ends = np.cumsum(taken)
        tokens = ids[np.repeat(starts[order] - (ends - taken), taken) + np.arange(ends[-1])]
        at = 0
        for end in ends[np.cumsum(counts + 1) - 1].tolist():
            yield tokens[at:end].tobytes()
            at = end
