"""From a text corpus to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions.index import key_bounds
from packloom.functions.staging import stage
from packloom.operators.tokens import encode, label_shift, lay_out, pack, range_starts


def encode_corpus(
    docs: DataFrame, vocab: DataFrame, key: str, vocab_size: int, bos_id: int | None = None
) -> DataFrame:
    """Encode ``(key, domain, split, text)`` and store the result, which the layout and the packing both read.

    Documents without text stay, as empty arrays: they count in the index that decides the shards. ``digest`` orders
    documents that share a key.
    """
    encoded = encode(docs, vocab, vocab_size, bos_id=bos_id).select(key, "domain", "split", "ids")
    return stage(encoded.withColumns({"n_tokens": F.size("ids"), "digest": F.xxhash64("ids")}), "encoded")


def document_layout(encoded: DataFrame, key: str, world_size: int, seq_len: int, *carried: str) -> DataFrame:
    """``(key, domain, split, n_tokens, index, rank, offset, first_seq)`` and the carried columns of each document."""
    order = [key, "n_tokens", "digest"]
    bounds = key_bounds(encoded, order)
    narrow = encoded.select(*order, "domain", "split")
    starts = range_starts(narrow, order, bounds, world_size, seq_len)
    return lay_out(encoded.select(*order, "domain", "split", *carried), starts, order, bounds, world_size)


def pack_corpus(encoded: DataFrame, key: str, seq_len: int, world_size: int) -> DataFrame:
    """Packed rows ``(domain, split, rank, chunk, seq_id, input_ids, label)`` of an encoded corpus."""
    return label_shift(pack(document_layout(encoded, key, world_size, seq_len, "ids"), seq_len), seq_len)
