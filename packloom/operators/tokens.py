"""Token operators: vocabulary, encoding, packing into fixed-length next-token sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.batches import bound_batches
from packloom.functions.index import RANGE, Bounds, join_null_safe, range_of, running_total
from packloom.functions.numeric import whole_div
from packloom.functions.staging import stage

DOMAIN = ("domain", "split")
RANK = ("domain", "split", "rank")
#: a vocabulary up to this size is looked up in place by every task; a larger one is joined
VOCAB_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.array_remove(F.split(text, "[ \\t\\n\\r]+"), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words`` of a whole Arrow batch: all words in a row, and where each text's begin in it; a null text has none.

    Arrow's own split also cuts at vertical tabs and form feeds, so a batch that has one is split by the pattern.
    """
    if pc.any(pc.match_substring_regex(texts, "[\v\f]")).as_py():
        found = pc.split_pattern_regex(texts, "[ \\t\\n\\r]+")
    else:
        found = pc.ascii_split_whitespace(texts)
    filled = pc.not_equal(found.values, "")
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return before[found.offsets.to_numpy()], found.values.filter(filled)


def count_words(df: DataFrame) -> DataFrame:
    """``(token, n)``: a row per Arrow batch and distinct word of ``text``."""
    bound_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = pc.value_counts(split_words(batch.column(0))[1]).flatten()
            yield pa.RecordBatch.from_arrays([token.cast(pa.string()), n], ["token", "n"])

    return df.select(F.make_valid_utf8("text")).mapInArrow(work, "token string, n bigint")


def build_vocab(df: DataFrame, size: int, specials: Sequence[str] = ("<unk>",)) -> DataFrame:
    """``(token, id, n)``: the specials, then the ``size`` most frequent words; ties in token order.

    Counting combines in every Arrow batch and on the map side, so a word that fills a third of the corpus costs one row
    per task. The counts' own histogram says at which count the vocabulary ends: words above it are all in, and those at
    it fill up in token order. Only the words of the vocabulary meet in one task, to be numbered.
    """
    named = count_words(df).where(~F.col("token").isin(list(specials)))
    counted = named.groupBy("token").agg(F.sum("n").alias("n"))
    return numbered_words(stage(counted, "word-counts"), size, specials)


def numbered_words(counted: DataFrame, size: int, specials: Sequence[str]) -> DataFrame:
    """``(token, id, n)``: the specials, then the ``size`` most frequent of stored ``counted (token, n)``, ties in token order."""
    above = F.sum("words").over(Window.orderBy(F.desc("n"))) - F.col("words")
    kinds = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", above)
    last = kinds.where(F.col("above") < size).agg(F.min_by(F.struct("n", "above"), "n").alias("last")).first()["last"]
    cut, room = (last["n"], size - last["above"]) if last else (0, 0)
    at_cut = counted.where(F.col("n") == cut).orderBy("token").limit(room)
    top = counted.where(F.col("n") > cut).unionByName(at_cut)
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))) + F.lit(len(specials) - 1)
    ranked = top.select("token", place.cast("int").alias("id"), "n")
    reserved = counted.sparkSession.createDataFrame(
        [(token, i, 0) for i, token in enumerate(specials)], "token string, id int, n bigint"
    )
    return reserved.unionByName(ranked)


def _lookup(known: Broadcast, unk_id: int):
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, numbers = known.value
        for texts in batches:
            starts, found = split_words(texts)
            places = pc.index_in(found, value_set=tokens.cast(found.type))
            yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), numbers.take(places).fill_null(unk_id))

    return ids


def _ids_in_place(df: DataFrame, vocab: DataFrame, unk_id: int) -> DataFrame:
    """``__ids``: whole Arrow batches of words looked up in the broadcast vocabulary; nothing is exchanged."""
    spark = df.sparkSession
    bound_batches(spark)
    table = vocab.select("token", F.col("id").cast("int")).toArrow().combine_chunks()
    arrays = [pa.array(table.column(c).to_pylist(), kind) for c, kind in enumerate((pa.string(), pa.int32()))]
    return df.withColumn("__ids", _lookup(spark.sparkContext.broadcast(arrays), unk_id)(F.make_valid_utf8("text")))


def _ids_by_join(df: DataFrame, vocab: DataFrame, unk_id: int) -> DataFrame:
    """``__ids``: words become rows and meet the vocabulary in a join; rows are staged, so that their numbers hold."""
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "numbered-texts")
    each = rows.select("__row", F.posexplode(words(F.col("text"))).alias("__pos", "__word"))
    known = vocab.select(F.col("token").alias("__word"), F.col("id").alias("__id"))
    entry = F.struct(F.col("__pos"), F.coalesce("__id", F.lit(unk_id)).alias("__id"))
    found = each.join(known, "__word", "left").groupBy("__row").agg(F.sort_array(F.collect_list(entry))["__id"].alias("__ids"))
    joined = rows.join(found, "__row", "left").drop("__row")
    return joined.withColumn("__ids", F.coalesce("__ids", F.array().cast("array<int>")))


def encode(
    df: DataFrame, vocab: DataFrame, vocab_size: int, unk_id: int = 0, bos_id: int | None = None, in_place: int = VOCAB_BYTES
) -> DataFrame:
    """Adds ``ids ARRAY<INT>`` for ``text``; unknown words become ``unk_id``; empty text gives no tokens at all.

    A vocabulary of up to ``in_place`` bytes is looked up where the texts lie: no token becomes a row and neither text nor
    tokens are exchanged. Beyond that words are rows of a join. ``vocab_size`` is the number of ids that there are. The
    vocabulary is staged first, so whatever gave it runs once.
    """
    known = stage(vocab.select("token", "id"), "vocabulary")
    size = known.agg(F.sum(F.octet_length("token") + F.lit(32)).alias("bytes")).first()["bytes"] or 0
    found = _ids_in_place(df, known, unk_id) if size <= in_place else _ids_by_join(df, known, unk_id)
    ids = F.col("__ids")
    if bos_id is not None:
        ids = F.concat(F.array(F.lit(bos_id)), ids)
    none = F.array().cast("array<int>")
    return found.withColumn("ids", F.when(F.col("text").isNull() | (F.col("text") == ""), none).otherwise(ids)).drop("__ids")


def token_offsets(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = RANK, size: str = "n_tokens", bounds: Bounds | None = None
) -> DataFrame:
    """Adds ``offset``: where a document starts in its rank's token stream."""
    return running_total(df, F.col(size), order, by, "offset", bounds)


def _placed(df: DataFrame, order: Sequence[str], bounds: Bounds, *first: str) -> DataFrame:
    """``df`` exchanged by key range, with its dense ``__place`` inside range and domain; ``first`` sorts before it."""
    ranged = df.withColumn(RANGE, F.coalesce(F.col(RANGE), range_of(df, order, bounds)) if RANGE in df.columns else range_of(df, order, bounds))
    in_range = Window.partitionBy(RANGE, *DOMAIN).orderBy(*first, *order)
    return in_ranges(ranged, len(bounds) + 1).withColumn("__place", F.row_number().over(in_range).cast("bigint") - 1)


def in_ranges(ranged: DataFrame, ranges: int) -> DataFrame:
    """Rows exchanged so that each task holds exactly one key range."""
    return ranged.repartitionById(ranges, F.col(RANGE))


def range_starts(
    df: DataFrame,
    order: Sequence[str],
    bounds: Bounds,
    world_size: int,
    seq_len: int,
    docs_before: DataFrame | None = None,
    tokens_before: DataFrame | None = None,
) -> DataFrame:
    """What lies before each key range: one row per range and domain, whatever the number of documents.

    ``first`` is the index of its first document; entry q of ``starts`` belongs to the rank of its documents whose
    place leaves q when divided by ``world_size``: that rank's tokens before the range, and its first ``seq_id``. Where
    ``df`` continues a corpus, ``docs_before (domain, split, docs)`` and ``tokens_before (domain, split, rank, tokens)``
    tell what it already has.
    """
    turn = F.col("__place") % F.lit(world_size)
    sums = (
        _placed(df, order, bounds)
        .groupBy(RANGE, *DOMAIN, turn.alias("turn"))
        .agg(F.count("*").alias("docs"), F.sum("n_tokens").cast("bigint").alias("tokens"))
    )
    earlier = Window.partitionBy(*DOMAIN).orderBy(RANGE).rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    numbered = sums.withColumn("first", F.coalesce(F.sum("docs").over(earlier), zero))
    if docs_before is not None:
        had = docs_before.select(*DOMAIN, F.col("docs").alias("__had"))
        numbered = join_null_safe(numbered, had, DOMAIN).withColumn("first", F.col("first") + F.coalesce("__had", zero)).drop("__had")
    numbered = numbered.withColumn("rank", F.pmod(F.col("first") + F.col("turn"), F.lit(world_size)).cast("int"))
    of_rank = Window.partitionBy(*RANK).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("start", F.coalesce(F.sum("tokens").over(of_rank), zero))
    if tokens_before is not None:
        had = tokens_before.select(*RANK, F.col("tokens").alias("__had"))
        numbered = join_null_safe(numbered, had, RANK).withColumn("start", F.col("start") + F.coalesce("__had", zero)).drop("__had")
    chunks = F.greatest(zero, whole_div(F.max(F.col("start") + F.col("tokens")) - 1, F.lit(seq_len)))
    ranks = numbered.groupBy(*RANK).agg(chunks.alias("chunks"))
    before = Window.partitionBy(*DOMAIN).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.withColumn("first_seq", F.coalesce(F.sum("chunks").over(before), zero)).drop("chunks")
    entry = F.struct("turn", "start", "first_seq")
    return (
        join_null_safe(numbered, ranks, RANK, "inner")
        .groupBy(RANGE, *DOMAIN)
        .agg(F.max("first").alias("first"), F.sort_array(F.collect_list(entry)).alias("starts"))
    )


def lay_out(
    df: DataFrame, starts: DataFrame, order: Sequence[str], bounds: Bounds, world_size: int
) -> DataFrame:
    """Adds ``index``, ``rank``, ``offset`` and ``first_seq`` to documents; they stay partitioned by key range.

    ``starts`` comes from ``range_starts`` over the same documents. Its rows travel in the same exchange as the
    documents and stand first in their range, so there is no join and repeated keys do no harm.
    """
    marked = df.withColumn("__doc", F.lit(True)).withColumn(RANGE, range_of(df, order, bounds))
    both = marked.unionByName(starts.withColumn("__doc", F.lit(False)), allowMissingColumns=True)
    placed = _placed(both, order, bounds, "__doc")
    so_far = Window.partitionBy(RANGE, *DOMAIN).orderBy("__doc", *order)
    known = placed.withColumns({"first": F.max("first").over(so_far), "starts": F.max("starts").over(so_far)})
    docs = known.where("__doc").withColumn("__place", F.col("__place") - 1)
    turn = (F.col("__place") % F.lit(world_size)).cast("int")
    docs = docs.withColumns({"__turn": turn, "index": F.col("first") + F.col("__place")})
    inside = Window.partitionBy(RANGE, *DOMAIN, "__turn").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.get("starts", F.col("__turn"))
    offset = entry["start"] + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0).cast("bigint"))
    return docs.withColumns(
        {"rank": F.pmod("index", F.lit(world_size)).cast("int"), "offset": offset, "first_seq": entry["first_seq"]}
    ).drop("__doc", "__place", "__turn", "first", "starts")


def windows(laid_out: DataFrame, seq_len: int, tails: DataFrame | None = None) -> DataFrame:
    """Every window of ``seq_len + 1`` tokens, overlapping by one, that the documents' tokens fall into.

    Gives ``(first_seq, domain, split, rank, chunk, n, tokens)``; only a rank's last window has fewer than
    ``seq_len + 1`` tokens, and one that holds more raises an error. ``laid_out`` is ``lay_out``'s result with ``ids``.
    Windows inside a key range are put together where they lie; only the pieces of windows across ranges, at most two
    per range and rank, travel on. ``tails (domain, split, rank, chunk, tokens)`` are pieces left over from before, each
    at the beginning of its window.
    """
    length = F.lit(seq_len).cast("bigint")
    start, size = F.col("offset"), F.size("ids").cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), whole_div(start - 1, length))
    last = whole_div(start + size - 1, length)

    chunk = F.col("chunk")
    low = F.greatest(start, chunk * length)
    high = F.least(start + size, chunk * length + length + 1)
    cut = F.slice("ids", (low - start + 1).cast("int"), (high - low).cast("int"))
    window = ["first_seq", *RANK, "chunk"]
    pieces = (
        laid_out.where(F.size("ids") > 0)
        .select(RANGE, "first_seq", *RANK, "ids", "offset", F.explode(F.sequence(first, last)).alias("chunk"))
        .select(RANGE, *window, low.alias("low"), cut.alias("cut"))
    )
    near = pieces.groupBy(RANGE, *window).agg(
        F.sort_array(F.collect_list(F.struct("low", "cut"))).alias("cuts"), F.sum(F.size("cut")).alias("n")
    )
    whole = near.where(F.col("n") == seq_len + 1).select(*window, "cuts", "n")
    parts = near.where(F.col("n") != seq_len + 1).select(*window, "cuts", "n")
    if tails is not None:
        piece = F.struct((chunk * length).alias("low"), F.col("tokens").alias("cut"))
        no_seq = F.lit(0).cast("bigint").alias("first_seq")
        held = tails.where(F.size("tokens") > 0)
        parts = parts.unionByName(held.select(no_seq, *RANK, "chunk", F.array(piece).alias("cuts"), F.size("tokens").cast("bigint").alias("n")))
    joined = parts.groupBy(*window).agg(F.sort_array(F.flatten(F.collect_list("cuts"))).alias("cuts"), F.sum("n").alias("n"))
    too_long = F.raise_error(F.lit("a window holds more tokens than fit")).cast("bigint")
    every = whole.unionByName(joined.withColumn("n", F.when(F.col("n") > seq_len + 1, too_long).otherwise(F.col("n"))))
    return every.select(*window, "n", F.flatten(F.col("cuts.cut")).alias("tokens"))


def pack(laid_out: DataFrame, seq_len: int) -> DataFrame:
    """Cut every rank's token stream into windows of ``seq_len + 1`` tokens that overlap by one.

    Gives ``(domain, split, rank, chunk, seq_id, tokens)``. A last window without its look-ahead token is dropped, so N
    tokens give ``(N - 1) div seq_len`` windows.
    """
    full = windows(laid_out, seq_len).where(F.col("n") == seq_len + 1)
    return full.select(*RANK, "chunk", (F.col("first_seq") + F.col("chunk")).alias("seq_id"), "tokens")


def label_shift(packed: DataFrame, seq_len: int) -> DataFrame:
    """``input_ids`` are the first ``seq_len`` tokens, ``label`` the ones after each of them."""
    return (
        packed.withColumn("input_ids", F.slice("tokens", 1, seq_len))
        .withColumn("label", F.slice("tokens", 2, seq_len))
        .drop("tokens")
    )


def training_pairs(df: DataFrame, *keep: str) -> DataFrame:
    """One row per position: ``pos``, the two tokens before (``ctx2``, ``ctx1``) and the label ``tok``."""
    nothing = F.array(F.lit(None).cast("int"))
    earlier = F.concat(nothing, F.slice("input_ids", F.lit(1), F.size("input_ids") - 1))
    rows = F.arrays_zip(earlier.alias("ctx2"), F.col("input_ids").alias("ctx1"), F.col("label").alias("tok"))
    return df.select(*keep, F.posexplode(rows).alias("pos", "row")).select(*keep, "pos", "row.*")


def corpus_token_stats(df: DataFrame, by: Sequence[str] = RANK) -> DataFrame:
    """Sequences and label tokens per group of packed rows."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_sequences"), F.sum(F.size("label").cast("bigint")).alias("n_tokens")
    )
