"""Secrets in texts by a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. The index holds, for every trigram that some rule asks
for, the documents whose lower-cased text contains it; postings are intersected per clause and united per rule. Rules
run their expression only on their candidates; a rule without a mandatory trigram runs on every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.staging import stage
from packloom.llm.grams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and Python; ``group`` of ``least`` or more code points makes a match count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The expressions of the base kinds. For hex and access the length stands in the expression, because
#: both match whole runs of one character class.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


def postings(docs: DataFrame, trigrams: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """``(trigram, id)``: the inverted index of the given trigrams over lower-cased texts."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    found = F.filter(F.array(*[F.lit(g) for g in trigrams]), lambda g: F.contains(F.col("low"), g))
    return low.select("id", F.explode(found).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``(id, kinds)``: for every document, the rules whose Boolean query its postings satisfy."""
    listed = [(kind, n, gram, len(clause)) for kind, q in queries.items() for n, clause in enumerate(q) for gram in sorted(clause)]
    clauses = index.sparkSession.createDataFrame(listed, "kind string, clause int, trigram string, wanted int")
    met = (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("id", "kind", "clause", "wanted")
        .agg(F.count("*").alias("n"))
        .where("n = wanted")
    )
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """Array of ``(start, kind, end)`` in code points; the leftmost non-overlapping matches that are long enough.

    The pieces between matches give the positions: a match starts after all earlier pieces and matches.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), F.length(m).alias("take")))
    if rule.group:
        part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        lengths = F.zip_with(lengths, part, lambda s, p: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(p).alias("take")))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,take:int>>")
    walked = F.aggregate(
        F.filter(lengths, lambda s: s["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("seen")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.concat(
                acc["seen"],
                F.array(
                    F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end"), s["take"].alias("take"))
                ),
            ).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )
    kept = F.filter(walked, lambda s: s["take"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``secrets``: an array of ``(start, kind, end)`` by start, then by order of the rules.

    Starts and ends count code points, the end is exclusive. Null texts count as empty and have no secrets. Ids may
    be null or repeated: every row is judged by its own text. An empty table stays empty; a column of ``docs`` named
    ``secrets`` is replaced. Candidates are staged, so that the planner knows their size when it joins them.
    """
    docs = docs.drop("secrets")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: q for kind, q in queries.items() if q is not None}
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.withColumn("__kinds", F.array().cast("array<string>"))
    if asked:
        grams = sorted(set().union(*[c for q in asked.values() for c in q]))
        chosen = stage(candidates(postings(docs, grams, id_col, text_col), asked), "secret-candidates")
        chosen = chosen.select(F.col("id").alias("__id"), F.col("kinds").alias("__kinds"))
        joined = docs.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:string,end:int>>")
    found = []
    for rule in rules:
        wanted = F.rlike(text, F.lit(rule.pattern))
        if rule.kind in asked:
            wanted = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)) & wanted
        found.append(F.when(wanted, _spans(text, rule)).otherwise(none))
    order = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    ranked = F.array_sort(
        F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end")))
    )
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["rank"]).alias("kind"), s["end"].alias("end")))
    return joined.select(*[docs[c] for c in docs.columns], named.alias("secrets"))


def spans_text(secrets: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    if kinds is not None:
        secrets = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(secrets: Column, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("bigint")
