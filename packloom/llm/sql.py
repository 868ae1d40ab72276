"""DuckDB twins of the registered queries, where SQL can express them.

Not expressible: the trained network (op4), alignment (op5), the tokenizer (op6, op8), page parsing (op7) and
cross-parsing (op11); those are tested against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Sequence

from packloom.llm import queries as Q
from packloom.llm.decontam import WINDOW
from packloom.llm.secrets import BASE_RULES, RULES, Rule
from packloom.llm.sharding import Leaf, even_tree

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans(rule: Rule, rank: int) -> str:
    """One row per match that counts; pieces between matches give the positions."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS place, '{rule.kind}' AS kind, starts[i] AS s, starts[i] + length(hits[i]) AS e
  FROM (
    SELECT doc_id, hits, counted, unnest(range(1, len(hits) + 1)) AS i,
           list_transform(range(1, len(hits) + 1), lambda k:
             list_sum(list_transform(gaps[1:k], lambda g: length(g)))
             + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0)) AS starts
    FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps,
                 regexp_extract_all(text, '{pattern}') AS hits,
                 regexp_extract_all(text, '{pattern}', {rule.group}) AS counted
          FROM documents WHERE regexp_matches(text, '{pattern}'))
  ) WHERE length(counted[i]) >= {rule.least}"""


def _secrets() -> str:
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    shown = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""
WITH spans AS ({" UNION ALL ".join(_spans(r, n) for n, r in enumerate(RULES))})
SELECT doc_id, {counts},
       sha256(coalesce(string_agg({shown}, ',' ORDER BY s, place) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg({shown}, ',' ORDER BY s, place), '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


NEAR = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex({LOW}, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '') AS ws FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM worded WHERE len(ws) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
),
reach(a, b) AS (
  SELECT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b
),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""

ITEM_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CONTAMINATED = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOW}, '{ITEM_WORDS}') AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOW}, '{ITEM_WORDS}') AS ws FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least({WINDOW}, len(ws)) AS n, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i FROM items WHERE len(ws) > 0)
),
found AS MATERIALIZED (
  SELECT d.doc_id, d.i, d.n, w.item
  FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
              FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows))) d
  JOIN windows w ON w.n = d.n AND w.w = d.w
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
had AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(had.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * hit.n >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN had USING (doc_id)"""


def _digits(name: str, count: int) -> str:
    return f"('0x' || substr(md5('{name}|' || coalesce(doc_id::VARCHAR, '')), 1, {count}))::BIGINT"


def _choose(children: Sequence[tuple[str, float, str]]) -> str:
    if len(children) == 1:
        return children[0][2]
    draws = [f"(-ln(({_digits(name, 13)} + 0.5::DOUBLE) / {float(1 << 52)}) / {weight})" for name, weight, _ in children]
    cases = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {value}" for d, (_, _, value) in zip(draws, children, strict=True))
    return f"CASE {cases} END"


def _shard(tree: Sequence[Leaf]) -> str:
    regions: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in tree:
        regions.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
    top = []
    for region, racks in regions.items():
        level = [
            (f"{region}/{rack}", sum(w for _, w in leaves), _choose([(f"{region}/{rack}/{s}", w, str(s)) for s, w in leaves]))
            for rack, leaves in racks.items()
        ]
        top.append((region, sum(w for _, w, _ in level), _choose(level)))
    return _choose(top)


#: the digest's table comes from its rule: eight steps per byte value
CRC = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS crc
),
digests AS MATERIALIZED (
  SELECT doc_id, text, xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
                                                           lambda h: ('0x' || h)::BIGINT)),
           lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32
  FROM documents, crc_table
)"""

SHARDED = f"""
WITH {CRC},
placed AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, text_crc32, {_digits("slot", 8)} % 1024 AS part,
         {_shard(even_tree(Q.SHARDS))} AS shard, {_shard(even_tree(Q.SHARDS + 1))} AS grown_shard
  FROM digests
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot,
       grown_shard::INT AS grown_shard
FROM placed"""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

SEARCH_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
RANKED = f"""
WITH terms AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({LOW}, '{SEARCH_TERMS}')) AS t FROM documents),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOW}, '{SEARCH_TERMS}')) AS t FROM benchmark),
held AS MATERIALIZED (
  SELECT t, doc_id, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM asked) GROUP BY t, doc_id
),
weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM held GROUP BY t), totals
),
impacts AS MATERIALIZED (
  SELECT t, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS part
  FROM held JOIN weights USING (t) JOIN sizes USING (doc_id), totals
),
scored AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN impacts USING (t) GROUP BY item_id, doc_id
),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, place::INT AS rank, doc_id, score FROM placed WHERE place <= 50"""

PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
worded AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces
),
totals AS MATERIALIZED (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
counts AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
        FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
              FROM worded CROSS JOIN (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size))
  GROUP BY lang, size, phrase HAVING count(*) >= 100
),
parts AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1),
inner_phrases AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, ws, a, m, unnest(range(1, size - m + 2)) AS i
        FROM (SELECT lang, ws, a, size, unnest(range(2, size)) AS m FROM parts WHERE size > 2))
),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM (SELECT lang, phrase, size, a, ws, unnest(range(1, size)) AS k FROM parts)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n,
         ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.lp
       JOIN counts r ON r.lang = c.lang AND r.phrase = c.rp JOIN totals t ON t.lang = c.lang
),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inner_phrases i ON i.lang = w.lang AND i.phrase = w.phrase AND i.a >= w.a
  WHERE nth = 1 AND i.phrase IS NULL
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM kept
)
SELECT lang, place AS rank, phrase, a, l, r, n, score FROM placed WHERE place <= 2000"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op2_near_dedup": NEAR,
    "op3_decontamination": CONTAMINATED,
    "op9_sharding": SHARDED,
    "op10_exact_dedup": EXACT,
    "op12_lexical_search": RANKED,
    "op13_phrases": PHRASES,
}
