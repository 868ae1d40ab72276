"""SQL twins of the registry's queries, for DuckDB on the same tables.

Written from the rules alone: whole-table windows, one row per token, plain joins, a recursive query for the prior.
"""

from __future__ import annotations

from packloom.plans import registry as R

L = R.SEQ_LEN
ALPHA, BETA = 0.1, 1.0

SPLIT = """CASE WHEN draw < 8 THEN 'train' WHEN draw < 9 THEN 'validation' ELSE 'test' END"""

DOCS = f"""
docs AS MATERIALIZED (
  SELECT doc_id, domain, text, {SPLIT} AS split
  FROM (SELECT doc_id, lang AS domain, text,
               ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS draw FROM documents)
)"""

WORDS = r"""
worded AS MATERIALIZED (
  SELECT doc_id, domain, split,
         list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '') AS ws
  FROM docs
),
occurrences AS MATERIALIZED (
  SELECT doc_id, domain, split, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS i FROM worded
)"""

VOCAB = f"""
ranked AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS id
  FROM (SELECT token, count(*) AS n FROM occurrences WHERE token <> '<unk>' GROUP BY token)
),
vocabulary AS MATERIALIZED (
  SELECT '<unk>' AS token, 0::BIGINT AS id, 0::BIGINT AS n
  UNION ALL SELECT token, id, n FROM ranked WHERE id <= {R.VOCAB_WORDS}
),
encoded AS MATERIALIZED (
  SELECT doc_id, domain, split, i, coalesce(v.id, 0) AS tok
  FROM occurrences o LEFT JOIN (SELECT * FROM vocabulary WHERE id > 0) v USING (token)
)"""

LAYOUT = f"""
indexed AS (
  SELECT doc_id, domain, split, len(ws) AS n_tokens,
         row_number() OVER (PARTITION BY domain, split ORDER BY doc_id) - 1 AS idx
  FROM worded
),
layout AS MATERIALIZED (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, split, rank ORDER BY doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT *, idx % {R.WORLD} AS rank FROM indexed)
),
ranks AS MATERIALIZED (
  SELECT *, coalesce(sum(chunks) OVER (PARTITION BY domain, split ORDER BY rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_seq
  FROM (SELECT domain, split, rank, greatest(0, (sum(n_tokens)::BIGINT - 1) // {L}) AS chunks
        FROM layout GROUP BY domain, split, rank)
),
stream AS MATERIALIZED (
  SELECT e.domain, e.split, l.rank, l.start + e.i AS t, e.tok
  FROM encoded e JOIN layout l USING (doc_id)
)"""

PAIRS = f"""
shifted AS (
  SELECT *, lag(tok, 1) OVER w AS prev1, lag(tok, 2) OVER w AS prev2
  FROM stream WINDOW w AS (PARTITION BY domain, split, rank ORDER BY t)
),
pairs AS MATERIALIZED (
  SELECT domain, split, rank, chunk, chunks, first_seq + chunk AS seq_id, pos,
         CASE WHEN pos = 0 THEN NULL ELSE prev2 END AS ctx2, prev1 AS ctx1, tok
  FROM (SELECT *, (t - 1) // {L} AS chunk, (t - 1) % {L} AS pos FROM shifted WHERE t > 0)
  JOIN ranks USING (domain, split, rank)
  WHERE chunk < chunks
),
sequences AS MATERIALIZED (SELECT DISTINCT domain, split, rank, chunk, chunks, seq_id FROM pairs)"""

CORPUS = f"WITH RECURSIVE {DOCS}, {WORDS}, {VOCAB}, {LAYOUT}, {PAIRS}"


def _fitted(plan) -> str:
    rows = ", ".join(f"('{e}', '{d}', {o}, {s})" for e, d, o, s in plan)
    budget = f"(steps * {R.ACCUM})"
    return f"""
plan(expert, domain, capacity, steps) AS (VALUES {rows}),
weighted AS MATERIALIZED (
  SELECT expert, capacity, ctx2, ctx1, tok,
         ({budget} - 1 - chunk // {R.BATCH}) // ((chunks + {R.BATCH} - 1) // {R.BATCH}) + 1 AS uses
  FROM pairs JOIN plan USING (domain)
  WHERE split = 'train' AND chunk // {R.BATCH} < {budget}
),
counts AS MATERIALIZED ({_grams("weighted", "expert", "capacity", "sum(uses)")})"""


def _grams(source: str, expert: str, capacity: str, total: str) -> str:
    none = "NULL::BIGINT"
    return f"""
  SELECT {expert} AS expert, 0::BIGINT AS "order", {none} AS ctx2, {none} AS ctx1, tok, {total}::BIGINT AS n
  FROM {source} GROUP BY ALL
  UNION ALL SELECT {expert}, 1, NULL, ctx1, tok, {total}::BIGINT FROM {source} WHERE {capacity} >= 1 GROUP BY ALL
  UNION ALL SELECT {expert}, 2, ctx2, ctx1, tok, {total}::BIGINT FROM {source}
  WHERE {capacity} >= 2 AND ctx2 IS NOT NULL GROUP BY ALL"""


SCORES = f"""
c0 AS (SELECT expert, tok, n FROM counts WHERE "order" = 0),
totals AS (SELECT expert, sum(n) AS n FROM c0 GROUP BY expert),
c1 AS (SELECT expert, ctx1, tok, n FROM counts WHERE "order" = 1),
s1 AS (SELECT expert, ctx1, sum(n) AS n FROM c1 GROUP BY ALL),
c2 AS (SELECT expert, ctx2, ctx1, tok, n FROM counts WHERE "order" = 2),
s2 AS (SELECT expert, ctx2, ctx1, sum(n) AS n FROM c2 GROUP BY ALL),
scores AS MATERIALIZED (
  SELECT domain, split, seq_id, pos, expert,
         ln((coalesce(c2.n, 0) + {BETA} * p1) / (coalesce(s2.n, 0) + {BETA})) AS log_prob
  FROM (
    SELECT p.domain, p.split, p.seq_id, p.pos, p.ctx2, p.ctx1, p.tok, m.expert,
           (coalesce(c1.n, 0) + {BETA} * (coalesce(c0.n, 0) + {ALPHA}) / (totals.n + {ALPHA} * {R.VOCAB_SIZE}))
           / (coalesce(s1.n, 0) + {BETA}) AS p1
    FROM pairs p CROSS JOIN plan m
    JOIN totals ON totals.expert = m.expert
    LEFT JOIN c0 ON c0.expert = m.expert AND c0.tok = p.tok
    LEFT JOIN c1 ON c1.expert = m.expert AND c1.ctx1 = p.ctx1 AND c1.tok = p.tok
    LEFT JOIN s1 ON s1.expert = m.expert AND s1.ctx1 = p.ctx1
  ) q
  LEFT JOIN c2 USING (expert, ctx2, ctx1, tok)
  LEFT JOIN s2 USING (expert, ctx2, ctx1)
)"""


def _members(ensembles) -> str:
    rows = ", ".join(f"('{n}', '{e}', {i})" for n, members in ensembles.items() for i, e in enumerate(members))
    return f"""
members(ensemble, expert, place) AS (VALUES {rows}),
wide AS MATERIALIZED (
  SELECT ensemble, domain, split, seq_id, pos,
         max(CASE WHEN place = 0 THEN log_prob END) AS l0,
         max(CASE WHEN place = 1 THEN log_prob END) AS l1,
         max(CASE WHEN place = 2 THEN log_prob END) AS l2
  FROM scores JOIN members USING (expert) GROUP BY ALL
),
history AS MATERIALIZED (
  SELECT *, coalesce(sum(l0) OVER w, 0) AS h0, coalesce(sum(l1) OVER w, 0) AS h1, coalesce(sum(l2) OVER w, 0) AS h2
  FROM wide
  WINDOW w AS (PARTITION BY ensemble, domain, split, seq_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
likelihood AS MATERIALIZED (
  SELECT ensemble, domain, split, seq_id, sum(l0) AS s0, sum(l1) AS s1, sum(l2) AS s2
  FROM wide WHERE seq_id < {R.PRIOR_SEQUENCES} GROUP BY ALL
),
fold AS (
  SELECT DISTINCT ensemble, domain, split, 0::BIGINT AS n, 0::DOUBLE AS q0, 0::DOUBLE AS q1, 0::DOUBLE AS q2
  FROM likelihood
  UNION ALL
  SELECT ensemble, domain, split, n, {", ".join(
      f"greatest(f{i}, p{i}) + ln(1 + exp(-abs(f{i} - p{i})))" for i in range(3))}
  FROM (
    SELECT ensemble, domain, split, n, {", ".join(
        f"n * ln({R.DECAY}) + q{i} AS f{i}, s{i} + q{i} - {_lse(*[f'(s{j} + q{j})' for j in range(3)])} AS p{i}"
        for i in range(3))}
    FROM (
      SELECT f.ensemble, f.domain, f.split, f.n + 1 AS n, q0, q1, q2, s0, s1, s2
      FROM fold f JOIN likelihood k
        ON k.ensemble = f.ensemble AND k.domain = f.domain AND k.split = f.split AND k.seq_id = f.n
    )
  )
),
prior AS MATERIALIZED (
  SELECT ensemble, domain, split, {", ".join(f"q{i} - {_lse('q0', 'q1', 'q2')} AS r{i}" for i in range(3))}
  FROM fold QUALIFY row_number() OVER (PARTITION BY ensemble, domain, split ORDER BY n DESC) = 1
)"""


def _lse(a: str, b: str, c: str) -> str:
    top = f"greatest({a}, {b}, {c})"
    return f"({top} + ln(exp({a} - {top}) + exp({b} - {top}) + exp({c} - {top})))"


def _mix(weights: list[str]) -> str:
    joint = [f"({w} + l{i})" for i, w in enumerate(weights)]
    return f"({_lse(*joint)} - {_lse(*weights)})"


PLAIN = ["h0", "h1", "h2"]
PRIORED = ["(h0 + r0)", "(h1 + r1)", "(h2 + r2)"]
AVERAGE = "((l0 + l1 + l2) / 3)"

ONE_ENSEMBLE = {"all": R.EXPERTS}
COUNTED = f"{CORPUS}, {_fitted(R.PLAN)}"
SCORED = f"{COUNTED}, {SCORES}"
WIDE = f"{SCORED}, {_members(ONE_ENSEMBLE)}"
COMPARED = f"{CORPUS}, {_fitted(R.SETUP_PLAN)}, {SCORES}, {_members(R.ENSEMBLES)}"


def _r(expression: str, digits: int) -> str:
    return f"round({expression}, {digits}) + 0.0"


def _losses(keys: str) -> str:
    parts = [
        ("simple_avg", AVERAGE, "history"),
        ("uniform_prior", _mix(PLAIN), "history"),
        ("cached_prior", _mix(PRIORED), "history JOIN prior USING (ensemble, domain, split)"),
    ]
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS method, count(*) AS n_tokens, exp(-sum({e}) / count(*)) AS perplexity "
        f"FROM {source} GROUP BY {keys}"
        for m, e, source in parts
    )


def _perplexity_of(expression: str, source: str) -> str:
    return (
        f"SELECT domain, split, count(*) AS n_tokens, {_r(f'exp(-sum({expression}) / count(*))', 4)} AS perplexity "
        f"FROM {source} GROUP BY domain, split"
    )


PACKED_TEXT = f"""
texts AS (
  SELECT domain, split, rank, seq_id,
         string_agg(ctx1::VARCHAR, ' ' ORDER BY pos) AS input_ids, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS label
  FROM pairs GROUP BY domain, split, rank, seq_id
)"""

BUDGET = R.SNAPSHOTS[-1] * R.ACCUM
SCHEDULE = f"""
batched AS (
  SELECT domain, split, rank, seq_id, chunk // {R.BATCH} AS batch_id,
         (chunks + {R.BATCH} - 1) // {R.BATCH} AS batches
  FROM sequences
),
schedule AS MATERIALIZED (
  SELECT domain, split, rank, seq_id, epoch, epoch * batches + batch_id AS micro,
         (epoch * batches + batch_id) // {R.ACCUM} + 1 AS step
  FROM (SELECT *, unnest(range(0, ({BUDGET} - 1 - batch_id) // batches + 1)) AS epoch
        FROM batched WHERE batch_id < {BUDGET})
)"""

PER_SEQUENCE = f"""
SELECT domain, split, seq_id, expert, count(*) AS n_tokens, {_r("sum(log_prob)", 5)} AS log_likelihood,
       {_r("sum(log_prob * (pos + 1))", 5)} AS placed
FROM scores GROUP BY domain, split, seq_id, expert"""

SEED = f"""training AS (SELECT * FROM pairs WHERE split = 'train'),
seed AS ({_grams("training", "'seed'", "2", "count(*)")})"""

ROLLUP = f"""
logged AS (
  SELECT user_id % {R.METRIC_WORLD} AS rank, value AS loss, second(ts) AS seconds,
         row_number() OVER (PARTITION BY user_id % {R.METRIC_WORLD} ORDER BY event_id) - 1 AS micro
  FROM events
),
rolled AS (
  SELECT ((micro // {R.ACCUM}) // {R.METRIC_INTERVAL} + 1) * {R.METRIC_INTERVAL} AS step,
         sum(loss) / {R.METRIC_WORLD} / {R.METRIC_INTERVAL} / {R.ACCUM} AS train_loss,
         sum(CASE WHEN rank = 0 THEN seconds END)::DOUBLE / {R.METRIC_INTERVAL} AS time_per_step
  FROM logged GROUP BY 1
  HAVING count(*) = {R.METRIC_WORLD * R.METRIC_INTERVAL * R.ACCUM}
)"""

LOGITS = """
logits AS (
  SELECT vec_id, label::BIGINT AS label, embedding[label + 1]::DOUBLE - (top + ln(list_sum(
           list_transform(embedding, lambda x: exp(x::DOUBLE - top))))) AS log_prob
  FROM (SELECT *, list_max(embedding)::DOUBLE AS top FROM embeddings)
)"""

UPPER_DOCS = f"WITH {DOCS} SELECT doc_id, upper(domain) AS domain, split FROM docs"

#: contexts of up to four tokens, nearest first, within a sequence
DEEP = f"""
deep AS MATERIALIZED (
  SELECT p.expert, p.capacity, d.tok, d.p1, d.p2, d.p3, d.p4, (d.t - 1) % {L} AS pos,
         (steps * {R.ACCUM} - 1 - (d.t - 1) // {L} // {R.BATCH}) // ((chunks + {R.BATCH} - 1) // {R.BATCH}) + 1 AS uses
  FROM (SELECT *, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3, lag(tok, 4) OVER w AS p4
        FROM stream WINDOW w AS (PARTITION BY domain, split, rank ORDER BY t)) d
  JOIN ranks USING (domain, split, rank)
  JOIN (VALUES {", ".join(f"('{e}', '{d}', {o}, {n})" for e, d, o, n in R.DEEP_PLAN)}) p(expert, domain, capacity, steps)
    ON p.domain = d.domain
  WHERE d.split = 'train' AND t > 0 AND (t - 1) // {L} < chunks AND (d.t - 1) // {L} // {R.BATCH} < steps * {R.ACCUM}
)"""
DEEP_COUNTS = " UNION ALL ".join(
    f"""SELECT expert, {k}::BIGINT AS "order", {"concat_ws(' ', " + ", ".join(f"p{i}" for i in range(1, k + 1)) + ")" if k else "''"} AS context,
        tok, sum(uses)::BIGINT AS n FROM deep WHERE capacity >= {k} AND pos >= {k - 1} GROUP BY ALL"""
    for k in range(5)
)

ORACLES: dict[str, str] = {
    # sources and sinks
    "corpus_scan": f"WITH {DOCS} SELECT doc_id, domain, split, length(text)::BIGINT AS n_chars FROM docs",
    "drop_empty": """
        SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE line IS NOT NULL AND line <> '' GROUP BY doc_id""",
    "conversation_text": "SELECT conv_id, turn, text FROM conversations",
    "packed_roundtrip": f"""{CORPUS}, {PACKED_TEXT}
        SELECT domain, split, rank, chunk, seq_id, input_ids, label
        FROM texts JOIN sequences USING (domain, split, rank, seq_id)""",
    "file_manifest": f"""{CORPUS}
        SELECT domain, split, rank, min(chunk) AS first_chunk, count(*) AS n_rows
        FROM sequences GROUP BY domain, split, rank, chunk // {R.SAMPLES_PER_FILE}""",
    "overwrite_roundtrip": UPPER_DOCS,
    "ignore_roundtrip": f"WITH {DOCS} SELECT doc_id, domain, split FROM docs",
    "expert_catalog": """
        WITH paths AS (
          SELECT 'runs/train_' || source || '_expert_m_domain_' || lang || '/checkpoints/model_' || max(doc_id)
                 || '.bin' AS path,
                 CASE WHEN max(doc_id) % 2 = 0 THEN source END AS given
          FROM documents GROUP BY source, lang)
        SELECT path, given, coalesce(given, string_split(string_split(path, '/')[-3], '_domain_')[-1]) AS domain
        FROM paths""",
    "expert_roundtrip": f"""{COUNTED}
        SELECT expert, steps::BIGINT AS step, "order", ctx2, ctx1, tok, n FROM counts JOIN plan USING (expert)""",
    # rows
    "doc_index": f"""WITH {DOCS}
        SELECT doc_id, domain, split, row_number() OVER (PARTITION BY domain, split ORDER BY doc_id) - 1 AS index
        FROM docs""",
    "null_domain_index": """
        SELECT doc_id, nullif(lang, 'es') AS domain,
               row_number() OVER (PARTITION BY nullif(lang, 'es') ORDER BY doc_id) - 1 AS index
        FROM documents""",
    "row_key_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents",
    "turn_index": "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS index FROM conversations",
    "shard_sizes": f"""WITH {DOCS}
        SELECT domain, split, idx % {R.WORLD} AS rank, count(*) AS n_docs
        FROM (SELECT *, row_number() OVER (PARTITION BY domain, split ORDER BY doc_id) - 1 AS idx FROM docs)
        GROUP BY ALL""",
    "split_sizes": f"WITH {DOCS} SELECT domain, split, count(*) AS n_docs FROM docs GROUP BY ALL",
    "shuffled_rank": f"""
        SELECT doc_id, row_number() OVER (ORDER BY md5('{R.SEED}:' || doc_id), doc_id) - 1 AS position
        FROM documents""",
    "shuffled_rows": f"""
        SELECT doc_id, md5(text) AS text_md5,
               ('0x' || substr(md5('{R.SEED}:' || doc_id), 1, 8))::BIGINT * {R.RESHARDS} // 4294967296 AS shard
        FROM documents""",
    "shuffle_packed": f"""{CORPUS}, {PACKED_TEXT}
        SELECT domain, split, seq_id, label,
               ('0x' || substr(md5('{R.SEED}:' || coalesce(domain, '') || ':' || split || ':' || seq_id), 1, 8))::BIGINT
               * {R.RESHARDS} // 4294967296 AS shard
        FROM texts""",
    "reshard_sizes": f"""
        SELECT idx % {R.RESHARDS} AS shard, count(*) AS n_docs, sum(doc_id)::BIGINT AS sum_doc_id
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) GROUP BY 1""",
    "batches": f"""{CORPUS}
        SELECT domain, split, rank, chunk // {R.EVAL_BATCH} AS batch_id, count(*) AS n_sequences,
               max(chunk) AS last_chunk
        FROM sequences GROUP BY ALL""",
    "eval_limit": f"""{CORPUS}
        SELECT domain, split, count(DISTINCT seq_id // {R.EVAL_BATCH}) AS n_batches, count(*) AS n_sequences
        FROM sequences WHERE seq_id // {R.EVAL_BATCH} <= {R.EVAL_STEPS} GROUP BY ALL""",
    "first_sequences": f"""{CORPUS}
        SELECT domain, split, seq_id, rank, chunk FROM sequences WHERE seq_id < {R.PRIOR_SEQUENCES}""",
    "train_schedule": f"""{CORPUS}, {SCHEDULE}
        SELECT domain, split, rank, seq_id, count(*) AS times_seen, max(epoch) AS last_epoch,
               sum(micro)::BIGINT AS sum_micro, sum(step)::BIGINT AS sum_step
        FROM schedule GROUP BY ALL""",
    "times_seen": f"""{CORPUS}, {SCHEDULE}
        SELECT domain, split, rank, seq_id, count(*) AS times_seen
        FROM schedule WHERE step <= {R.SNAPSHOTS[0]} GROUP BY ALL""",
    "snapshot_counts": f"""{CORPUS}, {SCHEDULE}
        SELECT domain, split, rank, snapshot, count(*) AS n_uses, max(micro) AS last_micro
        FROM schedule JOIN (SELECT unnest({list(R.SNAPSHOTS)})::BIGINT AS snapshot) s ON step <= snapshot
        GROUP BY ALL""",
    # tokens
    "vocab": f"WITH {DOCS}, {WORDS}, {VOCAB} SELECT token, id, n FROM vocabulary",
    "encode_docs": f"""WITH {DOCS}, {WORDS}, {VOCAB}
        SELECT doc_id, count(tok) AS n_tokens, coalesce(string_agg(tok::VARCHAR, ' ' ORDER BY i), '') AS ids
        FROM docs LEFT JOIN encoded USING (doc_id) GROUP BY doc_id""",
    "token_offsets": f"""{CORPUS}
        SELECT doc_id, domain, split, rank, idx AS index, n_tokens, start AS "offset" FROM layout""",
    "pack_sequences": f"""{CORPUS}
        SELECT domain, split, rank, chunk, string_agg(tok::VARCHAR, ' ' ORDER BY t) AS tokens
        FROM (SELECT *, t // {L} AS chunk FROM stream
              UNION ALL SELECT *, t // {L} - 1 FROM stream WHERE t > 0 AND t % {L} = 0)
        GROUP BY domain, split, rank, chunk HAVING count(*) = {L + 1}""",
    "label_shift": f"{CORPUS}, {PACKED_TEXT} SELECT * FROM texts",
    "training_pairs": f"{CORPUS} SELECT domain, split, seq_id, pos, ctx2, ctx1, tok FROM pairs",
    "token_stats": f"""{CORPUS}
        SELECT domain, split, rank, count(DISTINCT seq_id) AS n_sequences, count(*) AS n_tokens
        FROM pairs GROUP BY ALL""",
    # experts
    "seed_counts": f"""{CORPUS}, training AS (SELECT * FROM pairs WHERE split = 'train')
        {_grams("training", "'seed'", "1", "count(*)")}""",
    "continued_counts": f"""{COUNTED}, {SEED}
        SELECT expert, "order", ctx2, ctx1, tok, sum(n)::BIGINT AS n
        FROM (SELECT p.expert, s.order, s.ctx2, s.ctx1, s.tok, s.n FROM seed s JOIN plan p ON s.order <= p.capacity
              UNION ALL SELECT * FROM counts) GROUP BY ALL""",
    "expert_chains": f"""{CORPUS}, {_fitted(R.CHAIN_PLAN)}, {SEED}, links(expert, step, place) AS (VALUES {", ".join(
        f"('{d}_o{o}', {s}::BIGINT, {n})" for n, (d, s) in enumerate(R.CHAIN) for o in R.ORDERS)})
        SELECT expert, step, "order", ctx2, ctx1, tok, sum(n)::BIGINT AS n
        FROM (SELECT l.expert, l.step, s.order, s.ctx2, s.ctx1, s.tok, s.n
              FROM seed s JOIN plan p ON s.order <= p.capacity JOIN links l ON l.expert = p.expert
              UNION ALL
              SELECT l.expert, l.step, c.order, c.ctx2, c.ctx1, c.tok, c.n
              FROM links l JOIN plan p ON p.expert = l.expert JOIN links e ON e.place <= l.place
              JOIN plan q ON q.expert = e.expert AND q.capacity = p.capacity
              JOIN counts c ON c.expert = e.expert) GROUP BY ALL""",
    "domain_experts": f'{COUNTED} SELECT expert, "order", ctx2, ctx1, tok, n FROM counts',
    "expert_scores": f"{SCORED} {PER_SEQUENCE}",
    # evaluation and ensembles
    "logit_log_prob": f"WITH {LOGITS} SELECT vec_id, label, {_r('log_prob', 6)} AS log_prob FROM logits",
    "cross_entropy": f"""WITH {LOGITS}
        SELECT label, {_r("avg(-log_prob)", 5)} AS loss, 'mean' AS reduction FROM logits GROUP BY label
        UNION ALL SELECT label, {_r("sum(-log_prob)", 5)}, 'sum' FROM logits GROUP BY label
        UNION ALL SELECT label, {_r("max(-log_prob)", 5)}, 'none_max' FROM logits GROUP BY label""",
    "perplexity": f"""{SCORED}
        SELECT domain, split, expert, count(*) AS n_tokens,
               {_r("exp(-sum(log_prob) / count(*))", 4)} AS perplexity
        FROM scores GROUP BY domain, split, expert""",
    "learning_curve": f"""{CORPUS}, {_fitted(R.CURVE_PLAN)}, {SCORES}
        SELECT domain, expert, count(*) AS n_tokens, {_r("exp(-sum(log_prob) / count(*))", 4)} AS perplexity
        FROM scores WHERE split = 'validation' GROUP BY domain, expert""",
    "ens_simple_avg": f"{WIDE} {_perplexity_of(AVERAGE, 'history')}",
    "expert_posterior": f"""{WIDE},
        weighed AS (SELECT *, {_lse(*PLAIN)} AS norm FROM history),
        posts AS ({" UNION ALL ".join(
            f"SELECT domain, split, seq_id, '{e}' AS expert, h{i} - norm AS log_post FROM weighed"
            for i, e in enumerate(R.EXPERTS))})
        SELECT domain, split, seq_id, expert, count(*) AS n_tokens, {_r("avg(exp(log_post))", 5)} AS mean_weight,
               {_r("sum(log_post)", 5)} AS sum_log_post
        FROM posts GROUP BY domain, split, seq_id, expert""",
    "ens_uniform": f"{WIDE} {_perplexity_of(_mix(PLAIN), 'history')}",
    "seq_posterior": f"""{SCORED},
        summed AS (SELECT domain, split, seq_id, expert, sum(log_prob) AS ll FROM scores GROUP BY ALL),
        shifted_sums AS (SELECT *, max(ll) OVER (PARTITION BY domain, split, seq_id) AS top FROM summed)
        SELECT domain, split, seq_id, expert, {_r("ll", 5)} AS log_likelihood,
               {_r("ll - top - ln(sum(exp(ll - top)) OVER (PARTITION BY domain, split, seq_id))", 5)} AS log_post
        FROM shifted_sums""",
    "cached_prior": f"""{WIDE} {" UNION ALL ".join(
        f"SELECT domain, split, '{e}' AS expert, {_r(f'r{i}', 5)} AS log_prior FROM prior"
        for i, e in enumerate(R.EXPERTS))}""",
    "ens_cached": f"{WIDE} {_perplexity_of(_mix(PRIORED), 'history JOIN prior USING (ensemble, domain, split)')}",
    "ens_report": f"""{WIDE}, losses AS ({_losses("domain, split")})
        SELECT method, split, {", ".join(
            f"max(CASE WHEN domain = '{d}' THEN round(perplexity, 1) END) AS {d}" for d in R.DOMAINS)}
        FROM losses GROUP BY method, split""",
    "ens_compare": f"""{COMPARED}, losses AS ({_losses("ensemble, domain, split")})
        SELECT ensemble, domain, split, method, n_tokens, {_r("perplexity", 4)} AS perplexity FROM losses""",
    # training metrics
    "metrics_rollup": f"""WITH {ROLLUP}
        SELECT step, {_r("train_loss", 8)} AS train_loss, {_r("time_per_step", 8)} AS time_per_step FROM rolled""",
    "lr_column": f"""WITH {ROLLUP}
        SELECT step, {_r("CASE WHEN step < 200 THEN 0.5 * (step + 1) / 200 ELSE 0.5 END", 8)} AS warmup,
               {_r('''CASE WHEN step < 200 THEN 0.5 * (step + 1) / 200 WHEN step >= 1000 THEN 0.05
                      ELSE 0.05 + 0.45 * 0.5 * (1 + cos(pi() * (step - 200) / (1000 - 200))) END''', 8)} AS cosine
        FROM rolled""",
}
_DRAW = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_KEYED = f"'{R.SEED}:' || epoch || ':' || r"
ORACLES |= {
    "shuffle_in_place": ORACLES["shuffled_rows"],
    "verified_manifest": f"""{CORPUS}, {PACKED_TEXT},
        digested AS (
          SELECT t.domain, t.split, t.rank, (t.seq_id - k.first_seq) // {R.SAMPLES_PER_FILE} AS file,
                 {_DRAW.format("concat_ws('|', t.domain, t.split, t.rank, t.seq_id - k.first_seq, t.seq_id, input_ids, label)")} AS d
          FROM texts t JOIN ranks k USING (domain, split, rank)
        )
        SELECT domain, split, rank, file, count(*) AS n_rows, sum(d::HUGEINT)::VARCHAR AS digest, 'ok' AS status
        FROM digested GROUP BY ALL""",
    "epoch_order": f"""
        WITH RECURSIVE numbered AS (
          SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents
        ),
        walk AS (
          SELECT doc_id, epoch, n, 0 AS r, idx::BIGINT AS place
          FROM numbered CROSS JOIN (SELECT unnest(range({R.EPOCHS})) AS epoch)
          UNION ALL
          SELECT doc_id, epoch, n, r,
                 CASE WHEN {_DRAW.format(_KEYED + " || ':' || greatest(place, other)")} % 2 = 1 THEN other ELSE place END
          FROM (SELECT doc_id, epoch, n, r, place, ((({_DRAW.format(_KEYED)} % n) - place) % n + n) % n AS other
                FROM (SELECT doc_id, epoch, n, r + 1 AS r, place FROM walk WHERE r < 32))
        )
        SELECT doc_id, epoch, place FROM walk WHERE r = 32""",
    "first_from_store": ORACLES["first_sequences"],
    "pack_appended": ORACLES["label_shift"],
    "vocab_summary": ORACLES["vocab"],
    "bucketed_scores": ORACLES["expert_scores"],
    "suffix_counts": f"{CORPUS}, {DEEP} {DEEP_COUNTS}",
    "snapshot_deltas": f'{CORPUS}, {_fitted(R.DELTA_PLAN)} SELECT expert, "order", ctx2, ctx1, tok, n FROM counts',
}
