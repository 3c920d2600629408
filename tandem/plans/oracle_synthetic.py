"""DuckDB oracles for prompts, sampling, replies, synthetic records and lineage.

The reply oracle parses no JSON: it reads the documents with the same fault
rules the reply fixture was rendered with (see ``bindings.responses``).
"""

from __future__ import annotations

import re

from tandem.constants import FEWSHOT_TEMPLATE, NON_WS_CLASS, WS_CLASS
from tandem.plans.oracle import CHAT_PAIRS, DOCS_PAIRS, ORACLE, norm, strip

NWS = NON_WS_CLASS
PREFIX = "'Translate the following from Luganda to English: '"
NL = "chr(10)"


def sql_lit(s: str) -> str:
    """SQL expression for a Python string (newlines as chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted)


def sql_format(template: str, args: list[str]) -> str:
    """``template`` with %s / %d filled by SQL expressions, as one concatenation."""
    pieces = re.split(r"%[sd]", template)
    assert len(pieces) == len(args) + 1
    out = []
    for i, p in enumerate(pieces):
        if p:
            out.append(sql_lit(p))
        if i < len(args):
            out.append(f"({args[i]})::VARCHAR")
    return " || ".join(out)


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{NWS}+')"


def truncate(x: str, n: int) -> str:
    return (f"CASE WHEN len(regexp_extract_all({x}, '{NWS}+')) <= {n} THEN {x} "
            f"ELSE array_to_string(list_slice(regexp_extract_all({x}, '{WS_CLASS}*{NWS}+'), 1, {n}), '') END")


def sampling_ctes(seeds_sql: str) -> str:
    """CTEs ``seeds, plan, sample`` for a seed table: the first 15 distinct seeds of a
    sequence of hash draws (240 are plenty for pools of 15 seeds and more)."""
    return f"""
  seeds AS (SELECT *, (row_number() OVER (ORDER BY ord) - 1)::BIGINT AS seed_idx FROM ({seeds_sql})),
  ns AS (SELECT count(*)::BIGINT AS n FROM seeds),
  plan AS (SELECT b AS batch_id, least(30, n - 30 * b)::BIGINT AS requested, n
           FROM (SELECT unnest(range(0, ceil(n / 30.0)::BIGINT)) AS b, n FROM ns)),
  draws AS (SELECT batch_id, j,
                   (('0x' || substr(md5('42:' || batch_id::VARCHAR || ':' || j::VARCHAR), 1, 15))::BIGINT % n) AS seed_idx
            FROM plan, (SELECT unnest(range(0, 240)) AS j)),
  firsts AS (SELECT batch_id, seed_idx, min(j) AS fj FROM draws GROUP BY batch_id, seed_idx),
  ranked AS (SELECT batch_id, seed_idx, row_number() OVER (PARTITION BY batch_id ORDER BY fj, seed_idx) AS rank FROM firsts),
  sample AS (SELECT r.batch_id, r.rank::BIGINT AS rank, s.text_id, s.src_text, s.tgt_text
             FROM ranked r JOIN seeds s USING (seed_idx) WHERE r.rank <= 15)
"""


# Reply fixture over docs_pairs: the attempts and their outcome, by rule.
REPLY_CTES = f"""
  docs AS ({DOCS_PAIRS}),
  items AS (SELECT (ord // 30)::BIGINT AS batch_id, (ord % 30)::BIGINT AS pos,
                   {strip("src_text")} AS src, {strip("tgt_text")} AS tgt FROM docs),
  valid_items AS (SELECT * FROM items WHERE NOT (batch_id % 13 = 5 AND pos = 0)),
  nb AS (SELECT i.batch_id, count(v.pos)::BIGINT AS n_good
         FROM (SELECT DISTINCT batch_id FROM items) i LEFT JOIN valid_items v USING (batch_id) GROUP BY i.batch_id),
  kinds AS (SELECT batch_id, n_good,
                   CASE WHEN batch_id % 11 = 10 THEN 'exhausted'
                        WHEN batch_id % 7 = 3 THEN 'retry'
                        WHEN batch_id % 17 = 8 THEN 'api'
                        ELSE 'plain' END AS kind FROM nb),
  att AS (SELECT batch_id, n_good, kind,
                 unnest(CASE kind WHEN 'exhausted' THEN [1, 2, 3, 4, 5] WHEN 'plain' THEN [1] ELSE [1, 2] END) AS attempt
          FROM kinds),
  attempts AS (
    SELECT batch_id, attempt::BIGINT AS attempt,
           CASE WHEN kind = 'api' AND attempt = 1 THEN 'api_error'
                WHEN kind = 'exhausted' OR (kind = 'retry' AND attempt = 1) OR n_good = 0 THEN 'parse_error'
                ELSE 'ok' END AS status,
           CASE WHEN kind = 'exhausted' OR (kind IN ('retry', 'api') AND attempt = 1) THEN 0 ELSE n_good END::BIGINT AS n_valid
    FROM att),
  used AS (SELECT batch_id, min(attempt) AS attempt FROM attempts WHERE status = 'ok' AND attempt <= 5 GROUP BY batch_id),
  pairs AS (SELECT v.batch_id, v.pos, v.src, v.tgt FROM valid_items v JOIN used u USING (batch_id))
"""

DOCS_RUN = f"""
  {sampling_ctes(DOCS_PAIRS)},
  {REPLY_CTES},
  numbered AS (SELECT *, row_number() OVER (ORDER BY batch_id, pos) AS n FROM pairs),
  kept AS (SELECT * FROM numbered WHERE n <= (SELECT n FROM ns)),
  nsrc AS (SELECT batch_id, count(*)::BIGINT AS n_sources FROM sample GROUP BY batch_id),
  records AS (
    SELECT printf('gem1_s%05d', n) AS text_id, src AS src_text, tgt AS tgt_text,
           'gemini_synthetic' AS origin, true AS is_synthetic, (batch_id + 1)::BIGINT AS seed_group,
           n_sources, n, batch_id
    FROM kept LEFT JOIN nsrc USING (batch_id)),
  final AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY md5({norm('tgt_text')}) ORDER BY n) AS rn FROM records) WHERE rn = 1)
"""

RECORD_COLS = "text_id, src_text, tgt_text, origin, is_synthetic, seed_group, n_sources"

ORACLE["batch_plan"] = f"""
  WITH ns AS (SELECT count(*)::BIGINT AS n FROM documents)
  SELECT b::BIGINT AS batch_id, least(30, n - 30 * b)::BIGINT AS requested
  FROM (SELECT unnest(range(0, ceil(n / 30.0)::BIGINT)) AS b, n FROM ns)
"""

ORACLE["fewshot_sample"] = f"""
  WITH {sampling_ctes(DOCS_PAIRS)}
  SELECT batch_id, rank, text_id FROM sample
"""

_LINE = sql_format("  English: %s\n  Luganda:  %s", ["tgt_text", "src_text"])
_PROMPT = sql_format(FEWSHOT_TEMPLATE, ["n_examples", "block", "requested"])

ORACLE["fewshot_prompt"] = f"""
  WITH {sampling_ctes(CHAT_PAIRS)},
  blocks AS (SELECT batch_id, count(*)::BIGINT AS n_examples,
                    string_agg({_LINE}, chr(10) ORDER BY rank) AS block
             FROM sample GROUP BY batch_id)
  SELECT b.batch_id::BIGINT AS batch_id, n_examples, requested, md5({_PROMPT}) AS prompt_md5
  FROM blocks b JOIN plan p USING (batch_id)
"""

ORACLE["zero_shot_prompt"] = f"SELECT text_id, {PREFIX} || src_text AS text FROM ({CHAT_PAIRS})"
ORACLE["tuned_prompt"] = f"SELECT text_id, {PREFIX} || src_text || {NL} || 'English:' AS text FROM ({CHAT_PAIRS})"

_TRAIN = f"{PREFIX} || src_text || {NL} || 'English: ' || tgt_text || '</s>'"
_SPLIT_RE = r"'(?s)^(.*\nEnglish:)(.*)$'"

ORACLE["training_text"] = f"SELECT text_id, {_TRAIN} AS text FROM ({CHAT_PAIRS})"

ORACLE["completion_split"] = f"""
  SELECT text_id,
         CASE WHEN regexp_matches(t, {_SPLIT_RE}) THEN regexp_extract(t, {_SPLIT_RE}, 1) END AS prompt,
         CASE WHEN regexp_matches(t, {_SPLIT_RE}) THEN regexp_extract(t, {_SPLIT_RE}, 2) END AS completion
  FROM (SELECT text_id, {_TRAIN} AS t FROM ({CHAT_PAIRS}))
"""

ORACLE["truncate_tokens"] = f"""
  SELECT text_id, text, len({tokens('text')})::BIGINT AS n_tokens FROM (
    SELECT text_id, {truncate(f"{PREFIX} || src_text", 512)} AS text FROM ({CHAT_PAIRS}))
"""

ORACLE["sft_dataset"] = f"""
  SELECT text_id, text, len({tokens('text')})::BIGINT AS n_tokens,
         CASE WHEN regexp_matches(text, {_SPLIT_RE}) THEN regexp_extract(text, {_SPLIT_RE}, 1) END AS prompt,
         CASE WHEN regexp_matches(text, {_SPLIT_RE}) THEN regexp_extract(text, {_SPLIT_RE}, 2) END AS completion
  FROM (SELECT text_id, {truncate(_TRAIN, 2048)} AS text FROM ({CHAT_PAIRS}))
"""

ORACLE["reply_pairs"] = f"WITH {REPLY_CTES} SELECT batch_id, pos, src, tgt FROM pairs"

ORACLE["attempt_status"] = f"""
  WITH {REPLY_CTES}
  SELECT a.batch_id, a.attempt, a.status, a.n_valid, (u.attempt IS NOT NULL) AS used
  FROM attempts a LEFT JOIN used u ON a.batch_id = u.batch_id AND a.attempt = u.attempt
"""

ORACLE["batch_status"] = f"""
  WITH {sampling_ctes(DOCS_PAIRS)}, {REPLY_CTES}
  SELECT p.batch_id::BIGINT AS batch_id,
         CASE WHEN count(*) FILTER (WHERE status = 'ok' AND attempt <= 5) > 0 THEN 'ok'
              WHEN count(*) FILTER (WHERE attempt <= 5) >= 5 THEN 'exhausted'
              ELSE 'pending' END AS status
  FROM plan p LEFT JOIN (SELECT * FROM attempts WHERE batch_id <> 2) a USING (batch_id) GROUP BY p.batch_id
"""

ORACLE["batch_shortfall"] = f"""
  WITH {sampling_ctes(DOCS_PAIRS)}, {REPLY_CTES},
  got AS (SELECT batch_id, count(*)::BIGINT AS delivered FROM pairs GROUP BY batch_id),
  d AS (SELECT p.batch_id::BIGINT AS batch_id, p.requested, coalesce(g.delivered, 0)::BIGINT AS delivered
        FROM plan p LEFT JOIN got g USING (batch_id))
  SELECT batch_id, requested, delivered, (requested - delivered)::BIGINT AS shortfall,
         (sum(delivered) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum_delivered
  FROM d
"""

ORACLE["synthetic_numbered"] = f"WITH {DOCS_RUN} SELECT {RECORD_COLS} FROM records"
ORACLE["synthetic_records"] = f"WITH {DOCS_RUN} SELECT {RECORD_COLS} FROM final"

ORACLE["synthetic_5x"] = f"""
  WITH {sampling_ctes(DOCS_PAIRS)}, {REPLY_CTES},
  numbered AS (SELECT *, n0.n // 2 + row_number() OVER (ORDER BY batch_id, pos) AS k, n0.n * 6 // 5 AS target FROM pairs, ns n0)
  SELECT printf('gem5_s%06d', k) AS text_id, src AS src_text, tgt AS tgt_text, 'gemini_synthetic' AS origin,
         true AS is_synthetic, (batch_id + 1)::BIGINT AS seed_group, least(15, (SELECT n FROM ns))::BIGINT AS n_sources
  FROM numbered WHERE k <= target
"""

_Q = "chr(39)"  # a quote
_EDGE_TARGETS = f"""['e', '7', 'None', '1.5', NULL, 'tab', NULL, NULL, '1.0', '1e+16', '2.5e-07', NULL,
  replace('{{#b#: [1, 2.5, None, True], #a#: False, #b2#: {{}}}}', '#', {_Q}),
  replace('[#say "hi"#, #both \\# and "#, #tab\\t#, #é#]', '#', {_Q}),
  '1234567890123456789012345678901234567890', '-inf']"""
ORACLE["reply_edges"] = f"""
  SELECT ord AS doc_id,
         CASE WHEN ord % 16 IN (6, 7, 11) THEN -1 WHEN ord % 16 = 4 THEN 0 WHEN ord % 16 = 15 THEN 2 ELSE 1 END::BIGINT AS n_pairs,
         CASE WHEN ord % 16 IN (4, 6, 7, 11) THEN NULL WHEN ord % 16 = 3 THEN 2 ELSE 0 END::BIGINT AS pos,
         md5(CASE WHEN ord % 16 IN (4, 6, 7, 11) THEN NULL WHEN ord % 16 = 2 THEN 'True' WHEN ord % 16 = 5 THEN 'pad'
                  ELSE {strip("coalesce(tgt_text, '')")} END) AS src_md5,
         {_EDGE_TARGETS}[(ord % 16 + 1)::INTEGER] AS tgt
  FROM ({DOCS_PAIRS})
"""

ORACLE["resume_pending"] = f"""
  WITH {sampling_ctes(DOCS_PAIRS)}, {REPLY_CTES},
  first_ok AS (SELECT batch_id FROM used WHERE attempt = 1)
  SELECT batch_id::BIGINT AS batch_id FROM plan WHERE batch_id NOT IN (SELECT batch_id FROM first_ok)
"""

ORACLE["lineage_seeds"] = f"""
  WITH {DOCS_RUN}
  SELECT f.text_id, s.text_id AS seed_id, s.rank AS seed_rank FROM final f JOIN sample s USING (batch_id)
"""

ORACLE["seed_usage"] = f"""
  WITH {DOCS_RUN}
  SELECT s.text_id AS seed_id, count(*)::BIGINT AS uses FROM final f JOIN sample s USING (batch_id) GROUP BY s.text_id
"""

ORACLE["copied_examples"] = f"""
  WITH {DOCS_RUN}
  SELECT f.text_id, s.text_id AS seed_id FROM final f JOIN sample s USING (batch_id)
  WHERE md5({norm('f.tgt_text')}) = md5({norm('s.tgt_text')})
"""
