"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Views ``documents``, ``conversations``, ``events`` ... are registered by the
checker. Shared fragments build the same bindings as ``tandem.sources.bindings``.
Python ``str.strip()`` is an explicit regex class here too (RE2 ``\\s`` is ASCII).
"""

from __future__ import annotations

from tandem.constants import NON_WS_CLASS, WS_CLASS

WS = WS_CLASS
NWS = NON_WS_CLASS


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def norm(x: str) -> str:
    return strip(f"lower({x})")


DOCS_PAIRS = f"""
  SELECT doc_id::BIGINT AS ord,
         printf('%s_s%05d', source, doc_id) AS text_id,
         split_part(text, chr(10), 1) AS src_text,
         text AS tgt_text,
         source AS origin
  FROM documents
"""

CHAT_PAIRS = """
  SELECT (a.conv_id * 2147483648 + a.turn)::BIGINT AS ord,
         printf('conv_s%05d_%02d', a.conv_id, a.turn) AS text_id,
         a.text AS src_text, b.text AS tgt_text,
         'origin' || (a.conv_id % 4)::VARCHAR AS origin
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
"""

SCORED_EVENTS = """
  SELECT 'sys' || (user_id % 4)::VARCHAR AS system, event_type AS origin, value AS score,
         event_id AS row_id, user_id, ts,
         ['llama3','mistral','aya','gemma','nllb'][(user_id % 5) + 1] AS model
  FROM events
"""

SHUFFLED = f"""
  SELECT text_id, origin,
         (row_number() OVER (ORDER BY md5('42:' || text_id), text_id) - 1)::BIGINT AS pos,
         count(*) OVER () AS n_all
  FROM ({DOCS_PAIRS})
"""

# training / validation / test = ceil(half * w / 22926); evaluation = the rest.
SPLITS = f"""
  WITH s AS ({SHUFFLED}),
  z AS (SELECT *, floor(n_all * 0.5)::BIGINT AS half FROM s),
  b AS (SELECT *, ceil(half * (16926 / 22926.0))::BIGINT AS s1,
                  ceil(half * (2000 / 22926.0))::BIGINT AS s2,
                  ceil(half * (2000 / 22926.0))::BIGINT AS s3 FROM z)
  SELECT text_id, origin,
         CASE WHEN pos < s1 THEN 'training'
              WHEN pos < s1 + s2 THEN 'validation'
              WHEN pos < s1 + s2 + s3 THEN 'test'
              WHEN pos < half THEN 'evaluation' END AS split
  FROM b WHERE pos < half
"""

ORACLE: dict[str, str] = {}

ORACLE["dedup_first_wins"] = f"""
  SELECT text_id, origin FROM (
    SELECT text_id, origin, md5({norm('tgt_text')}) AS k,
           row_number() OVER (PARTITION BY md5({norm('tgt_text')}) ORDER BY ord) AS rn
    FROM ({DOCS_PAIRS})) WHERE rn = 1 OR k IS NULL
"""

ORACLE["dedup_removed"] = f"""
  SELECT count(*)::BIGINT AS total,
         (count(DISTINCT {norm('tgt_text')}) + count(*) FILTER (WHERE tgt_text IS NULL))::BIGINT AS kept,
         (count(*) - count(DISTINCT {norm('tgt_text')}) - count(*) FILTER (WHERE tgt_text IS NULL))::BIGINT AS removed
  FROM ({DOCS_PAIRS})
"""

ORACLE["dedup_rollup"] = f"""
  WITH d AS (
    SELECT origin, length(tgt_text)::DOUBLE AS n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY md5({norm('tgt_text')}) ORDER BY ord) AS rn
      FROM ({DOCS_PAIRS})) WHERE rn = 1)
  SELECT origin, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean_chars, false AS is_total
  FROM d WHERE origin IS NOT NULL GROUP BY origin
  UNION ALL
  SELECT NULL AS origin, count(*)::BIGINT, round(avg(n_chars), 6), true FROM d
"""

ORACLE["first_n"] = f"SELECT text_id FROM ({DOCS_PAIRS}) ORDER BY ord LIMIT 100"

ORACLE["shuffle_order"] = f"""
  SELECT text_id, (row_number() OVER (ORDER BY md5('42:' || text_id), text_id) - 1)::BIGINT AS ord
  FROM ({DOCS_PAIRS})
"""

ORACLE["exact_split"] = f"SELECT text_id, split FROM ({SPLITS})"

ORACLE["source_breakdown"] = f"""
  SELECT origin, count(*)::BIGINT AS n, false AS is_total FROM ({DOCS_PAIRS}) GROUP BY origin
  UNION ALL SELECT NULL, count(*)::BIGINT, true FROM ({DOCS_PAIRS})
"""

ORACLE["split_crosstab"] = f"""
  SELECT origin,
         count(*) FILTER (WHERE split = 'training')::BIGINT AS training,
         count(*) FILTER (WHERE split = 'validation')::BIGINT AS validation,
         count(*) FILTER (WHERE split = 'test')::BIGINT AS test,
         count(*) FILTER (WHERE split = 'evaluation')::BIGINT AS evaluation
  FROM ({SPLITS}) GROUP BY origin
"""


def all_oracles() -> dict[str, str]:
    from tandem.plans import oracle_eval, oracle_synthetic  # noqa: F401  (they add to ORACLE)

    return dict(ORACLE)
