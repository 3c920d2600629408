"""DuckDB oracles for model application, scoring, reports, run tables, history and checks."""

from __future__ import annotations

from tandem.plans.oracle import CHAT_PAIRS, DOCS_PAIRS, ORACLE, SCORED_EVENTS, SPLITS, norm, strip
from tandem.plans.oracle_synthetic import DOCS_RUN, PREFIX, REPLY_CTES, tokens

# Stand-in model: a space and the whitespace tokens of the source in reverse.
HYPS = f"""
  SELECT text_id, src_text, tgt_text, origin,
         ' ' || array_to_string(list_reverse({tokens('src_text')}), ' ') AS hypothesis
  FROM ({CHAT_PAIRS})
"""

ORACLE["apply_model"] = f"SELECT text_id, hypothesis FROM ({HYPS})"

ORACLE["align_hypotheses"] = f"SELECT text_id, src_text AS src, hypothesis AS mt, tgt_text AS ref FROM ({HYPS})"


def f1(mt: str, ref: str) -> str:
    a = f"list_distinct({tokens(f'lower({mt})')})"
    b = f"list_distinct({tokens(f'lower({ref})')})"
    return (f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 "
            f"ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END")


ORACLE["unmatched_ids"] = f"""
  SELECT text_id, 'no_hypothesis' AS side FROM ({CHAT_PAIRS}) WHERE (ord >> 31) % 5 <> 0 AND (ord >> 31) % 3 = 0
  UNION ALL SELECT text_id, 'no_reference' FROM ({CHAT_PAIRS}) WHERE (ord >> 31) % 5 = 0 AND (ord >> 31) % 3 <> 0
"""
ORACLE["unknown_model_keys"] = f"SELECT DISTINCT model FROM ({SCORED_EVENTS}) WHERE model NOT IN ('llama3', 'mistral', 'aya', 'gemma')"

ORACLE["score_rows"] = f"SELECT text_id, round({f1('hypothesis', 'tgt_text')}, 6) AS score FROM ({HYPS})"

ORACLE["scorer_rows"] = ORACLE["score_rows"]

ROLLUP = f"""
  SELECT system, origin, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, false AS is_total
  FROM ({SCORED_EVENTS}) WHERE origin IS NOT NULL GROUP BY system, origin
  UNION ALL
  SELECT system, NULL, count(*)::BIGINT, round(avg(score), 6), true FROM ({SCORED_EVENTS}) GROUP BY system
"""

ORACLE["score_rollup"] = ROLLUP

_ORIGINS = ("click", "error", "purchase", "signup", "view")
ORACLE["leaderboard"] = f"""
  SELECT system, round(avg(score), 6) AS overall,
         {", ".join(f"round(avg(score) FILTER (WHERE origin = '{o}'), 6) AS {o}" for o in _ORIGINS)}
  FROM ({SCORED_EVENTS}) GROUP BY system
"""

GAPPY = f"""
  SELECT system, CASE WHEN row_id % 7 <> 0 THEN origin END AS origin, CASE WHEN row_id % 5 <> 0 THEN score END AS score
  FROM ({SCORED_EVENTS})
"""
ORACLE["gappy_rollup"] = f"""
  SELECT system, origin, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, false AS is_total
  FROM ({GAPPY}) WHERE origin IS NOT NULL GROUP BY system, origin
  UNION ALL SELECT system, NULL, count(*)::BIGINT, round(avg(score), 6), true FROM ({GAPPY}) GROUP BY system
"""
ORACLE["leaderboard_long"] = f"SELECT system, origin, mean, is_total FROM ({ORACLE['gappy_rollup']})"

ORACLE["delta_vs_baseline"] = f"""
  WITH r AS ({ROLLUP})
  SELECT a.system, a.origin, a.is_total, a.mean, b.mean AS baseline, round(a.mean - b.mean, 6) AS delta
  FROM r a LEFT JOIN (SELECT * FROM r WHERE system = 'sys0') b
    ON a.origin IS NOT DISTINCT FROM b.origin AND a.is_total = b.is_total
  WHERE a.system <> 'sys0'
"""

ORACLE["run_metrics"] = f"""
  SELECT system AS run_id, CASE WHEN is_total THEN 'comet_mean' ELSE 'comet_mean_' || origin END AS key,
         mean AS value FROM ({ROLLUP})
"""

ORACLE["param_conflicts"] = f"""
  WITH p AS (
    SELECT system AS run_id, CASE WHEN is_total THEN 'num_examples' ELSE 'num_examples_' || origin END AS key,
           n::VARCHAR AS value FROM ({ROLLUP})),
  params AS (
    SELECT * FROM p UNION ALL SELECT * FROM p
    UNION ALL SELECT DISTINCT system, 'model', model FROM ({SCORED_EVENTS}))
  SELECT run_id, key, count(DISTINCT value)::BIGINT AS n_values, count(*)::BIGINT AS n_logs,
         min(value) AS min_value, max(value) AS max_value
  FROM params GROUP BY run_id, key HAVING count(DISTINCT value) > 1
"""

ORACLE["param_commits"] = f"""
  WITH p AS (
    SELECT system AS run_id, CASE WHEN is_total THEN 'num_examples' ELSE 'num_examples_' || origin END AS key, n::VARCHAR AS value FROM ({ROLLUP})),
  m AS (SELECT system AS run_id, model AS value, min(model) OVER (PARTITION BY system) AS least, max(model) OVER (PARTITION BY system) AS most
        FROM (SELECT DISTINCT system, model FROM ({SCORED_EVENTS})))
  SELECT 'first' AS written, run_id, key, value, 'new' AS outcome FROM p
  UNION ALL SELECT 'first', run_id, 'model', value, CASE WHEN value = least THEN 'new' ELSE 'conflict' END FROM m
  UNION ALL SELECT 'second', run_id, key, CASE WHEN key LIKE '%k' THEN value || '0' ELSE value END, CASE WHEN key LIKE '%k' THEN 'conflict' ELSE 'same' END FROM p
  UNION ALL SELECT DISTINCT 'second', run_id, 'base', most, 'new' FROM m
  UNION ALL SELECT 'table', run_id, key, value, 'held' FROM p
  UNION ALL SELECT DISTINCT 'table', run_id, 'model', least, 'held' FROM m
  UNION ALL SELECT DISTINCT 'table', run_id, 'base', most, 'held' FROM m
"""

STATUS = f"""
  SELECT system || '/' || origin AS condition, 'LoRA' AS method, substr(system, 4, 8) || 'x' AS data,
         CASE WHEN origin = 'click' THEN round(avg(score), 6) END AS comet_mean, count(*)::BIGINT AS examples,
         CASE origin WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'complete'
                     ELSE 'trained_eval_failed' END AS status,
         CASE origin WHEN 'error' THEN left(repeat('CUDA out of memory. ', 20) || system, 250)
                     WHEN 'signup' THEN left(repeat('scorer failed: ', 20) || system, 250) END AS error
  FROM ({SCORED_EVENTS}) GROUP BY system, origin
"""

ORACLE["condition_status"] = STATUS

ORACLE["summary_table"] = f"""
  SELECT 0::BIGINT AS line_no, 'Condition  | Method | Data | COMET  | Examples | Status' AS line
  UNION ALL SELECT 1, '-----------|--------|------|--------|----------|--------'
  UNION ALL
  SELECT (row_number() OVER (ORDER BY condition) + 1)::BIGINT,
         printf('%-10s | %-6s | %-4s | %-6s | %-8s | %s', condition, method, data,
                CASE WHEN comet_mean IS NULL THEN '  -   ' ELSE printf('%.4f', comet_mean) END,
                examples::VARCHAR, status)
  FROM ({STATUS})
"""

HISTORY = """
  SELECT condition, dense_rank() OVER (PARTITION BY condition ORDER BY day)::BIGINT AS epoch, eval_loss FROM (
    SELECT event_type AS condition, ts::DATE AS day, round(avg(value), 6) AS eval_loss
    FROM events GROUP BY event_type, ts::DATE)
"""

ORACLE["best_epoch"] = f"""
  SELECT condition, epoch, eval_loss FROM (
    SELECT *, row_number() OVER (PARTITION BY condition ORDER BY eval_loss, epoch) AS rn FROM ({HISTORY}))
  WHERE rn = 1
"""

ORACLE["early_stop"] = f"""
  WITH h AS ({HISTORY}),
  b AS (SELECT *, min(eval_loss) OVER (PARTITION BY condition ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM h),
  i AS (SELECT *, (best_before IS NULL OR eval_loss < best_before) AS improved FROM b),
  l AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY condition ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM i)
  SELECT condition,
         coalesce(min(epoch) FILTER (WHERE epoch - last_imp >= 2), max(epoch))::BIGINT AS stop_epoch,
         (min(epoch) FILTER (WHERE epoch - last_imp >= 2) IS NOT NULL) AS stopped_early
  FROM l GROUP BY condition
"""

ORACLE["model_lookup"] = f"""
  WITH reg(model, path) AS (VALUES ('llama3', '/models/Llama-3.1-8B'), ('mistral', '/models/Mistral-7B-v0.3'),
                                   ('aya', '/models/aya-23-8B'), ('gemma', '/models/gemma-7b'))
  SELECT e.model, reg.path, e.n_rows, reg.path IS NOT NULL AS known
  FROM (SELECT model, count(*)::BIGINT AS n_rows FROM ({SCORED_EVENTS}) GROUP BY model) e
  LEFT JOIN reg USING (model)
"""

ORACLE["split_overlap"] = f"""
  WITH s AS ({SPLITS})
  SELECT 'ids_in_several_splits' AS "check",
         (SELECT count(*) FROM (SELECT text_id FROM s GROUP BY text_id HAVING count(DISTINCT split) > 1))::BIGINT AS violations
  UNION ALL SELECT 'split_ids_not_in_corpus',
         (SELECT count(*) FROM s WHERE text_id NOT IN (SELECT text_id FROM ({DOCS_PAIRS})))::BIGINT
  UNION ALL SELECT 'split_total_off_by',
         abs((SELECT count(*) FROM s) - (SELECT count(*) // 2 FROM documents))::BIGINT
"""

_CORPUS = f"""
  SELECT text_id, src_text, tgt_text, origin, false AS is_synthetic, NULL::INTEGER AS n_sources,
         NULL::BIGINT AS seed_group, false AS has_lineage FROM docs
  UNION ALL
  SELECT text_id, src_text, tgt_text, origin, true, n_sources, seed_group, true FROM final
"""

ORACLE["invariant_report"] = f"""
  WITH {DOCS_RUN},
  c AS ({_CORPUS}),
  orphans AS (SELECT count(*) AS n FROM final f JOIN sample s USING (batch_id)
              WHERE s.text_id NOT IN (SELECT text_id FROM docs))
  SELECT 'human_rows_with_lineage' AS "check",
         count(*) FILTER (WHERE NOT is_synthetic AND (has_lineage OR seed_group IS NOT NULL))::BIGINT AS violations FROM c
  UNION ALL SELECT 'synthetic_rows_bad_seed_group',
         count(*) FILTER (WHERE is_synthetic AND (seed_group IS NULL OR seed_group < 1))::BIGINT FROM c
  UNION ALL SELECT 'synthetic_rows_bad_lineage_size',
         count(*) FILTER (WHERE is_synthetic AND coalesce(n_sources, -1) <> least(15, (SELECT count(*) FROM docs)))::BIGINT FROM c
  UNION ALL SELECT 'lineage_with_repeated_ids',
         (SELECT count(*) FROM final f JOIN (SELECT batch_id FROM sample GROUP BY batch_id
                                             HAVING count(DISTINCT text_id) <> count(*)) r USING (batch_id))::BIGINT
  UNION ALL SELECT 'null_target', count(*) FILTER (WHERE tgt_text IS NULL)::BIGINT FROM c
  UNION ALL SELECT 'null_origin', count(*) FILTER (WHERE origin IS NULL)::BIGINT FROM c
  UNION ALL SELECT 'empty_text', count(*) FILTER (WHERE {strip('tgt_text')} = '' OR {strip('src_text')} = '')::BIGINT FROM c
  UNION ALL SELECT 'bad_id_format',
         count(*) FILTER (WHERE NOT regexp_full_match(text_id, '^[A-Za-z0-9]+_s[0-9]{{4,}}(_[0-9]{{2,}})?$'))::BIGINT FROM c
  UNION ALL SELECT 'duplicate_ids', (count(*) - count(DISTINCT text_id))::BIGINT FROM c
  UNION ALL SELECT 'lineage_ids_not_in_seeds', (SELECT n FROM orphans)::BIGINT
"""

ORACLE["json_round_trip"] = """
  SELECT printf('%s_s%05d', source, doc_id) AS text_id, doc_id::BIGINT AS ord,
         true AS derived_from_is_null, true AS seed_group_is_null,
         md5(split_part(text, chr(10), 1)) AS src_md5, md5(text) AS tgt_md5
  FROM documents
"""

ORACLE["json_array_read"] = f"""
  SELECT (row_number() OVER (ORDER BY ord) - 1)::BIGINT AS ord, text_id, md5(src_text) AS src_md5, md5(tgt_text) AS tgt_md5, origin, false AS is_synthetic
  FROM ({DOCS_PAIRS})
"""

ORACLE["landed_or_absent"] = f"""
  SELECT text_id, CASE WHEN ord % 7 = 3 THEN 'again' ELSE origin END AS origin, (ord % 7)::BIGINT AS batch_id, 'landed' AS kind
  FROM ({DOCS_PAIRS})
"""

ORACLE["text_artifact"] = f"SELECT line FROM ({ORACLE['summary_table']})"

ORACLE["replies_read"] = f"""
  WITH {REPLY_CTES}
  SELECT batch_id, attempt::BIGINT AS attempt, CASE WHEN status = 'api_error' THEN '503 UNAVAILABLE' END AS error,
         status = 'api_error' AS no_text
  FROM attempts
"""

_GAPPY_HISTORY = f"""
  SELECT condition, (epoch * 2 - 1)::BIGINT AS epoch, CASE WHEN epoch % 4 <> 1 THEN eval_loss END AS eval_loss,
         row_number() OVER (PARTITION BY condition ORDER BY epoch) AS k
  FROM ({HISTORY})
"""
ORACLE["gappy_best_epoch"] = f"""
  SELECT condition, epoch, eval_loss FROM (
    SELECT *, row_number() OVER (PARTITION BY condition ORDER BY eval_loss, epoch) AS rn
    FROM ({_GAPPY_HISTORY}) WHERE eval_loss IS NOT NULL) WHERE rn = 1
"""
ORACLE["gappy_early_stop"] = f"""
  WITH h AS ({_GAPPY_HISTORY}),
  i AS (SELECT *, eval_loss IS NOT NULL AND coalesce(eval_loss < min(eval_loss) OVER (PARTITION BY condition ORDER BY k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM h),
  l AS (SELECT *, k - coalesce(max(CASE WHEN improved THEN k END) OVER (PARTITION BY condition ORDER BY k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS since FROM i)
  SELECT condition, coalesce(min(epoch) FILTER (WHERE since >= 2), max(epoch))::BIGINT AS stop_epoch,
         (min(epoch) FILTER (WHERE since >= 2) IS NOT NULL) AS stopped_early
  FROM l GROUP BY condition
"""

_FAULTY = f"""
  SELECT ord, CASE WHEN ord % 19 = 3 THEN 'bad id' WHEN ord % 23 = 4 THEN NULL ELSE text_id END AS text_id,
         CASE WHEN ord % 29 = 5 THEN ' ' ELSE src_text END AS src_text, CASE WHEN ord % 31 <> 6 THEN tgt_text END AS tgt_text,
         CASE WHEN ord % 37 <> 7 THEN origin END AS origin, ord % 2 = 1 AS syn,
         ord % 2 = 1 OR ord % 41 = 8 AS has_lineage,
         CASE WHEN ord % 11 = 1 THEN 1 ELSE 2 END AS n_sources,
         ord % 11 <> 1 AND ord % 13 = 1 AS repeated,
         CASE WHEN ord % 11 = 1 OR ord % 13 = 1 THEN 0 ELSE 1 END AS orphans,
         CASE WHEN ord % 2 = 1 AND ord % 43 <> 9 THEN ord % 5 END AS seed_group
  FROM ({DOCS_PAIRS})
"""
ORACLE["planted_violations"] = f"""
  WITH c AS ({_FAULTY})
  SELECT 'human_rows_with_lineage' AS "check", count(*) FILTER (WHERE NOT syn AND has_lineage)::BIGINT AS violations FROM c
  UNION ALL SELECT 'synthetic_rows_bad_seed_group', count(*) FILTER (WHERE syn AND (seed_group IS NULL OR seed_group < 1))::BIGINT FROM c
  UNION ALL SELECT 'synthetic_rows_bad_lineage_size', count(*) FILTER (WHERE syn AND n_sources <> 2)::BIGINT FROM c
  UNION ALL SELECT 'lineage_with_repeated_ids', count(*) FILTER (WHERE has_lineage AND repeated)::BIGINT FROM c
  UNION ALL SELECT 'null_target', count(*) FILTER (WHERE tgt_text IS NULL)::BIGINT FROM c
  UNION ALL SELECT 'null_origin', count(*) FILTER (WHERE origin IS NULL)::BIGINT FROM c
  UNION ALL SELECT 'empty_text', count(*) FILTER (WHERE {strip('tgt_text')} = '' OR {strip('src_text')} = '')::BIGINT FROM c
  UNION ALL SELECT 'bad_id_format', count(*) FILTER (WHERE text_id IS NULL OR text_id = 'bad id')::BIGINT FROM c
  UNION ALL SELECT 'duplicate_ids', (count(*) - count(DISTINCT text_id))::BIGINT FROM c
  UNION ALL SELECT 'lineage_ids_not_in_seeds', sum(CASE WHEN syn THEN orphans ELSE 0 END)::BIGINT FROM c
"""
ORACLE["planted_split_faults"] = f"""
  WITH d AS (SELECT ord FROM ({DOCS_PAIRS}))
  SELECT 'ids_in_several_splits' AS "check", count(*) FILTER (WHERE ord % 6 = 0)::BIGINT AS violations FROM d
  UNION ALL SELECT 'split_ids_not_in_corpus', count(*) FILTER (WHERE ord % 10 = 1)::BIGINT FROM d
  UNION ALL SELECT 'split_total_off_by',
         abs(count(*) FILTER (WHERE ord % 2 = 0) + count(*) FILTER (WHERE ord % 6 = 0) + count(*) FILTER (WHERE ord % 10 = 1) - count(*))::BIGINT FROM d
"""

ORACLE["stream_resume"] = f"WITH {REPLY_CTES} SELECT DISTINCT md5({norm('tgt')}) AS key FROM pairs"


COMBINED = f"""
  SELECT *, row_number() OVER (ORDER BY src, ord) AS cord FROM (
    SELECT 0 AS src, ord, text_id, tgt_text, origin FROM ({DOCS_PAIRS})
    UNION ALL SELECT 1, ord, text_id, tgt_text, origin FROM ({CHAT_PAIRS}))
"""

ORACLE["combined_breakdown"] = f"""
  SELECT origin, count(*)::BIGINT AS n, false AS is_total FROM ({COMBINED}) GROUP BY origin
  UNION ALL SELECT NULL, count(*)::BIGINT, true FROM ({COMBINED})
"""

ORACLE["corpus_prep_crosstab"] = f"""
  WITH d AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY md5({norm('tgt_text')}) ORDER BY cord) AS rn FROM ({COMBINED}))
        WHERE rn = 1),
  s AS (SELECT text_id, origin, (row_number() OVER (ORDER BY md5('42:' || text_id), text_id) - 1) AS pos,
               count(*) OVER () AS n_all FROM d),
  z AS (SELECT *, floor(n_all * 0.5)::BIGINT AS half FROM s),
  b AS (SELECT *, ceil(half * (16926 / 22926.0))::BIGINT AS s1, ceil(half * (2000 / 22926.0))::BIGINT AS s2,
               ceil(half * (2000 / 22926.0))::BIGINT AS s3 FROM z),
  sp AS (SELECT origin, CASE WHEN pos < s1 THEN 'training' WHEN pos < s1 + s2 THEN 'validation'
                             WHEN pos < s1 + s2 + s3 THEN 'test' ELSE 'evaluation' END AS split
         FROM b WHERE pos < half)
  SELECT origin,
         count(*) FILTER (WHERE split = 'training')::BIGINT AS training,
         count(*) FILTER (WHERE split = 'validation')::BIGINT AS validation,
         count(*) FILTER (WHERE split = 'test')::BIGINT AS test,
         count(*) FILTER (WHERE split = 'evaluation')::BIGINT AS evaluation
  FROM sp GROUP BY origin
"""

_SCORED = f"SELECT origin, {f1('hypothesis', 'tgt_text')} AS score FROM ({HYPS})"
ORACLE["eval_rollup"] = f"""
  SELECT origin, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, false AS is_total
  FROM ({_SCORED}) WHERE origin IS NOT NULL GROUP BY origin
  UNION ALL SELECT NULL, count(*)::BIGINT, round(avg(score), 6), true FROM ({_SCORED})
"""

# conditions whose scorer refuses some references fail as a whole
ORACLE["condition_summaries"] = f"""
  WITH s AS (SELECT tgt_text, {f1('hypothesis', 'tgt_text')} AS score FROM ({HYPS})),
  t AS (SELECT count(*)::BIGINT AS n, round(avg(score), 6) AS mean,
               coalesce(bool_or({strip('tgt_text')} = '' OR length(tgt_text) % 97 = 5), false) AS refused FROM s),
  c(k) AS (VALUES (1), (2), (3), (4), (5), (6))
  SELECT 'lora_' || k || 'x' AS condition, 'LoRA' AS method, k || 'x' AS data,
         CASE WHEN n > 0 AND (k IN (1, 5) OR k = 2 AND NOT refused) THEN mean END AS comet_mean, n AS examples,
         CASE WHEN n = 0 OR k IN (3, 4, 6) THEN 'failed' WHEN k = 2 AND refused THEN 'trained_eval_failed' ELSE 'complete' END AS status,
         CASE WHEN k = 6 THEN 'loss is nan' WHEN n = 0 THEN NULL WHEN k = 2 AND refused THEN 'ValueError(''reference refused'')'
              WHEN k = 3 THEN 'RuntimeError(''device lost'')' WHEN k = 4 THEN left('MemoryError(' || chr(39) || repeat('CUDA out of memory. ', 20) || chr(39) || ')', 250) END AS error
  FROM c, t
"""

ORACLE["eval_set_mismatch"] = f"""
  WITH ids AS (SELECT DISTINCT system, ts::DATE::VARCHAR || CASE WHEN system = 'sys2' AND dayofyear(ts) % 7 = 3 THEN '+' ELSE '/' END || origin AS text_id
               FROM ({SCORED_EVENTS}) WHERE NOT (system = 'sys1' AND dayofyear(ts) % 5 = 2)),
  base AS (SELECT text_id FROM ids WHERE system = 'sys0'),
  per AS (SELECT i.system, count(b.text_id) AS shared, count(*) FILTER (WHERE b.text_id IS NULL) AS extra
          FROM ids i LEFT JOIN base b USING (text_id) WHERE i.system <> 'sys0' GROUP BY i.system)
  SELECT system, shared::BIGINT AS shared, extra::BIGINT AS extra,
         ((SELECT count(*) FROM base) - shared)::BIGINT AS missing
  FROM per WHERE extra > 0 OR (SELECT count(*) FROM base) - shared > 0
"""


ORACLE["combined_csv_round_trip"] = f"""
  SELECT text_id, origin, md5(tgt_text) AS tgt_md5,
         md5(CASE WHEN ord % 9 = 0 THEN '' ELSE ' ' || chr(9) || src_text || '  ' END) AS src_md5,
         true AS has_ord, false AS is_synthetic
  FROM ({DOCS_PAIRS})
"""

ORACLE["results_round_trip"] = f"""
  SELECT text_id, origin AS dataset_origin, md5(hypothesis) AS hyp_md5, md5(tgt_text) AS ref_md5,
         round(round({f1('hypothesis', 'tgt_text')}, 10), 6) AS score, true AS derived_from_is_null
  FROM ({HYPS})
"""

ORACLE["stream_progress"] = f"""
  WITH {REPLY_CTES}, n AS (SELECT count(*)::BIGINT AS n FROM documents),
  plan AS (SELECT b AS batch_id, least(30, n - 30 * b)::BIGINT AS requested FROM (SELECT unnest(range(0, ceil(n / 30.0)::BIGINT)) AS b, n FROM n))
  SELECT p.batch_id, p.requested, CASE WHEN a.attempt = 1 THEN 0 WHEN a.attempt > 1 THEN 1 END::BIGINT AS epoch, a.attempt,
         coalesce(a.n_valid, 0)::BIGINT AS got
  FROM plan p LEFT JOIN (SELECT * FROM attempts WHERE status = 'ok' AND attempt <= 5) a USING (batch_id)
"""

# streamed + finalized = the batch records
ORACLE["stream_finalize"] = ORACLE["synthetic_records"]
ORACLE["bootstrap_resume"] = ORACLE["synthetic_records"]

ORACLE["progress_counts"] = f"""
  WITH {DOCS_RUN}
  SELECT 'requested' AS what, (SELECT n FROM ns)::BIGINT AS n UNION ALL SELECT 'generated', (SELECT count(*) FROM records)
  UNION ALL SELECT 'removed', (SELECT count(*) FROM records) - (SELECT count(*) FROM final) UNION ALL SELECT 'saved', (SELECT count(*) FROM final)
"""

ORACLE["run_params"] = f"""
  WITH s AS ({STATUS}), k AS (SELECT unnest(['method', 'data', 'batch_size', 'epochs', 'status', 'error']) AS key)
  SELECT condition AS run_id, split_part(condition, '/', 1) AS parent_run_id, condition AS run_name, key,
         CASE key WHEN 'method' THEN method WHEN 'data' THEN data WHEN 'batch_size' THEN '8' WHEN 'epochs' THEN '20'
                  WHEN 'status' THEN status ELSE error END AS value
  FROM s, k WHERE key <> 'error' OR error IS NOT NULL
"""
ORACLE["model_prompts"] = f"""
  SELECT text_id, model, md5(CASE model WHEN 'llama3' THEN '<s>' || src_text || '</s>' WHEN 'mistral' THEN '[INST] ' || src_text || ' [/INST]'
         WHEN 'aya' THEN src_text || ' => ' || src_text ELSE {PREFIX} || src_text END) AS prompt_md5
  FROM (SELECT *, ['llama3', 'mistral', 'aya', 'gemma'][((ord >> 31) % 4 + 1)::INTEGER] AS model FROM ({CHAT_PAIRS}))
"""
