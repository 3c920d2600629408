"""tandem: parallel-corpus operations as Spark DataFrame jobs.

Operators take and return DataFrames (or Columns), so they compose with
``DataFrame.transform``. The most used ones are importable from here.
"""

__version__ = "0.1.0"

from tandem.functions.replies import with_reply_pairs  # noqa: E402
from tandem.functions.text import norm_key, py_strip, tokens, truncate_tokens  # noqa: E402
from tandem.operators.dedup import dedup_counts, dedup_first_wins  # noqa: E402
from tandem.operators.lineage import copied_examples, invariant_report, lineage_edges, seed_usage  # noqa: E402
from tandem.operators.metrics import best_epoch, early_stop, score_rollup  # noqa: E402
from tandem.operators.model_ops import apply_generator, apply_scorer  # noqa: E402
from tandem.operators.ranking import exact_split, first_n, global_index, shuffle_order  # noqa: E402
from tandem.operators.reports import condition_status, delta_vs_baseline, leaderboard, summary_lines  # noqa: E402
from tandem.operators.sampling import batch_plan, fewshot_sample  # noqa: E402
from tandem.plans.corpus_prep import combine, prepare  # noqa: E402
from tandem.plans.evaluation import evaluate  # noqa: E402
from tandem.plans.synthetic import ingest_replies, plan_requests  # noqa: E402

__all__ = [
    "apply_generator", "apply_scorer", "batch_plan", "best_epoch", "combine", "condition_status",
    "copied_examples", "dedup_counts", "dedup_first_wins", "delta_vs_baseline", "early_stop", "evaluate",
    "exact_split", "fewshot_sample", "first_n", "global_index", "ingest_replies", "invariant_report",
    "leaderboard", "lineage_edges", "norm_key", "plan_requests", "prepare", "py_strip", "score_rollup",
    "seed_usage", "shuffle_order", "summary_lines", "tokens", "truncate_tokens", "with_reply_pairs",
]
