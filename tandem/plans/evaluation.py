"""Zero-shot and fine-tuned evaluation as Spark jobs (section 3.2 / 3.3 of the survey).

pairs -> first N -> prompts -> model (batched, caller's) -> land hypotheses ->
score (batched, caller's; or the built-in stand-in) -> land scores ->
overall + per-origin means in one pass -> run params / metrics rows.

Conditions are a column, not a loop: one job evaluates every condition, and a
condition whose stage failed gets its status from what it left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.constants import MAX_INPUT_TOKENS_ZERO_SHOT, MAX_SEQ_TOKENS
from tandem.functions.text import subword_truncate, truncate_tokens
from tandem.operators import metrics, model_ops, prompts, ranking, reports
from tandem.schema import PAIR
from tandem.sinks import tracking
from tandem.sinks.writers import land


@dataclass
class EvalResult:
    hypotheses: DataFrame
    scored: DataFrame
    rollup: DataFrame
    run_metrics: DataFrame
    run_params: DataFrame
    errors: DataFrame | None = None  # run, train_error, eval_error of the runs that raised


def evaluate(
    pairs: DataFrame,
    make_model: Callable,
    make_scorer: Callable | None = None,
    limit: int | None = None,
    batch_size: int = 8,
    tuned: bool = False,
    run_col: str | None = None,
    max_input_tokens: int | None = None,
    results_dir: str | None = None,
    catch_errors: bool = False,
    make_encoder: Callable | None = None,
) -> EvalResult:
    """Evaluate ``pairs`` (pair schema + ``ord``; optionally a run/condition
    column ``run_col``). The model output is landed before scoring, and the
    scores are landed before aggregation, so neither UDF runs twice (K3).
    ``hypotheses`` and ``scored`` keep every pair field beside ``hypothesis``
    (and ``score``), so ``write_results_jsonl`` takes either (K2). Prompts are
    cut at ``max_input_tokens``: by default 2,048 tokens with ``tuned`` and 512
    without; 0 cuts nothing. ``make_encoder`` counts them with a subword
    tokenizer (:func:`tandem.functions.text.subword_truncate`) instead of white
    space.

    With ``catch_errors`` (needs ``run_col``; model and scorer may then be
    mappings from run to function) a model or scorer that raises costs its own
    run only: a run whose generation raised is not scored, a run whose
    scoring raised keeps its hypotheses and has no scores, the others are
    complete, and ``errors`` names what was raised."""
    if catch_errors:
        if run_col is None:
            raise ValueError("catch_errors needs run_col")
    elif isinstance(make_model, Mapping) or isinstance(make_scorer, Mapping):
        raise ValueError("a model or scorer per run needs catch_errors")
    d = ranking.first_n(pairs, limit)
    prompt = prompts.tuned_prompt("src_text") if tuned else prompts.zero_shot_prompt("src_text")
    if max_input_tokens is None:
        max_input_tokens = MAX_SEQ_TOKENS if tuned else MAX_INPUT_TOKENS_ZERO_SHOT
    if max_input_tokens and make_encoder is None:
        prompt = truncate_tokens(prompt, max_input_tokens)
    elif max_input_tokens:
        prompt = subword_truncate(prompt, make_encoder, max_input_tokens)["text"]
    have = set(d.columns)
    keep = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PAIR.fields]
    d = d.select(*keep, *([run_col] if run_col else []), prompt.alias("prompt"))
    if catch_errors:
        return _evaluate_caught(d, make_model, make_scorer, batch_size, run_col, results_dir)
    hyps = land(model_ops.apply_generator(d, make_model, "prompt", batch_size=batch_size).drop("prompt"),
                "hypotheses", None if results_dir is None else results_dir + "/hypotheses")
    if make_scorer is None:
        scored = hyps.withColumn("score", model_ops.token_f1("hypothesis", "tgt_text"))
    else:
        scored = model_ops.apply_scorer(hyps, make_scorer, ("src_text", "hypothesis", "tgt_text"), batch_size=batch_size)
    scored = land(scored, "scored", None if results_dir is None else results_dir + "/scored")
    return _result(hyps, scored, scored, run_col)


def _result(hyps: DataFrame, scored: DataFrame, counted: DataFrame, run_col: str | None, errors: DataFrame | None = None) -> EvalResult:
    by = [run_col] if run_col else []
    rollup = metrics.score_rollup(counted, by=by)
    if not run_col:
        rollup = rollup.withColumn("run", F.lit("run"))
    rc = run_col or "run"
    return EvalResult(
        hypotheses=hyps,
        scored=scored,
        rollup=rollup,
        run_metrics=tracking.metrics_from_rollup(rollup, run_col=rc),
        run_params=tracking.params_from_rollup(rollup, run_col=rc),
        errors=errors,
    )


def _evaluate_caught(d: DataFrame, make_model, make_scorer, batch_size: int, run_col: str, results_dir: str | None) -> EvalResult:
    """Both stages with errors as data. A run's errors are one row of a small aggregate;
    rows of failed runs stay apart by an anti-join on the run, never by a filter on batches."""
    place = lambda name: None if results_dir is None else f"{results_dir}/{name}"
    made = model_ops.apply_caught(d, make_model, ("prompt",), "hypothesis", "train_error", T.StringType(), batch_size, run_col)
    hyps = land(made.drop("prompt"), "hypotheses", place("hypotheses"))
    failed = hyps.where(F.col("train_error").isNotNull()).groupBy(run_col).agg(F.min("train_error").alias("train_error"))
    whole = hyps.drop("train_error").join(failed, run_col, "left_anti")
    if make_scorer is None:
        scores = whole.withColumn("score", model_ops.token_f1("hypothesis", "tgt_text")).withColumn("eval_error", F.lit(None).cast("string"))
    else:
        scores = model_ops.apply_caught(whole, make_scorer, ("src_text", "hypothesis", "tgt_text"), "score", "eval_error", T.DoubleType(), batch_size, run_col)
    scores = land(scores, "scores")
    unscored = scores.where(F.col("eval_error").isNotNull()).groupBy(run_col).agg(F.min("eval_error").alias("eval_error"))
    good = scores.drop("eval_error").join(unscored, run_col, "left_anti")
    none = F.lit(None).cast("double")
    rest = whole.join(unscored, run_col, "left_semi").withColumn("score", none)
    rest = rest.unionByName(hyps.where(F.col("train_error").isNull()).drop("train_error").join(failed, run_col, "left_semi").withColumn("score", none))
    scored = land(good.unionByName(rest), "scored", place("scored"))
    errors = failed.join(unscored, run_col, "full")
    return _result(hyps.drop("train_error"), scored, good, run_col, land(errors, "run-errors"))


def condition_summary(result: EvalResult, conditions: DataFrame, run_col: str = "condition") -> DataFrame:
    """Status and summary rows per condition (R2): ``conditions`` holds
    ``condition, method, data, train_error`` (null when training worked) and
    optionally ``examples`` (size of the evaluation set; else the rows with a
    hypothesis). A condition whose generation or scoring raised has no mean."""
    counts = result.scored.groupBy(run_col).agg(
        F.count("hypothesis").alias("n_hypotheses"),
        F.count("score").alias("n_scored"),
        F.avg("score").alias("comet_mean"),
    )
    st = conditions.join(counts, run_col, "left")
    if result.errors is not None:
        raised = result.errors.select(run_col, F.col("train_error").alias("_train"), F.col("eval_error").alias("_eval"))
        st = st.join(raised, run_col, "left")
    else:
        st = st.withColumns({"_train": F.lit(None).cast("string"), "_eval": F.lit(None).cast("string")})
    examples = F.col("examples") if "examples" in conditions.columns else F.coalesce("n_hypotheses", F.lit(0))
    raised = F.coalesce("train_error", "_train")
    st = st.select(
        F.col(run_col).alias("condition"), "method", "data", examples.alias("examples"),
        F.when(raised.isNull(), F.coalesce("n_hypotheses", F.lit(0))).otherwise(F.lit(0)).alias("n_hypotheses"),
        F.when(raised.isNull() & F.col("_eval").isNull(), F.coalesce("n_scored", F.lit(0))).otherwise(F.lit(0)).alias("n_scored"),
        "comet_mean", raised.alias("train_error"), F.col("_eval").alias("eval_error"),
    )
    return reports.condition_status(st)


def collect_summaries(summaries: list[DataFrame]) -> DataFrame:
    """Summary rows of several runs as one table (N5); lazy, one row per condition."""
    if not summaries:
        raise ValueError("no summaries")
    return reduce(DataFrame.unionByName, summaries)


def same_eval_set(scored: DataFrame, baseline: str, system_col: str = "system", id_col: str = "text_id") -> DataFrame:
    """Strict mode for deltas (A12): systems whose scored row ids differ from the
    baseline's, with ``shared``, ``extra`` and ``missing`` id counts. Empty means
    every delta compares the same rows. One left join on the id; the baseline
    size is one small aggregate."""
    ids = scored.select(system_col, id_col).distinct()
    base = ids.where(F.col(system_col) == baseline).select(id_col)
    n_base = base.count()
    others = ids.where(F.col(system_col) != baseline)
    flagged = others.join(base.withColumn("_in", F.lit(True)), id_col, "left")
    per = flagged.groupBy(system_col).agg(
        F.count_if(F.col("_in").isNotNull()).alias("shared"),
        F.count_if(F.col("_in").isNull()).alias("extra"),
    )
    out = per.select(system_col, "shared", "extra", (F.lit(n_base) - F.col("shared")).alias("missing"))
    return out.where((F.col("extra") > 0) | (F.col("missing") > 0))


def compare_systems(scored: DataFrame, baseline: str, strict: bool = False, system_col: str = "system",
                    id_col: str = "text_id") -> DataFrame:
    """Deltas of every system against ``baseline``, overall and per origin.

    ``strict=True`` rejects the comparison (``ValueError``) when any system was
    scored on other rows than the baseline -- the published zero-shot vs
    fine-tuned delta compared different sets. The check is one small job.
    """
    if strict and not same_eval_set(scored, baseline, system_col, id_col).isEmpty():
        raise ValueError(f"systems were not scored on the same rows as {baseline!r}")
    rollup = metrics.score_rollup(scored, by=[system_col])
    return reports.delta_vs_baseline(rollup, baseline, system_col=system_col)
