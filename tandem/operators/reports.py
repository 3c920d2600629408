"""Leaderboard, deltas against a baseline, condition status and the summary table
(A11, A12, R2, R3, X7, X8, X9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.constants import (
    ERROR_TEXT_LIMIT,
    SUMMARY_HEADER,
    SUMMARY_ROW_FORMAT,
    SUMMARY_SEPARATOR,
)
from tandem.functions.text import cap_text, score_cell
from tandem.operators.metrics import score_rollup


def leaderboard(
    scored: DataFrame, system_col: str = "system", origin_col: str = "origin", score_col: str = "score",
    origins: Sequence[str] | None = None, decimals: int = 6,
) -> DataFrame:
    """Mean score per system overall and per origin, in one pass.

    Long form ``system, origin, mean, is_total`` by default: any number of
    origins, nothing on the driver. With ``origins`` named by the caller, wide
    form ``system, overall, <origin>...``.
    """
    if origins is None:
        return score_rollup(scored, score_col, origin_col, by=[system_col], decimals=decimals).drop("n")
    aggs = [F.round(F.avg(score_col), decimals).alias("overall")] + [
        F.round(F.avg(F.when(F.col(origin_col) == o, F.col(score_col))), decimals).alias(o) for o in origins
    ]
    return scored.groupBy(system_col).agg(*aggs)


def delta_vs_baseline(rollup: DataFrame, baseline: str, system_col: str = "system",
                      decimals: int = 6) -> DataFrame:
    """Each system's mean minus the baseline's, overall and per origin.

    ``rollup``: output of :func:`tandem.operators.metrics.score_rollup` with
    ``by=[system]``, read once: the baseline's mean is spread over each origin's
    rows (one row per system) by a window.
    """
    w = Window.partitionBy("origin", "is_total")
    base = F.max(F.when(F.col(system_col) == baseline, F.col("mean"))).over(w)
    j = rollup.withColumn("baseline", base).where(F.col(system_col) != baseline)
    return j.select(
        system_col, "origin", "is_total", "mean", "baseline",
        F.round(F.col("mean") - F.col("baseline"), decimals).alias("delta"),
    )


def condition_status(stages: DataFrame) -> DataFrame:
    """Status per condition from what each stage left behind.

    ``stages``: ``condition, method, data, examples, n_hypotheses, n_scored,
    comet_mean, train_error, eval_error`` and optionally ``finished`` (false while
    the condition's job goes on and has left no error: ``running``). Training errors or no generations ->
    ``failed``; scoring errors or no scores -> ``trained_eval_failed``; else
    ``complete``. One failed condition does not affect another.
    """
    going = F.lit(False)
    if "finished" in stages.columns:
        going = ~F.coalesce("finished", F.lit(True)) & F.col("train_error").isNull() & F.col("eval_error").isNull()
    status = (
        F.when(going, F.lit("running"))
        .when(F.col("train_error").isNotNull() | (F.coalesce("n_hypotheses", F.lit(0)) == 0), F.lit("failed"))
        .when(F.col("eval_error").isNotNull() | (F.coalesce("n_scored", F.lit(0)) == 0), F.lit("trained_eval_failed"))
        .otherwise(F.lit("complete"))
    )
    return stages.select(
        "condition", "method", "data",
        F.when(F.coalesce("n_scored", F.lit(0)) > 0, F.col("comet_mean")).alias("comet_mean"),
        F.col("examples").cast("long").alias("examples"),
        status.alias("status"),
        cap_text(F.coalesce("train_error", "eval_error"), ERROR_TEXT_LIMIT).alias("error"),
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """``line_no, line``: header, separator and one fixed-width row per condition in
    condition order (R3, X7, X8). One row per condition: the numbering window
    runs over this small table only."""
    rows = summary.select(
        "condition",
        F.format_string(
            SUMMARY_ROW_FORMAT,
            F.col("condition"), F.col("method"), F.col("data"),
            score_cell("comet_mean"), F.col("examples").cast("string"), F.col("status"),
        ).alias("line"),
    )
    w = Window.orderBy("condition")
    body = rows.select((F.row_number().over(w) + 1).cast("long").alias("line_no"), "line")
    spark = summary.sparkSession
    head = spark.createDataFrame([(0, SUMMARY_HEADER), (1, SUMMARY_SEPARATOR)], "line_no long, line string")
    return head.unionByName(body)
