"""Score aggregates, corpus counts and training-history queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.constants import EARLY_STOPPING_PATIENCE, SPLIT_NAMES


def score_rollup(
    df: DataFrame,
    score_col: str = "score",
    origin_col: str = "origin",
    by: Sequence[str] = (),
    decimals: int = 6,
) -> DataFrame:
    """Mean and count per origin plus the overall row, in one pass.

    ``GROUPING SETS ((by..., origin), (by...))``: rows are scored once, not once
    more per group. A null origin counts in the overall mean but gets no group
    of its own (pandas ``groupby`` drops null keys; Spark would keep them).
    ``is_total`` tells the overall row apart.
    """
    keys = [F.col(c) for c in by]
    g = df.groupingSets([[*keys, F.col(origin_col)], [*keys]], *keys, F.col(origin_col))
    out = g.agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.round(F.avg(score_col), decimals).alias("mean"),
        F.grouping(origin_col).alias("_g"),
    )
    out = out.where((F.col("_g") == 1) | F.col(origin_col).isNotNull())
    return out.select(*by, origin_col, "n", "mean", (F.col("_g") == 1).alias("is_total"))


def source_breakdown(df: DataFrame, origin_col: str = "origin") -> DataFrame:
    """Rows per origin plus the total."""
    out = df.rollup(origin_col).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.grouping(origin_col).alias("_g")
    )
    return out.select(origin_col, "n", (F.col("_g") == 1).alias("is_total"))


def split_crosstab(
    df: DataFrame, split_col: str = "split", origin_col: str = "origin", splits: Sequence[str] = SPLIT_NAMES
) -> DataFrame:
    """Origin x split counts (A10). Explicit pivot values: no extra pass to find them."""
    p = df.groupBy(origin_col).pivot(split_col, list(splits)).count()
    return p.select(origin_col, *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in splits])


def batch_delivery(plan: DataFrame, pairs: DataFrame, n_batches: int | None = None) -> DataFrame:
    """Requested vs delivered pairs per batch and running totals.

    ``plan``: ``batch_id, requested``; ``pairs``: one row per accepted pair with
    ``batch_id``. Running sums use the distributed prefix sum over batch ids.
    """
    from tandem.operators.ranking import exclusive_prefix_sum, prefix_levels

    got = pairs.groupBy("batch_id").agg(F.count(F.lit(1)).cast("long").alias("delivered"))
    d = plan.join(got, "batch_id", "left").select(
        "batch_id", F.col("requested").cast("long"), F.coalesce("delivered", F.lit(0)).cast("long").alias("delivered")
    )
    d = exclusive_prefix_sum(d, "batch_id", "delivered", "_before", levels=prefix_levels(n_batches))
    return d.select(
        "batch_id",
        "requested",
        "delivered",
        (F.col("requested") - F.col("delivered")).alias("shortfall"),
        (F.col("_before") + F.col("delivered")).alias("cum_delivered"),
    )


def best_epoch(history: DataFrame, condition_col: str = "condition") -> DataFrame:
    """Epoch with the lowest eval loss per condition; ties go to the earliest.
    An epoch without a loss is never the best."""
    best = history.where(F.col("eval_loss").isNotNull()).groupBy(condition_col).agg(F.min(F.struct("eval_loss", "epoch")).alias("_b"))
    return best.select(
        condition_col, F.col("_b.epoch").cast("long").alias("epoch"), F.col("_b.eval_loss").alias("eval_loss")
    )


def early_stop(
    history: DataFrame,
    patience: int = EARLY_STOPPING_PATIENCE,
    epoch_budget: int | None = None,
    condition_col: str = "condition",
) -> DataFrame:
    """Epoch at which training stops: ``patience`` evaluations in a row without a
    strict improvement on the best loss so far, else the last epoch (W5).
    Evaluations are counted, not epochs: epochs may have gaps. An evaluation
    without a loss is no improvement.

    Windows are partitioned by condition; a condition holds one row per epoch.
    """
    h = history
    if epoch_budget is not None:
        h = h.where(F.col("epoch") <= epoch_budget)
    w_prev = Window.partitionBy(condition_col).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy(condition_col).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_best_before", F.min("eval_loss").over(w_prev))
    h = h.withColumn(
        "_improved", F.col("eval_loss").isNotNull() & (F.col("_best_before").isNull() | (F.col("eval_loss") < F.col("_best_before")))
    )
    h = h.withColumn("_k", F.row_number().over(Window.partitionBy(condition_col).orderBy("epoch")))
    # evaluations since the last improvement (or since the start without any)
    h = h.withColumn("_last_imp", F.coalesce(F.max(F.when(F.col("_improved"), F.col("_k"))).over(w_run), F.lit(0)))
    h = h.withColumn("_since", F.col("_k") - F.col("_last_imp"))
    agg = h.groupBy(condition_col).agg(
        F.min(F.when(F.col("_since") >= patience, F.col("epoch"))).alias("_stop"),
        F.max("epoch").alias("_last"),
    )
    return agg.select(
        condition_col,
        F.coalesce("_stop", "_last").cast("long").alias("stop_epoch"),
        F.col("_stop").isNotNull().alias("stopped_early"),
    )


def observe_counts(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, "object"]:
    """Progress counts collected while ``df`` is computed, with no extra pass.

    Returns ``(df, observation)``; after an action on ``df``,
    ``observation.get`` holds ``rows`` and one count per named condition.
    """
    from pyspark.sql import Observation

    obs = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(c).alias(k) for k, c in conditions.items()]
    return df.observe(obs, *exprs), obs
