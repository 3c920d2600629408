"""Run tracking as tables: params and metrics rows, write-once param rule (K6, K7, K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.constants import METRIC_MEAN
from tandem.schema import RUN_PARAMS
from tandem.sinks.writers import land
from tandem.sources.corpus import read_landed


def metrics_from_rollup(rollup: DataFrame, run_col: str = "system", prefix: str = METRIC_MEAN) -> DataFrame:
    """``run_id, key, value``: ``comet_mean`` overall and ``comet_mean_<origin>`` per origin (K7)."""
    key = F.when(F.col("is_total"), F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "_"), F.col("origin")))
    return rollup.select(F.col(run_col).alias("run_id"), key.alias("key"), F.col("mean").cast("double").alias("value"))


def params_from_rollup(rollup: DataFrame, run_col: str = "system") -> DataFrame:
    """``num_examples`` and ``num_examples_<origin>`` params as text (K6)."""
    key = F.when(F.col("is_total"), F.lit("num_examples")).otherwise(F.concat(F.lit("num_examples_"), F.col("origin")))
    return rollup.select(
        F.col(run_col).alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"),
        F.col(run_col).alias("run_name"), key.alias("key"), F.col("n").cast("string").alias("value"),
    )


def params_from_runs(runs: DataFrame, run_col: str, param_cols: list[str], parent_col: str | None = None) -> DataFrame:
    """One params row per run and named column that has a value, as text (K6): model, path,
    test set, batch size, epoch budget, capped error texts, ... ``parent_col`` names
    the run that a child run belongs to."""
    run = F.col(run_col).cast("string")
    parent = F.col(parent_col).cast("string") if parent_col else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in param_cols])
    rows = runs.select(run.alias("run_id"), parent.alias("parent_run_id"), run.alias("run_name"), F.explode(pairs).alias("p"))
    return rows.where(F.col("p.value").isNotNull()).select("run_id", "parent_run_id", "run_name", "p.key", "p.value")


def param_conflicts(params: DataFrame) -> DataFrame:
    """Keys logged with more than one value in a run (K8). Logging the same value
    again is a no-op and is not reported. Per group only counts and the two
    extreme values are kept, so a hot key never collects its values."""
    g = params.groupBy("run_id", "key").agg(
        F.count_distinct("value").cast("long").alias("n_values"),
        F.count(F.lit(1)).cast("long").alias("n_logs"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    return g.where(F.col("n_values") > 1)


def commit_params(params: DataFrame, path: str, order_col: str | None = None, strict: bool = False) -> DataFrame:
    """Write params under the write-once rule (K8); returns every row with its ``outcome``.

    A key of a run has one value. ``new``: the first value, appended to the
    table at ``path``; ``same``: a value that is there already (a no-op);
    ``conflict``: another value, refused. Among rows of one commit the first by
    ``order_col`` (and then by value) counts. ``strict`` raises ``ValueError``
    on a conflict and writes nothing. A commit that is run again after a crash
    finds its rows there as ``same``. One writer at a time.

    The decision is landed before the write, so what is returned is what was
    decided; a hot key is a partial aggregate, never a list of its values.
    """
    spark = params.sparkSession
    there = read_landed(spark, path, RUN_PARAMS).select("run_id", "key", F.col("value").alias("_there"), F.lit(True).alias("_known")).dropDuplicates(["run_id", "key"])
    order = [F.col(order_col)] if order_col else []
    value = F.struct(*order, F.coalesce(F.col("value"), F.lit("")).alias("_v"), F.col("value").alias("value"), F.col("parent_run_id").alias("parent_run_id"), F.col("run_name").alias("run_name"))
    keyed = params.withColumns({"run_id": F.coalesce("run_id", F.lit("")), "key": F.coalesce("key", F.lit(""))})
    first = keyed.groupBy("run_id", "key").agg(F.min(value).alias("_f"))
    rows = keyed.groupBy("run_id", "key", "value").agg(F.count(F.lit(1)).alias("n_logs"))
    judged = rows.join(first, ["run_id", "key"]).join(there, ["run_id", "key"], "left")
    holds = F.when(F.col("_known"), F.col("_there")).otherwise(F.col("_f.value"))
    outcome = F.when(~holds.eqNullSafe(F.col("value")), F.lit("conflict")).when(F.col("_known"), F.lit("same")).otherwise(F.lit("new"))
    decided = land(judged.select("run_id", F.col("_f.parent_run_id").alias("parent_run_id"), F.col("_f.run_name").alias("run_name"), "key", "value", "n_logs", outcome.alias("outcome")), "param-commit")
    if strict and not decided.where("outcome = 'conflict'").isEmpty():
        raise ValueError("params with another value than logged before")
    append(decided.where("outcome = 'new'").select(*[f.name for f in RUN_PARAMS.fields]), path)
    return decided


def append(df: DataFrame, path: str) -> None:
    """Append rows to a run table (Parquet)."""
    df.write.mode("append").parquet(path)
