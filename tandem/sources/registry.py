"""Model registry as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.constants import MODEL_REGISTRY


def registry(spark: SparkSession, entries=MODEL_REGISTRY) -> DataFrame:
    """``model, path`` rows (a handful; a proven-small side)."""
    return spark.createDataFrame(list(entries), "model string, path string")


def lookup_models(df: DataFrame, reg: DataFrame, model_col: str = "model") -> DataFrame:
    """Attach ``path`` to every row by model key; unknown keys get a null path.

    The registry is the caller's table: AQE broadcasts it when its size allows.
    """
    return df.join(reg.withColumnRenamed("model", model_col), model_col, "left")


def unknown_models(df: DataFrame, reg: DataFrame, model_col: str = "model") -> DataFrame:
    """Distinct model keys with no registry entry (``left_anti``)."""
    keys = df.select(model_col).distinct()
    return keys.join(reg.withColumnRenamed("model", model_col), model_col, "left_anti")
