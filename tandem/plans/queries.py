"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Each query reads the driver's tables through ``tandem.sources.bindings`` and
runs over the whole tables. Output columns are aliased to match the DuckDB
oracle in ``tandem.plans.oracle``; integer outputs are ``bigint`` and means
are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import dedup, metrics, ranking
from tandem.sources import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # import the modules that register further queries
    from tandem.plans import queries_eval, queries_synthetic  # noqa: F401

    return dict(_REGISTRY)


# --- corpus preparation ---------------------------------------------------


@query("dedup_first_wins")
def q_dedup_first_wins(spark, sf_dir):
    d = dedup.dedup_first_wins(B.docs_pairs(spark, sf_dir))
    return d.select("text_id", "origin")


@query("dedup_removed")
def q_dedup_removed(spark, sf_dir):
    return dedup.dedup_counts(B.docs_pairs(spark, sf_dir))


@query("dedup_rollup")
def q_dedup_rollup(spark, sf_dir):
    """Flagship: dedup, then rows and mean length per origin plus the total."""
    d = dedup.dedup_first_wins(B.docs_pairs(spark, sf_dir))
    d = d.withColumn("n_chars", F.length("tgt_text").cast("double"))
    return metrics.score_rollup(d, score_col="n_chars").withColumnRenamed("mean", "mean_chars")


@query("first_n")
def q_first_n(spark, sf_dir):
    return ranking.first_n(B.docs_pairs(spark, sf_dir), 100, order_col="ord").select("text_id")


@query("shuffle_order")
def q_shuffle_order(spark, sf_dir):
    s = ranking.shuffle_order(B.docs_pairs(spark, sf_dir).select("text_id"), seed=42, out="ord")
    return s.select("text_id", "ord")


def _splits(spark, sf_dir) -> DataFrame:
    return ranking.exact_split(B.docs_pairs(spark, sf_dir).select("text_id", "origin"), seed=42)


@query("exact_split")
def q_exact_split(spark, sf_dir):
    return _splits(spark, sf_dir).select("text_id", "split")


@query("source_breakdown")
def q_source_breakdown(spark, sf_dir):
    return metrics.source_breakdown(B.docs_pairs(spark, sf_dir).select("origin"))


@query("split_crosstab")
def q_split_crosstab(spark, sf_dir):
    return metrics.split_crosstab(_splits(spark, sf_dir))
