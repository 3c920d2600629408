"""Lineage and corpus checks.

Every check is a join or a conditional aggregate; results are small
``(check, violations)`` tables combined with ``unionByName``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import norm_key, py_strip

ID_PATTERN = r"^[A-Za-z0-9]+_s[0-9]{4,}(_[0-9]{2,})?$"


def lineage_edges(records: DataFrame) -> DataFrame:
    """``text_id, seed_id, seed_rank``: one row per example a synthetic row was made from."""
    e = records.select("text_id", F.posexplode("derived_from").alias("_p", "seed_id"))
    return e.select("text_id", "seed_id", (F.col("_p") + 1).cast("long").alias("seed_rank"))


def seed_usage(records: DataFrame) -> DataFrame:
    """``seed_id, uses``: how many synthetic rows cite each seed (partial aggregation map-side)."""
    e = records.select(F.explode("derived_from").alias("seed_id"))
    return e.groupBy("seed_id").agg(F.count(F.lit(1)).cast("long").alias("uses"))


def orphan_edges(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """Lineage edges whose seed id is not in the seed table (``left_anti``)."""
    return lineage_edges(records).join(
        seeds.select(F.col("text_id").alias("seed_id")), "seed_id", "left_anti"
    )


def copied_examples(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """``text_id, seed_id``: synthetic rows whose normalized target equals that of one of
    their own prompt examples (V2). Exact copies only.

    One equi-join on (seed id, key hash): only real copies leave the join. The
    key is hashed before the explode, so texts are neither copied nor hashed
    once per example; the array is exploded as a narrow row.
    """
    narrow = records.select("text_id", "derived_from", F.md5(norm_key("tgt_text")).alias("_k")).filter(F.col("_k").isNotNull())
    e = narrow.select("text_id", "_k", F.explode("derived_from").alias("seed_id"))
    s = seeds.select(F.col("text_id").alias("seed_id"), F.md5(norm_key("tgt_text")).alias("_k"))
    return e.join(s, ["seed_id", "_k"]).select("text_id", "seed_id")


def _check(name: str, col) -> F.Column:
    return F.struct(F.lit(name).alias("check"), col.cast("long").alias("violations"))


def split_checks(splits: DataFrame, corpus: DataFrame, expected_total: int | None = None,
                 split_col: str = "split") -> DataFrame:
    """Splits are disjoint and a subset of the corpus."""
    per_id = splits.groupBy("text_id").agg(F.count_distinct(split_col).alias("_n"), F.count(F.lit(1)).alias("_r"))
    known = corpus.select("text_id").distinct().withColumn("_in", F.lit(True))
    found = per_id.join(known, "text_id", "left").agg(
        F.count_if(F.col("_n") > 1).alias("ids_in_several_splits"),
        F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("_r"))), F.lit(0)).alias("split_ids_not_in_corpus"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("_rows"),
    )
    checks = [_check(c, F.col(c)) for c in ("ids_in_several_splits", "split_ids_not_in_corpus")]
    if expected_total is not None:
        checks.append(_check("split_total_off_by", F.abs(F.col("_rows") - F.lit(expected_total))))
    return found.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def invariant_report(corpus: DataFrame, seeds: DataFrame, expected_sources: int) -> DataFrame:
    """Corpus invariants as ``(check, violations)``.

    ``corpus`` holds human and synthetic rows in the pair schema; ``seeds`` is
    the table lineage ids must point into; ``expected_sources`` is
    ``min(15, #seeds)``.
    """
    human = ~F.col("is_synthetic")
    syn = F.col("is_synthetic")
    checks = corpus.agg(
        F.count_if(human & (F.col("derived_from").isNotNull() | F.col("seed_group").isNotNull())).alias("human_rows_with_lineage"),
        F.count_if(syn & (F.col("seed_group").isNull() | (F.col("seed_group") < 1))).alias("synthetic_rows_bad_seed_group"),
        F.count_if(syn & (F.coalesce(F.size("derived_from"), F.lit(-1)) != expected_sources)).alias("synthetic_rows_bad_lineage_size"),
        F.count_if(F.size(F.array_distinct("derived_from")) != F.size("derived_from")).alias("lineage_with_repeated_ids"),
        F.count_if(F.col("tgt_text").isNull()).alias("null_target"),
        F.count_if(F.col("origin").isNull()).alias("null_origin"),
        F.count_if((py_strip("tgt_text") == "") | (py_strip("src_text") == "")).alias("empty_text"),
        F.count_if(~F.coalesce(F.col("text_id").rlike(ID_PATTERN), F.lit(False))).alias("bad_id_format"),
        (F.count(F.lit(1)) - F.count_distinct("text_id")).alias("duplicate_ids"),
    )
    names = [c for c in checks.columns]
    long_form = checks.select(F.explode(F.array(*[_check(n, F.col(n)) for n in names])).alias("c")).select("c.*")
    # edges are summed per seed id before the anti-join
    cited = seed_usage(corpus.where(syn)).join(seeds.select(F.col("text_id").alias("seed_id")), "seed_id", "left_anti")
    orphans = cited.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("violations")).select(
        F.lit("lineage_ids_not_in_seeds").alias("check"), F.col("violations").cast("long")
    )
    return long_form.unionByName(orphans)
