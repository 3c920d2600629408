"""Batch plan, reproducible few-shot sampling and lineage lists.

The reference draws ``random.sample(seeds, 15)`` per batch, unseeded. Here a
draw is a hash: draw ``j`` of batch ``b`` picks seed index
``md5('seed:b:j')[:15] mod N`` (60 bits, so every seed of any pool can be drawn); the first 15 distinct picks, in draw order, are
the batch's examples. Cost is O(batches x draws), never O(batches x seeds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.constants import BATCH_SIZE, EXAMPLES_PER_CALL
from tandem.operators.ranking import global_index, hash_unit
from tandem.session import checkpoint_root

DRAWS_PER_ROUND = 60


def batch_plan(spark: SparkSession, total: int, batch_size: int = BATCH_SIZE) -> DataFrame:
    """``ceil(total / batch_size)`` batches; batch ``b`` asks ``min(size, total - size*b)`` (L2).

    ``spark.range`` generates the ids in parallel; nothing is collected.
    """
    if total < 0:
        raise ValueError("total must be >= 0")
    n_batches = -(-total // batch_size)
    return spark.range(n_batches).select(
        F.col("id").alias("batch_id"),
        F.least(F.lit(batch_size), F.lit(total) - F.col("id") * batch_size).cast("long").alias("requested"),
    )


def index_seeds(seeds: DataFrame, order_col: str = "ord", max_ord: int | None = None) -> DataFrame:
    """Dense 0-based ``seed_idx`` in ``order_col`` order (distributed, see H1).
    Buckets of 4,096 consecutive ``ord`` values: a long run of one source stays split."""
    bucket = F.shiftright(F.col(order_col).cast("long"), 12)
    bound = None if max_ord is None else max_ord >> 12
    return global_index(seeds, [F.col(order_col)], bucket, out="seed_idx", key_bound=bound)


def _draw_key(seed, batch: str, j: str):
    return F.concat(F.lit(f"{seed}:"), F.col(batch).cast("string"), F.lit(":"), F.col(j).cast("string"))


def _first_distinct(draws: DataFrame, k: int) -> DataFrame:
    """Per batch, the first ``k`` distinct ``seed_idx`` in draw order, ranked 1..k."""
    first = draws.groupBy("batch_id", "seed_idx").agg(F.min("j").alias("_fj"))
    w = Window.partitionBy("batch_id").orderBy("_fj", "seed_idx")
    ranked = first.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("batch_id", F.col("rank").cast("long"), "seed_idx")


def sample_indices(
    plan: DataFrame, n_seeds: int, k: int = EXAMPLES_PER_CALL, seed: int | str = 42,
    draws_per_round: int = DRAWS_PER_ROUND,
) -> DataFrame:
    """``batch_id, rank, seed_idx``: ``min(k, n_seeds)`` distinct seeds per batch (L3).

    Exact: a batch that has fewer than ``min(k, n_seeds)`` distinct picks after
    a round (only likely when the pool is hardly larger than ``k``) draws another
    round, so no batch ever gets fewer examples than asked. One rule for every
    pool size. Each round's picks are
    checkpointed to the shared folder so the check does not recompute them.
    """
    kk = min(k, n_seeds)
    if kk <= 0:
        return plan.select("batch_id", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("seed_idx")).limit(0)
    draws = plan.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(draws_per_round - 1))).alias("j"))
    draws = draws.withColumn("seed_idx", hash_unit(_draw_key(seed, "batch_id", "j")) % F.lit(n_seeds))
    checkpoint_root(plan.sparkSession)
    picks = _first_distinct(draws, kk).checkpoint(eager=True)
    short = picks.groupBy("batch_id").count().where(F.col("count") < kk).select("batch_id")
    if short.isEmpty():
        return picks
    # Only the short batches draw again, with four times as many draws; the
    # draw sequence is the same hash sequence, continued.
    done = picks.join(short, "batch_id", "left_anti")
    again = sample_indices(plan.join(short, "batch_id", "left_semi"), n_seeds, k, seed, draws_per_round * 4)
    return done.unionByName(again)


def fewshot_sample(
    plan: DataFrame, seeds: DataFrame, k: int = EXAMPLES_PER_CALL, seed: int | str = 42,
    order_col: str = "ord", id_col: str = "text_id", keep_cols=(), n_seeds: int | None = None,
) -> DataFrame:
    """``batch_id, rank, <id_col>, *keep_cols``: the sampled examples of every batch (L3).

    Only ``(ord, id)`` goes through the index window; the pick table joins the
    index on ``seed_idx`` and, when texts are wanted, the seeds once more on
    ``ord``, so long texts are shuffled once. Both sides grow with the data,
    so AQE chooses the joins (no blind broadcast).
    """
    # One small aggregate to the driver: the pool size is the modulus of the
    # draws, the largest ord bounds the prefix-sum levels of the index.
    stats = seeds.agg(F.count(F.lit(1)).alias("n"), F.max(order_col).alias("m")).first()
    n_seeds = stats["n"] if n_seeds is None else n_seeds
    indexed = index_seeds(seeds.select(order_col, id_col), order_col, max_ord=stats["m"])
    picks = sample_indices(plan, n_seeds, k, seed).join(indexed, "seed_idx")
    if keep_cols:
        picks = picks.join(seeds.select(order_col, *keep_cols), order_col)
    return picks.select("batch_id", "rank", id_col, *keep_cols)


def lineage_lists(sample: DataFrame, id_col: str = "text_id") -> DataFrame:
    """``batch_id, derived_from``: example ids per batch in sample order.
    A group holds at most ``k`` rows, so ``collect_list`` is bounded."""
    g = sample.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("rank", id_col))).alias("_s"))
    return g.select("batch_id", F.transform("_s", lambda x: x[id_col]).alias("derived_from"))
