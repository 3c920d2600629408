"""Synthetic-pair production as one lazy Spark plan (section 3.1 of the survey).

seeds -> batch plan -> few-shot sample -> prompts  (what is sent to the model)
replies -> attempt status -> first good attempt -> pairs -> numbering ->
stop at target -> stamped records -> first-wins dedup   (what comes back)

The model call itself is outside: replies arrive as a table
``(batch_id, attempt, response_text, error)``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.constants import BATCH_SIZE, EXAMPLES_PER_CALL, ID_FORMAT_1X, SYNTHETIC_ORIGIN
from tandem.operators import dedup, metrics, prompts, replies, sampling
from tandem.session import ensure_conf
from tandem.sinks.writers import land


class SyntheticRun:
    """The parts of one production run, each built on first use.

    ``ingest_replies`` lands the parsed attempts and accepted pairs; the
    few-shot sample (and what depends on it: lineage, prompts, ``records``,
    ``final``) is computed only when one of these is read, so the reply-side
    reports never pay for it. Lineage samples ids only; texts are joined for
    the prompts alone."""

    def __init__(self, spark: SparkSession, seeds: DataFrame, total: int, n_seeds: int, k: int, seed):
        self.spark, self.seeds, self.total, self.n_seeds, self.k, self.seed = spark, seeds, total, n_seeds, k, seed
        self.plan = sampling.batch_plan(spark, total)
        self.n_batches = -(-total // BATCH_SIZE)
        self.attempts = self.pairs = None
        self.base, self.id_format, self.origin = 0, ID_FORMAT_1X, SYNTHETIC_ORIGIN
        self.records_obs = self.final_obs = None

    @cached_property
    def sample(self) -> DataFrame:
        return sampling.fewshot_sample(self.plan, self.seeds, k=self.k, seed=self.seed, n_seeds=self.n_seeds)

    @cached_property
    def lineage(self) -> DataFrame:
        return sampling.lineage_lists(self.sample)

    @cached_property
    def prompts(self) -> DataFrame:
        texts = self.seeds.select("text_id", "src_text", "tgt_text")
        return prompts.fewshot_prompts(self.sample.join(texts, "text_id"), self.plan)

    @cached_property
    def kept(self) -> DataFrame:
        """Accepted pairs, numbered from ``base + 1``, up to the target."""
        numbered = replies.number_pairs(self.pairs, base=self.base, n_batches=self.n_batches)
        return replies.stop_at_target(numbered, self.total)

    @cached_property
    def records(self) -> DataFrame:
        return replies.synthetic_records(self.kept, self.lineage, self.id_format, self.origin)

    @cached_property
    def final(self) -> DataFrame:
        """First-wins dedup of the records; lineage joins only what stays.

        Progress counts ride along (A8): after an action on this frame
        :func:`progress` reports them without another pass."""
        bare = replies.synthetic_records(self.kept, None, self.id_format, self.origin)
        bare, self.records_obs = metrics.observe_counts(bare, "generated")
        out = dedup.dedup_first_wins(bare, key_col="tgt_text", order_col="ord")
        out, self.final_obs = metrics.observe_counts(out, "saved")
        return out.drop("derived_from").join(self.lineage, "batch_id", "left").select(*bare.columns)


def plan_requests(
    spark: SparkSession,
    seeds: DataFrame,
    multiplier: int = 1,
    k: int = EXAMPLES_PER_CALL,
    seed: int | str = 42,
    total: int | None = None,
) -> SyntheticRun:
    """What goes to the model: batches, sampled examples, lineage lists, prompts."""
    n_seeds = seeds.count()
    if total is None:
        total = n_seeds * multiplier
    return SyntheticRun(spark, seeds, total, n_seeds, k, seed)


def ingest_replies(
    run: SyntheticRun,
    responses: DataFrame,
    id_format: str = ID_FORMAT_1X,
    origin: str = SYNTHETIC_ORIGIN,
    base: int = 0,
) -> SyntheticRun:
    """What comes back: classified attempts, accepted pairs, stamped records and
    the deduplicated final corpus. ``base`` = records already landed (resume)."""
    ensure_conf(responses.sparkSession)
    run.base, run.id_format, run.origin = base, id_format, origin
    # Parsed once and landed (inside classify_attempts): status and pairs read the files.
    run.attempts = replies.classify_attempts(responses)
    # The accepted pairs are landed too (the reference checkpoints them after
    # every batch): numbering reads them twice (bucket sizes, row numbers).
    run.pairs = land(replies.accepted_pairs(run.attempts), "accepted-pairs")
    return run


def progress(run: SyntheticRun) -> dict:
    """Counts the reference prints (requested, generated, removed, saved), read
    from the observations of the last action on ``run.final``. Raises while
    ``run.final`` has not been built."""
    if run.final_obs is None:
        raise RuntimeError("run an action on run.final first")
    gen = run.records_obs.get.get("rows", 0)
    saved = run.final_obs.get.get("rows", 0)
    return {"requested": run.total, "generated": gen, "removed": gen - saved, "saved": saved}


def finalize_from_landed(
    run: SyntheticRun,
    landed: DataFrame,
    id_format: str = ID_FORMAT_1X,
    origin: str = SYNTHETIC_ORIGIN,
    base: int = 0,
    bootstrap: DataFrame | None = None,
) -> SyntheticRun:
    """Batch finalize over pairs a stream has landed (I3): ``landed`` holds
    ``batch_id, attempt, pos, src, tgt`` of good attempts. The first landed
    attempt of every batch is used (partial aggregation + join on the batch,
    whose partitions the removal of repeated rows keeps: one shuffle of texts), then the same numbering, target stop, stamping and first-wins dedup as
    :func:`ingest_replies`.

    ``bootstrap`` (I4, ``resume.read_bootstrap``) holds records that an earlier
    run had numbered: they keep their ids and come first, their batches are not
    taken from ``landed`` again, and numbering goes on after them."""
    run.base, run.id_format, run.origin = base, id_format, origin
    first = landed.groupBy("batch_id").agg(F.min("attempt").alias("_first"))
    if bootstrap is not None:
        first = first.join(bootstrap.select("batch_id").distinct(), "batch_id", "left_anti")
        run.base = base + (bootstrap.agg(F.max("n")).first()[0] or 0)
    # "<=" keeps the attempt out of the join's keys, so that the batch alone deals the rows
    pairs = landed.join(first.hint("shuffle_hash"), "batch_id").where(F.col("attempt") <= F.col("_first")).select("batch_id", "pos", "src", "tgt")
    run.pairs = land(pairs.dropDuplicates(["batch_id", "pos"]), "finalize-pairs")
    if bootstrap is not None:
        run.kept = run.kept.unionByName(bootstrap.select("batch_id", "pos", "src", "tgt", "n"))
    return run


def shortfall(run: SyntheticRun) -> DataFrame:
    """Requested vs delivered per batch."""
    from tandem.operators.metrics import batch_delivery

    return batch_delivery(run.plan, run.pairs, n_batches=run.n_batches)


def pending_batches(plan: DataFrame, landed: DataFrame, batch_col: str = "seed_group") -> DataFrame:
    """Batches of the plan with nothing landed yet (F5, I4). Keyed by batch, so a
    partly failed run is topped up batch by batch (deliberate: the reference
    restarts from ``floor(len/30)``). ``seed_group`` counts from 1, any other
    column is the batch id itself."""
    done = F.col(batch_col) - 1 if batch_col == "seed_group" else F.col(batch_col)
    return plan.join(landed.select(done.cast("long").alias("batch_id")).distinct(), "batch_id", "left_anti")
