"""Reply ingestion: attempt status, first good attempt, pairs, numbering, stop at target
(F2, F3, W3, R1, P8, W1, L4, N2).

No step collects a batch into one task: the first success per batch is a
partial aggregation, and numbering buckets split long batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.constants import MAX_ATTEMPTS, SYNTHETIC_ORIGIN
from tandem.functions.replies import with_reply_pairs
from tandem.functions.text import format_id
from tandem.operators.ranking import global_index
from tandem.sinks.writers import land

STATUS_OK = "ok"
STATUS_PARSE = "parse_error"
STATUS_API = "api_error"


def parse_attempts(responses: DataFrame) -> DataFrame:
    """One row per attempt with ``status``, ``n_valid`` and the parsed ``pairs``.

    Service errors and missing text are ``api_error``; text that is not one
    JSON array, or an array without a single valid pair, is ``parse_error``.
    Narrow: no shuffle.
    """
    a = with_reply_pairs(responses, "response_text", "_parsed")
    a = a.withColumn("pairs", F.when(F.col("error").isNull(), F.col("_parsed"))).drop("_parsed")
    status = (
        F.when(F.col("error").isNotNull() | F.col("response_text").isNull(), F.lit(STATUS_API))
        .when(F.col("pairs").isNull() | (F.size("pairs") == 0), F.lit(STATUS_PARSE))
        .otherwise(F.lit(STATUS_OK))
    )
    return a.withColumn("status", status).withColumn(
        "n_valid", F.coalesce(F.size("pairs"), F.lit(0)).cast("long")
    )


def mark_used(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Add ``used``: the first ``ok`` attempt within the budget of every batch.
    Attempts after the first success or past the budget are never used.

    The first success per batch is a partial aggregation (combined map-side,
    so a batch with a huge number of attempts is no single-task group), joined
    back on ``batch_id``.
    """
    eligible = (F.col("status") == STATUS_OK) & (F.col("attempt") <= max_attempts)
    first = attempts.where(eligible).groupBy("batch_id").agg(F.min("attempt").alias("_first_ok"))
    j = attempts.join(first, "batch_id", "left")
    return j.withColumn("used", F.coalesce(F.col("attempt") == F.col("_first_ok"), F.lit(False))).drop("_first_ok")


def classify_attempts(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS, land_as: str | None = "attempts") -> DataFrame:
    """Parsed attempts with ``status``, ``n_valid``, ``pairs`` and ``used``.

    The parse is landed (``land_as``; Parquet under the shared checkpoint
    folder) before ``used`` is derived, so the parse runs once although both
    sides of the first-success join read it. ``land_as=None`` keeps it lazy.
    The raw reply is not carried along, and an attempt that was delivered
    twice counts once: told before the parse, where the replies of a batch may
    still lie together, so no shuffle is added for it.
    """
    parsed = parse_attempts(responses.dropDuplicates(["batch_id", "attempt"])).drop("response_text")
    if land_as:
        parsed = land(parsed, land_as)
    return mark_used(parsed, max_attempts)


def batch_status(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, plan: DataFrame | None = None) -> DataFrame:
    """Per batch: ``ok`` (a used attempt), ``exhausted`` (budget spent, skipped) or
    ``pending`` (fewer failed attempts than the budget: resume retries it).
    With ``plan``, its batches without any attempt are ``pending`` too."""
    g = attempts.groupBy("batch_id").agg(
        F.max(F.col("used").cast("int")).alias("_u"),
        F.count_if(F.col("attempt") <= max_attempts).alias("_n"),
    )
    if plan is not None:
        g = plan.select("batch_id").join(g, "batch_id", "left")
    return g.select(
        "batch_id",
        F.when(F.col("_u") == 1, F.lit("ok"))
        .when(F.col("_n") >= max_attempts, F.lit("exhausted"))
        .otherwise(F.lit("pending"))
        .alias("status"),
    )


def accepted_pairs(attempts: DataFrame) -> DataFrame:
    """``batch_id, pos, src, tgt`` of the used attempt of every batch."""
    used = attempts.where(F.col("used")).select("batch_id", F.explode("pairs").alias("p"))
    return used.select("batch_id", F.col("p.pos").cast("long").alias("pos"), "p.src", "p.tgt")


def number_pairs(pairs: DataFrame, base: int | Column = 0, out: str = "n", n_batches: int | None = None) -> DataFrame:
    """Running counter over ``(batch_id, pos)`` starting at ``base + 1``.

    Distributed: buckets are blocks of a batch, offsets a prefix sum over bucket sizes.
    """
    # (batch, block of 4,096 positions): monotone in (batch_id, pos), and even a
    # reply with millions of pairs is split over many buckets.
    bucket = F.shiftleft(F.col("batch_id").cast("long"), 20) + F.least(F.shiftright(F.col("pos"), 12), F.lit((1 << 20) - 1))
    return global_index(pairs, [F.col("batch_id"), F.col("pos")], bucket,
                        out=out, base=base if isinstance(base, Column) else base + 1,
                        key_bound=None if n_batches is None else n_batches << 20)


def stop_at_target(numbered: DataFrame, total: int | Column, n_col: str = "n") -> DataFrame:
    """Accept pairs in order until ``total`` (L4); over-delivery within a batch counts."""
    t = total if isinstance(total, Column) else F.lit(total)
    return numbered.where(F.col(n_col) <= t)


def synthetic_records(
    numbered: DataFrame,
    lineage: DataFrame | None,
    id_format,
    origin: str = SYNTHETIC_ORIGIN,
    n_col: str = "n",
) -> DataFrame:
    """Stamp pairs as synthetic records in the pair schema.

    ``id_format`` is a printf format (``gem5_s%06d``) or a callable taking the
    counter Column and returning the id Column (U1).

    ``lineage``: ``batch_id, derived_from`` (ordered example ids per batch).
    Joined on ``batch_id``; both sides grow with the batch count, so the join
    strategy is left to AQE (it broadcasts only when the runtime size allows).
    """
    d = numbered
    if lineage is not None:
        d = d.join(lineage, "batch_id", "left")
    else:
        d = d.withColumn("derived_from", F.lit(None).cast("array<string>"))
    return d.select(
        (id_format(F.col(n_col)) if callable(id_format) else format_id(id_format, F.col(n_col))).alias("text_id"),
        F.col("src").alias("src_text"),
        F.col("tgt").alias("tgt_text"),
        F.lit(origin).alias("origin"),
        F.lit(True).alias("is_synthetic"),
        F.col("derived_from"),
        (F.col("batch_id") + 1).cast("long").alias("seed_group"),
        F.col(n_col).alias("ord"),
        F.col("batch_id"),
    )
