"""Crash-resumable reply ingestion with Structured Streaming.

Replies land as files in a folder; a file-source stream with a checkpoint
processes each file once, so a re-run after a crash continues with the files
it has not seen. Pairs are deduplicated by normalized target in streaming
state (I2). That state lies in RocksDB on the executors' disks; it is unbounded, like the reference's in-memory seen-set:
there is no event time to age keys out. Which duplicate survives depends on
arrival order, so the batch finalize step (numbering, stop at target,
first-wins dedup -- ``tandem.plans.synthetic``) stays the authority (I3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.constants import MAX_ATTEMPTS
from tandem.functions.replies import with_reply_pairs
from tandem.functions.text import norm_key
from tandem.schema import RESPONSE
from tandem.session import ensure_conf, state_conf
from tandem.sinks.writers import write_epoch
from tandem.sources.corpus import read_landed


def reply_stream(spark: SparkSession, replies_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming pairs ``batch_id, attempt, pos, src, tgt, key`` from reply files."""
    ensure_conf(spark)
    reader = spark.readStream.schema(RESPONSE)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(replies_dir)
    ok = raw.where(F.col("error").isNull() & (F.col("attempt") <= MAX_ATTEMPTS))
    parsed = with_reply_pairs(ok, "response_text", "_pairs")
    # not ``explode``: Catalyst would filter its input by the pairs' size below the parse, which
    # puts the whole parse, inlined many times over, into that filter
    pairs = parsed.select("batch_id", "attempt", F.explode_outer("_pairs").alias("p")).where(F.col("p").isNotNull())
    return pairs.select(
        "batch_id", "attempt", F.col("p.pos").cast("long").alias("pos"),
        F.col("p.src").alias("src"), F.col("p.tgt").alias("tgt"),
        F.md5(norm_key(F.col("p.tgt"))).alias("key"),
    )


PAIRS = "batch_id long, attempt int, pos long, src string, tgt string, key string"
PROGRESS = "batch_id long, attempt int, got long"


def run_until_caught_up(spark: SparkSession, replies_dir: str, sink_dir: str, checkpoint_dir: str,
                        max_files_per_trigger: int | None = None, dedup: bool = True,
                        progress_dir: str | None = None) -> None:
    """Process every reply file not yet seen, then stop (``availableNow``).

    Files per micro-batch are unlimited unless the caller says otherwise. Safe to call again after a crash
    or when more files arrive: the checkpoint records what is done (I1). With
    ``dedup`` the stream keeps one pair per normalized target in its state (I2;
    RocksDB, see :func:`tandem.session.state_conf`);
    without it the sink holds every pair of every good attempt, which is what
    the batch finalize step numbers (I3).

    Each micro-batch lands in a folder of its own (:func:`read_pairs` reads
    them), replaced if the micro-batch is run again (K4). With ``progress_dir``
    it also leaves how many pairs each batch and attempt gave (A8), counted
    from the landed rows, so the parse does not run twice.
    """
    pairs = reply_stream(spark, replies_dir, max_files_per_trigger)
    if dedup:
        state_conf(spark)
        pairs = pairs.dropDuplicates(["key"])

    def land_epoch(rows: DataFrame, epoch: int) -> None:
        write_epoch(rows, sink_dir, epoch)
        if progress_dir is not None:
            landed = rows.sparkSession.read.schema(PAIRS).parquet(f"{sink_dir.rstrip('/')}/epoch={epoch}")
            got = landed.groupBy("batch_id", "attempt").agg(F.count(F.lit(1)).alias("got"))
            write_epoch(got, progress_dir, epoch)

    q = (
        pairs.writeStream.foreachBatch(land_epoch)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_landed(spark, path, T._parse_datatype_string(schema + ", epoch long"))


def read_pairs(spark: SparkSession, sink_dir: str) -> DataFrame:
    """``batch_id, attempt, pos, src, tgt, key, epoch`` of all landed micro-batches; none before the first."""
    return _read_epochs(spark, sink_dir, PAIRS)


def batch_progress(spark: SparkSession, progress_dir: str, plan: DataFrame) -> DataFrame:
    """``batch_id, requested, epoch, attempt, got``: what every batch of the plan asked for and what
    each of its attempts gave in which micro-batch (A8). A batch that gave nothing yet
    has one row with nulls and ``got`` = 0."""
    got = _read_epochs(spark, progress_dir, PROGRESS)
    joined = plan.join(got, "batch_id", "left")
    return joined.select("batch_id", F.col("requested").cast("long").alias("requested"), "epoch",
                         F.col("attempt").cast("long").alias("attempt"), F.coalesce("got", F.lit(0)).alias("got"))


def landed_batches(spark: SparkSession, sink_dir: str, bootstrap_dir: str | None = None) -> DataFrame:
    """Batch ids with landed pairs, streamed or bootstrapped (input for the pending check, F5)."""
    done = read_pairs(spark, sink_dir).select("batch_id")
    if bootstrap_dir is not None:
        done = done.unionByName(read_bootstrap(spark, bootstrap_dir).select("batch_id"))
    return done.distinct()


def bootstrap_from_partial(partial: DataFrame, bootstrap_dir: str) -> None:
    """Land a partial output written before streaming was used (I4) as a table of
    its own (a stream's sink folder lists only the stream's files).

    Every record keeps the number in its id and its batch; its position is its
    rank in the batch. :func:`tandem.plans.synthetic.finalize_from_landed` puts
    these records first and goes on numbering after them."""
    n = F.regexp_extract("text_id", r"_s([0-9]+)$", 1).cast("long")
    rows = partial.select((F.col("seed_group") - 1).cast("long").alias("batch_id"), n.alias("n"),
                          F.col("src_text").alias("src"), F.col("tgt_text").alias("tgt"))
    first = rows.groupBy("batch_id").agg(F.min("n").alias("_first"))
    rows = rows.join(first, "batch_id").withColumn("pos", F.col("n") - F.col("_first")).drop("_first")
    rows.withColumn("attempt", F.lit(1)).write.mode("append").parquet(bootstrap_dir)


def read_bootstrap(spark: SparkSession, bootstrap_dir: str) -> DataFrame:
    """``batch_id, n, src, tgt, pos, attempt`` of the bootstrapped records."""
    return spark.read.schema("batch_id long, n long, src string, tgt string, pos long, attempt int").parquet(bootstrap_dir)
