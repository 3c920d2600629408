"""Corpus and result writers (K1, K2, K4, K9)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.schema import PAIR_JSON_FIELDS
from tandem.session import landing_path


ARRAY_BYTES = 256 << 20  # of one JSON array, which one task writes


def to_json_field_names(df: DataFrame) -> DataFrame:
    """Pair schema -> the published JSON field names, in the published order."""
    return df.select(*[F.col(dst).alias(src) for src, dst in PAIR_JSON_FIELDS])


def write_corpus_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON Lines, non-ASCII kept, null fields written as ``null`` (K1).

    Spark's default drops null fields, so ``ignoreNullFields=false``. JSON
    Lines rather than one array: an array file would be a single-task write.
    """
    to_json_field_names(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One JSON array of a task's records: a bracket, the records with a comma before all but the first, a bracket."""
    line = lambda values: pa.RecordBatch.from_arrays([values.cast(pa.string())], names=["line"])
    yield line(pa.array(["["]))
    begun = False
    for batch in batches:
        records = batch.column(0)
        if not begun and len(records):
            yield line(records.slice(0, 1))
            records, begun = records.slice(1), True
        yield line(pc.binary_join_element_wise("", records.cast(pa.string()), ","))
    yield line(pa.array(["]"]))


def write_json_arrays(df: DataFrame, path: str, order_col: str = "ord", array_bytes: int = ARRAY_BYTES) -> int:
    """JSON arrays in ``order_col`` order, one per file, records in the order of the files' names; returns how many.

    A file has one writer, so the arrays grow in number, not in size: about
    ``array_bytes`` each, by ranges of ``order_col`` with even row counts.
    """
    records = df.select(order_col, F.to_json(F.struct(*[F.col(dst).alias(src) for src, dst in PAIR_JSON_FIELDS])).alias("line"))
    size = records.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    n = max(1, -(-size // array_bytes))
    dealt = records.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
    dealt.select("line").mapInArrow(_array_lines, "line string").write.text(path)
    return n


def write_results_jsonl(df: DataFrame, path: str, score_col: str | None = "score", mode: str = "overwrite",
                        decimals: int = 10) -> None:
    """Per-row results: every pair field + ``hypothesis`` (+ score, <= 10 decimals) (K2)."""
    cols = [F.col(dst).alias(src) for src, dst in PAIR_JSON_FIELDS] + [F.col("hypothesis")]
    if score_col is not None:
        cols.append(F.round(F.col(score_col), decimals).alias("comet"))
    df.select(*cols).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_batches(df: DataFrame, path: str, batch_col: str = "batch_id") -> None:
    """Progress after every batch (K4): partitioned by batch with dynamic partition
    overwrite, so re-running a batch replaces only its own folder."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch_col)
        .parquet(path)
    )


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """One micro-batch of a stream under ``path/epoch=<epoch>`` (K4). The folder is
    replaced as a whole, so a micro-batch that is run again after a crash writes
    the same rows once more and never doubles them -- also where it now has fewer."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={int(epoch)}")


def write_text_artifact(lines: DataFrame, path: str, order_col: str = "line_no", text_col: str = "line") -> None:
    """A short text artifact such as the summary table (K9). A handful of rows,
    so one output file is fine here (and only here)."""
    lines.orderBy(order_col).select(text_col).coalesce(1).write.mode("overwrite").text(path)


def land(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (K3).

    Cuts lineage: later actions read the files and never recompute the input
    (a model, a parse), and a lost executor costs only the re-read of its files.
    """
    spark = df.sparkSession
    path = path or landing_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_combined_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The 4-column combined corpus (``dataset_origin, text_id, english, luganda``) as
    CSV with a header; every text is quoted, quotes doubled, edge blanks kept,
    null written apart from the empty text."""
    from tandem.sources.corpus import CSV_EXACT

    out = df.select(
        F.col("origin").alias("dataset_origin"), "text_id",
        F.col("tgt_text").alias("english"), F.col("src_text").alias("luganda"),
    )
    out.write.mode(mode).options(**CSV_EXACT).option("header", "true").option("quoteAll", "true").csv(path)
