"""Packing documents into sequences of power-of-two lengths.

A document's ids (with its end id) are cut into as many whole sequences of
``size`` ids as they hold and then into the binary decomposition of the rest,
longest piece first. Every piece is a sequence of its own, so no sequence
crosses documents and none is padded; pieces of equal length lie in one bucket
(one folder of the written table), from which batches of equal shape are read.

Sequences are numbered without gaps, shortest bucket first; inside a bucket by
the partition and position in which they were written. Results by case: null
text counts as empty (the end id alone: one sequence of length 1); rows that
repeat, share an id or have a null id are packed one by one; other columns are
not read; no rows give no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm import textops as tx
from tandem.llm.wavelet import library_cache

SIZE = 1024
_ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length int, doc_tokens long, part int, rank long, ids binary"


def decompose(tokens: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of every piece of documents of these many ids, in order."""
    widths = size >> np.arange(size.bit_length())
    times = tokens[:, None] // widths & 1
    times[:, 0] = tokens // size
    length = np.repeat(np.tile(widths, len(tokens)), times.ravel())
    doc = np.repeat(np.arange(len(tokens)), times.sum(axis=1))
    ends = np.cumsum(length)
    start = ends - length - (np.cumsum(tokens) - tokens)[doc]
    return doc, start, length


def write_sequences(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts with the tokenizers library and write their sequences as Parquet, one folder per length.

    One narrow pass over the documents, about 1 MB of text (or one document) at a time.
    """
    if size < 1 or size & (size - 1):
        raise ValueError(f"the sequence size must be a power of two, not {size}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(tokenizer_path)
        part = TaskContext.get().partitionId()
        written = np.zeros(size.bit_length(), dtype=np.int64)  # sequences so far, by log2 of the length
        for batch in batches:
            buf, offs = tx.buffers(batch.column(1))
            for i, j, data, cuts in tx.slices(buf, offs):
                flat, ends = tx.encode_documents(data, cuts, cache, special)
                flat = np.insert(flat, ends[1:], np.uint32(end_id))
                tokens = np.diff(ends) + 1
                doc, start, length = decompose(tokens, size)
                power = np.bitwise_count((length - 1).astype(np.uint64)).astype(np.int64)
                rank = np.empty(len(length), dtype=np.int64)
                for p in np.unique(power).tolist():
                    of = np.flatnonzero(power == p)
                    rank[of] = written[p] + np.arange(len(of))
                    written[p] += len(of)
                at = np.concatenate([[0], np.cumsum(4 * length)])
                ids = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length.astype(np.int32)), pa.array(tokens[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank), ids.cast(pa.binary())],
                    schema=_ROW,
                )

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d.mapInArrow(run, _DDL).write.option("compression", "zstd").partitionBy("length").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset (0: a sequence is one piece) and ids (little-endian u32).

    Broadcasts one first number per (length, written partition): at most
    log2(size) + 1 rows for every task of the write.
    """
    rows = spark.read.schema(_DDL).parquet(path)
    before = W.orderBy("length", "part").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = rows.join(F.broadcast(first), ["length", "part"])
    return numbered.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
