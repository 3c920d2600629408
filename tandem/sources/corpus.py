"""Corpus readers (S1-S6). Always an explicit schema; ``ord`` keeps file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.schema import COMBINED_CORPUS, PAIR, PAIR_JSON, PAIR_JSON_FIELDS, RESPONSE
from tandem.session import exists

# Quoted records with "" escapes, edge blanks kept, null told apart from "".
CSV_EXACT = {
    "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N", "emptyValue": "", "lineSep": "\n",
}


def to_pair_schema(df: DataFrame) -> DataFrame:
    """Rename the published JSON field names onto the pair schema; absent fields
    become typed nulls, extra fields are dropped (S3)."""
    cols = []
    names = set(df.columns)
    for src, dst in PAIR_JSON_FIELDS:
        typ = PAIR[dst].dataType
        cols.append((F.col(src).cast(typ) if src in names else F.lit(None).cast(typ)).alias(dst))
    extra = [c for c in ("ord",) if c in names]
    return df.select(*extra, *cols)


def _with_file_index(df: DataFrame, file_col: str = "_f") -> DataFrame:
    """Add ``_fi`` = rank of the file path. The window runs over the distinct
    file names only (one row per file, as in the driver's listing), which are
    broadcast: joined by a shuffle, all rows of a large file met in one task."""
    from pyspark.sql import Window

    files = df.select(file_col).distinct()
    files = files.select(file_col, (F.row_number().over(Window.orderBy(file_col)) - 1).cast("long").alias("_fi"))
    return df.join(F.broadcast(files), file_col)


def read_json_array_corpus(spark: SparkSession, path: str, schema: T.StructType = PAIR_JSON) -> DataFrame:
    """Read files that each hold one JSON array of records (S1, S2), many tasks to a file.

    Records are cut by byte ranges (:mod:`tandem.sources.json_array`); ``ord`` =
    rank of (file path, position in the file). A blank file (such as a 2-byte
    CRLF stub) yields no rows; any other file that is not one JSON array of
    records is an error.
    """
    from tandem.sources.json_array import parse_records, read_records

    return to_pair_schema(_file_ordered(parse_records(read_records(spark, path), schema)))


def _file_ordered(df: DataFrame) -> DataFrame:
    """Add dense ``ord`` in file order to rows with ``_f`` (path), ``_s`` (split start)
    and ``_m`` (position in the task): rows of one split stay contiguous and in
    order inside a task. One bucket per (file, split)."""
    from tandem.operators.ranking import global_index

    df = _with_file_index(df)
    bucket = F.shiftleft(F.col("_fi"), 40) + F.shiftright(F.col("_s"), 8)
    df = global_index(df, [F.col("_fi"), F.col("_s"), F.col("_m")], bucket, out="ord")
    return df.drop("_f", "_fi", "_s", "_m")


def _with_place(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_s"),
        F.monotonically_increasing_id().alias("_m"),
    )


def read_json_lines_corpus(spark: SparkSession, path: str, schema: T.StructType = PAIR_JSON) -> DataFrame:
    """Read JSON Lines records (splittable) with ``ord`` in file order.
    A line that is not a record is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return to_pair_schema(_file_ordered(_with_place(df)))


def read_combined_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The 4-column combined corpus with ``ord`` in file order and the pair defaults
    filled in (S6). A CSV file holds multi-line records, so it is read by one task."""
    reader = spark.read.schema(COMBINED_CORPUS)
    if fmt == "csv":
        df = reader.options(**CSV_EXACT).option("header", "true").option("multiLine", "true").option("mode", "FAILFAST").csv(path)
    else:
        df = reader.format(fmt).load(path)
    return _file_ordered(_with_place(df)).select(
        "ord",
        "text_id",
        F.col("luganda").alias("src_text"),
        F.col("english").alias("tgt_text"),
        F.col("dataset_origin").alias("origin"),
        F.lit(False).alias("is_synthetic"),
        F.lit(None).cast(T.ArrayType(T.StringType())).alias("derived_from"),
        F.lit(None).cast("long").alias("seed_group"),
    )


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Previously landed rows, or an empty frame of the same schema when the
    folder does not exist yet (S4)."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw replies ``(batch_id, attempt, response_text, error)``."""
    return spark.read.schema(RESPONSE).format(fmt).load(path)
