"""Explicit schemas. Never infer: an all-null lineage column infers as string."""

from pyspark.sql import types as T

# Column names used by the operators; every operator also takes them as arguments.
TEXT_ID = "text_id"
SRC = "src_text"
TGT = "tgt_text"
ORIGIN = "origin"
ORD = "ord"

PAIR = T.StructType(
    [
        T.StructField("text_id", T.StringType()),
        T.StructField("src_text", T.StringType()),
        T.StructField("tgt_text", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("is_synthetic", T.BooleanType()),
        T.StructField("derived_from", T.ArrayType(T.StringType())),
        T.StructField("seed_group", T.LongType()),
    ]
)

# The published JSON field names of a pair record, mapped onto PAIR.
PAIR_JSON_FIELDS = (
    ("text_id", "text_id"),
    ("luganda", "src_text"),
    ("english", "tgt_text"),
    ("dataset_origin", "origin"),
    ("is_synthetic", "is_synthetic"),
    ("derived_from", "derived_from"),
    ("seed_group", "seed_group"),
)

PAIR_JSON = T.StructType(
    [
        T.StructField("text_id", T.StringType()),
        T.StructField("luganda", T.StringType()),
        T.StructField("english", T.StringType()),
        T.StructField("dataset_origin", T.StringType()),
        T.StructField("is_synthetic", T.BooleanType()),
        T.StructField("derived_from", T.ArrayType(T.StringType())),
        T.StructField("seed_group", T.LongType()),
    ]
)

COMBINED_CORPUS = T.StructType(
    [
        T.StructField("dataset_origin", T.StringType()),
        T.StructField("text_id", T.StringType()),
        T.StructField("english", T.StringType()),
        T.StructField("luganda", T.StringType()),
    ]
)

SCORED_JSON = T.StructType(
    PAIR_JSON.fields
    + [
        T.StructField("hypothesis", T.StringType()),
        T.StructField("comet", T.DoubleType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("response_text", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

RUN_PARAMS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("parent_run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

RUN_METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

TRAIN_HISTORY = T.StructType(
    [
        T.StructField("condition", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("eval_loss", T.DoubleType()),
    ]
)

CONDITION_SUMMARY = T.StructType(
    [
        T.StructField("condition", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("comet_mean", T.DoubleType()),
        T.StructField("examples", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)
