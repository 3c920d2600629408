"""Bindings of the pair / reply / score model onto the driver's tables.

Every binding is a lazy DataFrame over the given Parquet tables, so the work
of every query grows with them. Definitions follow FIXTURES.md section 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.constants import BATCH_SIZE
from tandem.functions.text import first_line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def docs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as human pairs: source = first line, target = whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("long").alias("ord"),
        F.format_string("%s_s%05d", F.col("source"), F.col("doc_id")).alias("text_id"),
        first_line(F.col("text")).alias("src_text"),
        F.col("text").alias("tgt_text"),
        F.col("source").alias("origin"),
        F.lit(False).alias("is_synthetic"),
        F.lit(None).cast(T.ArrayType(T.StringType())).alias("derived_from"),
        F.lit(None).cast("long").alias("seed_group"),
    )


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it, as a pair.

    An equi-join on ``(conv_id, turn)``: both columns are hash keys, so a very
    long conversation spreads over many tasks (a window per conversation would not).
    ``ord`` orders by (conv_id, turn); it is an order key, not a dense index.
    """
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("src_text")
    )
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("u_turn"), F.col("text").alias("tgt_text")
    )
    p = u.join(a, ["conv_id", "u_turn"])
    return p.select(
        (F.shiftleft(F.col("conv_id").cast("long"), 31) + F.col("u_turn")).alias("ord"),
        F.format_string("conv_s%05d_%02d", F.col("conv_id"), F.col("u_turn")).alias("text_id"),
        "src_text",
        "tgt_text",
        F.concat(F.lit("origin"), (F.col("conv_id") % 4).cast("string")).alias("origin"),
        F.lit(False).alias("is_synthetic"),
        F.lit(None).cast(T.ArrayType(T.StringType())).alias("derived_from"),
        F.lit(None).cast("long").alias("seed_group"),
    )


# Model keys named by a system column (the last one is deliberately unknown).
SYSTEM_MODELS = ("llama3", "mistral", "aya", "gemma", "nllb")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows of four systems; ``sys0`` is the baseline."""
    e = table(spark, sf_dir, "events")
    models = F.array(*[F.lit(m) for m in SYSTEM_MODELS])
    return e.select(
        F.concat(F.lit("sys"), (F.col("user_id") % 4).cast("string")).alias("system"),
        F.col("event_type").alias("origin"),
        F.col("value").alias("score"),
        F.col("event_id").alias("row_id"),
        F.col("user_id"),
        F.col("ts"),
        F.element_at(models, (F.col("user_id") % 5 + 1).cast("int")).alias("model"),
    )


def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per condition (event type) one evaluation per day: epoch = day rank, loss = mean value."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    daily = e.groupBy(F.col("event_type").alias("condition"), F.to_date("ts").alias("day")).agg(
        F.round(F.avg("value"), 6).alias("eval_loss")
    )
    w = Window.partitionBy("condition").orderBy("day")
    return daily.select(
        "condition", F.dense_rank().over(w).cast("int").alias("epoch"), "eval_loss"
    )


# --- replies -------------------------------------------------------------
# Fault rules of the reply fixture, as (name, predicate on batch_id):
#   fenced     batch_id % 5 = 0    reply wrapped in a ```json fence
#   retry      batch_id % 7 = 3    attempt 1 malformed, attempt 2 good
#   exhausted  batch_id % 11 = 10  five malformed attempts
#   missing    batch_id % 13 = 5   element 0 lacks "luganda"
#   api_error  batch_id % 17 = 8   attempt 1 is a service error, attempt 2 good
# Replies carry the whole texts (no prefix cut), so parsing works on full-size replies.


def reply_batches(pairs: DataFrame, batch_size: int = BATCH_SIZE, parts: int | None = None) -> DataFrame:
    """One row per batch with the array of the batch's pairs, in ``ord`` order; dealt to ``parts`` tasks if given."""
    b = pairs.select(
        F.expr(f"ord div {int(batch_size)}").cast("long").alias("batch_id"),
        F.col("ord"),
        F.col("tgt_text").alias("english"),
        F.col("src_text").alias("luganda"),
    )
    b = b.withColumn("_pos", F.col("ord") - F.col("batch_id") * batch_size)
    if parts is not None:
        b = b.repartition(parts, "batch_id")  # the aggregation needs no shuffle of its own
    # A batch holds at most batch_size rows, so collecting it is bounded.
    agg = b.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "english", "luganda"))).alias("items")
    )
    return agg


def several_attempts(bid: Column) -> Column:
    """Whether the fault rules give a batch more than one attempt."""
    return (bid % 11 == 10) | (bid % 7 == 3) | (bid % 17 == 8)


def responses(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Raw model replies ``(batch_id, attempt, response_text, error)`` rendered from docs_pairs, by ``parts`` tasks if given."""
    if pairs is None:
        from tandem.sources.bindings import docs_pairs as _dp

        pairs = _dp(spark, sf_dir)
    agg = reply_batches(pairs, parts=parts)
    bid = F.col("batch_id")
    items = F.expr(
        "transform(items, (x, i) -> named_struct('english', x.english, 'luganda', "
        "CASE WHEN batch_id % 13 = 5 AND i = 0 THEN CAST(NULL AS STRING) ELSE x.luganda END))"
    )
    # The batch's JSON is rendered once; the fault variants derive from it.
    j = agg.select("batch_id", F.to_json(items).alias("_json"))
    good = F.when(bid % 5 == 0, F.concat(F.lit("```json\n"), F.col("_json"), F.lit("\n```"))).otherwise(F.col("_json"))
    malformed = F.left(F.col("_json"), F.greatest(F.floor(F.length("_json") / 2), F.lit(1)).cast("int"))
    exhausted = bid % 11 == 10
    retry = (bid % 7 == 3) & ~exhausted
    api = (bid % 17 == 8) & ~exhausted & ~retry
    attempts = (
        F.when(exhausted, F.array(*[F.lit(i) for i in range(1, 6)]))
        .when(retry | api, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array(F.lit(1)))
    )
    rows = j.select(
        "batch_id", F.explode(attempts).alias("attempt"), good.alias("_good"), malformed.alias("_bad"),
        exhausted.alias("_ex"), retry.alias("_rt"), api.alias("_api"),
    )
    is_bad = F.col("_ex") | (F.col("_rt") & (F.col("attempt") == 1))
    is_api = F.col("_api") & (F.col("attempt") == 1)
    return rows.select(
        "batch_id",
        F.col("attempt").cast("int").alias("attempt"),
        F.when(is_api, F.lit(None).cast("string")).when(is_bad, F.col("_bad")).otherwise(F.col("_good")).alias("response_text"),
        F.when(is_api, F.lit("503 UNAVAILABLE")).alias("error"),
    )


def edge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, response_text``: one reply per document, its kind by ``doc_id % 16``;
    ``x`` is the whole document as a JSON string."""
    d = docs_pairs(spark, sf_dir).select(
        F.col("ord").alias("doc_id"), F.to_json(F.struct(F.coalesce("tgt_text", F.lit("")).alias("s"))).alias("_j"),
    )
    d = d.select("doc_id", F.expr("substr(_j, 6, length(_j) - 6)").alias("x"))
    kinds = [
        """concat('[{"luganda": ', x, ', "english": "e"}]')""",
        """concat('[{"luganda": "first", "luganda": ', x, ', "english": 7}]')""",
        """'[{"luganda": true, "english": null}]'""",
        """concat('[1, "s", {"luganda": ', x, ', "english": 1.50}]')""",
        """concat('[{"luganda": ', x, '}]')""",
        """'[{"luganda": "  pad\\\\u00a0", "english": "\\\\ttab"}]'""",
        """concat('[{"luganda": ', x, ', "english": "e"}],"§"] trailing')""",
        """concat('{"luganda": ', x, ', "english": "e"}')""",
        """concat('[{"luganda": ', x, ', "english": 1.0}]')""",
        """concat('[{"luganda": ', x, ', "english": 1e16}]')""",
        """concat('\u00a0```json\n[{"luganda": ', x, ', "english": 2.5e-7}, {"english": 1}]\n```\t')""",
        """'null'""",
        """concat('[{"luganda": ', x, ', "english": {"b": [1, 2.50, null, true], "a": "it\\'s", "b2": {}, "a": false}}]')""",
        """concat('[{"luganda": ', x, ', "english": ["say \\\\"hi\\\\"", "both \\' and \\\\"", "tab\\\\t", "\\\\u00e9"]}]')""",
        """concat('[{"luganda": ', x, ', "english": 1234567890123456789012345678901234567890}]')""",
        """concat('[{"luganda": ', x, ', "english": -Infinity}, {"luganda": "l", "english": NaN}]')""",
    ]
    return d.select("doc_id", F.element_at(F.array(*[F.expr(k) for k in kinds]), (F.col("doc_id") % 16 + 1).cast("int")).alias("response_text"))


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events with gaps: every 7th row has no origin, every 5th no score."""
    return scored_events(spark, sf_dir).withColumns({
        "origin": F.when(F.col("row_id") % 7 != 0, F.col("origin")),
        "score": F.when(F.col("row_id") % 5 != 0, F.col("score")),
    })


def gappy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training history evaluated at odd epochs only; every 4th evaluation left no loss."""
    h = train_history(spark, sf_dir)
    return h.select("condition", (F.col("epoch") * 2 - 1).alias("epoch"), F.when(F.col("epoch") % 4 != 1, F.col("eval_loss")).alias("eval_loss"))


def edge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs whose source has edge blanks, or is empty for every 9th document."""
    d = docs_pairs(spark, sf_dir)
    return d.withColumn("src_text", F.when(F.col("ord") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(" \t"), "src_text", F.lit("  "))))


def faulty_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus with planted faults (synthetic are those with ``ord % 2 = 1``)."""
    d = docs_pairs(spark, sf_dir)
    n = F.col("ord")
    syn = n % 2 == 1
    own = F.col("text_id")
    lineage = F.when(n % 11 == 1, F.array(own)).when(n % 13 == 1, F.array(own, own)).when(n % 17 == 1, F.array(own, F.lit("nobody"))).otherwise(F.array(own, F.concat(own, F.lit(""), F.lit("x"))))
    return d.select(
        F.when(n % 19 == 3, F.lit("bad id")).when(n % 23 == 4, F.lit(None)).otherwise(own).alias("text_id"),
        F.when(n % 29 == 5, F.lit(" \t")).otherwise(F.col("src_text")).alias("src_text"),
        F.when(n % 31 == 6, F.lit(None)).otherwise(F.col("tgt_text")).alias("tgt_text"),
        F.when(n % 37 == 7, F.lit(None)).otherwise(F.col("origin")).alias("origin"),
        syn.alias("is_synthetic"),
        F.when(syn | (n % 41 == 8), lineage).alias("derived_from"),
        F.when(syn & (n % 43 != 9), n % 5).alias("seed_group"),
    )
