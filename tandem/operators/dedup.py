"""First-wins deduplication on a normalized key (A1, A2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import norm_key


def dedup_first_wins(
    df: DataFrame,
    key_col: str = "tgt_text",
    order_col: str = "ord",
    normalizer: Callable[[Column], Column] = norm_key,
) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every normalized key (A1).

    The window is partitioned by the md5 of the key, not the key itself, so the
    shuffle key is 32 bytes however long the text is. The filter is exactly
    ``row_number() = 1``, so Catalyst puts a partial ``WindowGroupLimit``
    before the shuffle: a key held by a third of all rows leaves each map task
    as one row. Rows whose key is null are all kept (D2): each gets a key of
    its own, ``'null:' || ord``, which can never equal a 32-hex-digit md5.
    """
    h = F.coalesce(
        F.md5(normalizer(F.col(key_col))), F.concat(F.lit("null:"), F.col(order_col).cast("string"))
    )
    w = Window.partitionBy("_dk").orderBy(F.col(order_col))
    d = df.withColumn("_dk", h).withColumn("_rn", F.row_number().over(w))
    return d.where(F.col("_rn") == 1).drop("_dk", "_rn")


def dedup_counts(
    df: DataFrame,
    key_col: str = "tgt_text",
    normalizer: Callable[[Column], Column] = norm_key,
) -> DataFrame:
    """``total, kept, removed`` in one aggregation pass (A2).

    ``kept`` counts distinct non-null keys plus null-key rows (all kept).
    ``count_distinct`` plans a two-phase aggregate on the 32-byte key hash.
    """
    k = F.md5(normalizer(F.col(key_col)))
    agg = df.select(k.alias("_dk")).agg(
        F.count(F.lit(1)).alias("total"),
        (F.count_distinct("_dk") + F.count_if(F.col("_dk").isNull())).alias("kept"),
    )
    return agg.select(
        F.col("total").cast("long"),
        F.col("kept").cast("long"),
        (F.col("total") - F.col("kept")).cast("long").alias("removed"),
    )
