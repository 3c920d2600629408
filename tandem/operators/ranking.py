"""Order-dependent operators without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task.
The helpers here number rows globally in three distributed steps instead:
a bucket column that is monotone in the sort order, a row number inside each
bucket, and an exclusive prefix sum of the bucket sizes added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.constants import SPLIT_NAMES, SPLIT_WEIGHTS

# Buckets per prefix-sum block. Blocks are summed in one small window; a block
# holds at most this many buckets, so that window sees keys / 65,536 rows.
_BLOCK_BITS = 16


def hash_unit(expr: Column, hex_digits: int = 15) -> Column:
    """First ``hex_digits`` of md5 as a non-negative long (same in Spark and DuckDB)."""
    return F.conv(F.substring(F.md5(expr.cast("string")), 1, hex_digits), 16, 10).cast("long")


def exclusive_prefix_sum(counts: DataFrame, key: str, value: str, out: str, levels: int = 4) -> DataFrame:
    """``sum(value)`` over all rows with a smaller ``key`` (W2), for a distinct numeric key.

    Hierarchical so that no window holds more than 65,536 rows of the key
    space per task: keys are summed inside blocks of 2^16 keys (window
    partitioned by block), blocks inside super-blocks, and so on; the top level
    (``key >> 48`` with the default four levels) is summed in one unpartitioned
    window, so it holds at most 32,768 rows for any non-negative long key.
    """
    if levels <= 1:
        w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
    blk, tot, boff, ioff = (f"_blk{levels}", f"_tot{levels}", f"_boff{levels}", f"_ioff{levels}")
    c = counts.withColumn(blk, F.shiftright(F.col(key), _BLOCK_BITS))
    blocks = c.groupBy(blk).agg(F.sum(value).alias(tot))
    blocks = exclusive_prefix_sum(blocks, blk, tot, boff, levels - 1).select(blk, boff)
    w_in = Window.partitionBy(blk).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn(ioff, F.coalesce(F.sum(value).over(w_in), F.lit(0)))
    return c.join(blocks, blk).select(
        *counts.columns, (F.col(boff) + F.col(ioff)).cast("long").alias(out)
    )


def prefix_levels(key_bound: int | None) -> int:
    """Levels needed so that the top level of the prefix sum sees <= 65,536 keys."""
    if key_bound is None:
        return 4
    levels, span = 1, 1 << _BLOCK_BITS
    while key_bound >= span and levels < 4:
        levels, span = levels + 1, span << _BLOCK_BITS
    return levels


def global_index(
    df: DataFrame,
    order_cols: Sequence[Column | str],
    bucket: Column,
    out: str = "idx",
    base: int | Column = 0,
    key_bound: int | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order_cols`` order, plus ``base`` (H1).

    ``bucket`` must be a non-negative long that never decreases along the order
    (e.g. the leading md5 hex digits when ordering by md5, or ``batch_id`` when
    ordering by ``(batch_id, pos)``). ``key_bound`` (largest possible bucket
    value) lets the prefix sum use fewer levels; without it four levels cover
    any long key. AQE picks the join of rows and bucket offsets.
    """
    d = df.withColumn("_bkt", bucket)
    # Bucket sizes straight from the input: a column-pruned scan, a map-side
    # partial count and a shuffle of one row per bucket and map task.
    counts = d.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy("_bkt").orderBy(*order_cols)
    d = d.withColumn("_rn", F.row_number().over(w))
    offsets = exclusive_prefix_sum(counts, "_bkt", "_cnt", "_off", levels=prefix_levels(key_bound)).select("_bkt", "_off")
    base_col = base if isinstance(base, Column) else F.lit(base)
    return d.join(offsets, "_bkt").withColumn(
        out, (F.col("_off") + F.col("_rn") - 1 + base_col).cast("long")
    ).drop("_bkt", "_rn", "_off")


def first_n(df: DataFrame, n: int | None, order_col: str = "ord", dense: bool = False) -> DataFrame:
    """First ``n`` rows in ``order_col`` order (a distinct key); ``None`` or 0 means all (L1).

    ``dense=True`` says ``order_col`` is 0..N-1 (as landed by ingest): then a
    plain filter, which reaches the Parquet scan. Otherwise the ``n``-th
    smallest key (:func:`nth_key`, one row) filters the rows where they lie. No
    job runs while planning.
    """
    if n is None or n == 0:
        return df
    if n < 0:
        raise ValueError("limit must be >= 0")
    if dense:
        return df.where(F.col(order_col) < n)
    last = nth_key(df.select(F.col(order_col).cast("long").alias("_k")), n)
    bounded = df.crossJoin(F.broadcast(last))  # one row
    return bounded.where(F.col("_last").isNull() | (F.col(order_col) <= F.col("_last"))).drop("_last")


def nth_key(keys: DataFrame, n: int) -> DataFrame:
    """One row ``_last``: the ``n``-th smallest of the distinct long keys in ``_k``; null if there are fewer.

    Found digit by digit, 16 bits at a time from the top: every step counts the
    keys under the digits found so far (a partial aggregate of at most 65,536
    groups, whatever the number of keys), and the running count over these
    groups tells the next digit. No key is sorted or ranked.
    """
    left = F.lit(n).cast("long")
    spark = keys.sparkSession
    found = spark.range(1).select(F.lit(0).cast("long").alias("_prefix"), left.alias("_left"))
    for shift in (48, 32, 16, 0):
        top = shift == 48
        here = keys.crossJoin(F.broadcast(found))  # one row, or none once there are too few keys
        if not top:
            here = here.where(F.shiftright("_k", shift + _BLOCK_BITS) == F.col("_prefix"))
        counts = here.groupBy("_left", F.shiftright("_k", shift).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        hit = counts.where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
        found = hit.select("_prefix", (F.col("_left") - F.col("_before")).alias("_left"))
    return found.agg(F.max("_prefix").alias("_last"))


def shuffle_key(id_col: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def shuffle_order(df: DataFrame, seed: int | str = 42, id_col: str = "text_id", out: str = "ord",
                  tie_col: str | None = None) -> DataFrame:
    """Reproducible shuffle: new dense ``out`` in ``md5('seed:' || id)`` order.

    Buckets are the leading four hex digits (65,536 buckets, uniform by
    construction), so every bucket is about 1/65,536 of the data.
    """
    key = shuffle_key(id_col, seed)
    d = df.withColumn("_sk", key)
    # A total order keeps row numbers identical when a lost task is recomputed;
    # with repeated ids the incoming ord breaks the tie.
    if tie_col is None and "ord" in df.columns and out != "ord":
        tie_col = "ord"
    order = [F.col("_sk"), F.col(id_col)] + ([F.col(tie_col)] if tie_col else [])
    if out in d.columns:
        d = d.drop(out)
    bucket = F.conv(F.substring(F.col("_sk"), 1, 4), 16, 10).cast("long")
    return global_index(d, order, bucket, out=out, key_bound=(1 << 16) - 1).drop("_sk")


def split_sizes(total: int, weights: Sequence[int] = SPLIT_WEIGHTS, fraction: float = 0.5) -> list[int]:
    """Exact split sizes from a row count: all but the last are ``ceil(half * w / sum(w))``,
    the last takes the rest of ``floor(total * fraction)`` rows."""
    import math

    half = math.floor(total * fraction)
    s = sum(weights)
    sizes = [math.ceil(half * w / s) for w in weights[:-1]]
    return sizes + [half - sum(sizes)]


def exact_split(
    df: DataFrame,
    sizes: Sequence[int] | None = None,
    names: Sequence[str] = SPLIT_NAMES,
    seed: int | str = 42,
    id_col: str = "text_id",
    weights: Sequence[int] = SPLIT_WEIGHTS,
    fraction: float = 0.5,
    out: str = "split",
    rest: str | None = None,
) -> DataFrame:
    """Disjoint splits of exact sizes over the reproducible shuffle.

    Sizes are given, or derived from the row count (one small aggregate to the
    driver). Rows past the last split belong to no split: they are left out,
    or kept under the name ``rest``. Not ``randomSplit``: its sizes are only approximate.
    """
    shuffled = shuffle_order(df, seed=seed, id_col=id_col, out="_pos")
    if sizes is None:
        sizes = split_sizes(df.count(), weights, fraction)
    size_cols = [F.lit(int(x)) for x in sizes]
    bound = F.lit(0).cast("long")
    case = None
    for name, size in zip(names, size_cols):
        bound = bound + size
        cond = F.col("_pos") < bound
        case = F.when(cond, F.lit(name)) if case is None else case.when(cond, F.lit(name))
    if rest is not None:
        case = F.lit(rest) if case is None else case.otherwise(F.lit(rest))
    return shuffled.withColumn(out, case).where(F.col(out).isNotNull()).drop("_pos")
