"""Mixing sources to target weights over fixed-length token blocks.

The words of each source form one stream (documents in an order fixed by
their hash bucket and id), cut into blocks of ``block`` words. Targets follow
weights, capped at a number of passes over the source, the excess reshared.
For every output shard a multinomial draw gives the blocks per source, with
the blocks still owed as odds, so the draws add up to the targets: the shards
are halved again and again, and at every halving a draw says how many of each
source's blocks the left half gets, so any task finds the draw of its shards by
itself. The n-th block drawn from a source is the block at index n mod size under that pass's
pseudorandom permutation (a Feistel network, walked until inside the range).
Slots and blocks meet by a join on (source, index).

Only one row per source passes through the driver.
Results by case: null text has no words; null sources are one source, last; a
source or table without words takes nothing; rows that share an id or repeat
are counted row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm import textops as tx
from tandem.llm.tables import land

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 64
SLOTS_PER_SHARD = 1 << 14
BUCKETS = 512


@dataclass
class Mix:
    """A drawn mix: placed documents, per-source plan rows, and slots (shard, src, pass, block)."""

    placed: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def targets(sizes: list[int], weights: list[float], share: float, passes: float) -> list[float]:
    """``share`` of all sizes by weight, none above ``passes`` times its size; what is cut off goes to the others by weight."""
    out = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    left = share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > passes * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _drawn(rng: np.random.Generator, n: int, owed: np.ndarray) -> np.ndarray:
    """``n`` multinomial draws with the blocks still owed as odds, no source drawn beyond them."""
    got = np.zeros_like(owed)
    while n:
        room = owed - got
        draw = np.minimum(rng.multinomial(n, room / room.sum()), room)
        got += draw
        n -= int(draw.sum())
    return got


def shard_draws(quota: np.ndarray, slots_per_shard: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) of the shards low..high-1.

    A shard's draw follows from the quota and the seed alone, by one draw for every halving above it.
    """
    shards = -(-int(quota.sum()) // slots_per_shard)
    high = shards if high is None else min(high, shards)

    def halve(a: int, b: int, before: np.ndarray, owed: np.ndarray):
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, before, owed
            return
        mid = (a + b) // 2
        left = _drawn(np.random.default_rng([seed, a, b]), (mid - a) * slots_per_shard, owed)
        yield from halve(a, mid, before, left)
        yield from halve(mid, b, before + left, owed - left)

    if shards:
        yield from halve(0, shards, np.zeros(len(quota), dtype=np.int64), quota.astype(np.int64))


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) applied to ``index``: four Feistel rounds, walked back into the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            salt = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (tx.mix(right + salt) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _slots(quota: np.ndarray, blocks: list[int], slots_per_shard: int, seed: int):
    """Shard numbers to the slots of each (at most ``slots_per_shard``): every task draws for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for _, first, count in shard_draws(quota, slots_per_shard, seed, shard, shard + 1):
                    for src in np.flatnonzero(count).tolist():
                        n = np.arange(first[src], first[src] + count[src])
                        turn, at = n // blocks[src], n % blocks[src]
                        for t in np.unique(turn).tolist():
                            here = turn == t
                            at[here] = permute(at[here], blocks[src], (seed * 1_000_003 + src) * 64 + t)
                        k = len(n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard)), pa.array(np.full(k, src)), pa.array(turn), pa.array(at)], names=["shard", "src", "turn", "block"])

    return run


def _place(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every row with its size and its offset in its (source, bucket); all columns of ``docs`` stay."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, source_col, text_col)])
    sized = docs.select("*", F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("_mix_size"), key.alias("_mix_key"))
    sized = sized.withColumn("_mix_bucket", F.pmod("_mix_key", F.lit(BUCKETS)).cast("int"))
    before = W.partitionBy(F.col(f"`{source_col}`"), "_mix_bucket").orderBy(F.col(f"`{id_col}`"), "_mix_key").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("_mix_before", F.coalesce(F.sum("_mix_size").over(before), F.lit(0)))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, source_col, text_col)])
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), key.alias("key"))
    d = d.withColumn("bucket", F.pmod("key", F.lit(BUCKETS)).cast("int"))
    before = W.partitionBy("source", "bucket").orderBy("doc_id", "key").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, passes: float = 2.0, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 7) -> Mix:
    """Place the documents, draw the shards and list the slots."""
    spark = docs.sparkSession
    placed = land(_narrow(docs, id_col, text_col, source_col), "mix_docs")
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    per_source = {r.source: r.size for r in totals.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted(per_source, key=lambda s: (s is None, s or ""))
    sizes = [per_source[s] for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, passes)
    blocks = [-(-n // block) for n in sizes]
    quota = np.array([min(int(passes * b), round(t * b / n)) if n else 0 for t, b, n in zip(goal, blocks, sizes)], dtype=np.int64)
    plan = spark.createDataFrame(
        [(i, s, n, t, b) for i, (s, n, t, b) in enumerate(zip(names, sizes, goal, blocks))],
        f"src long, source {placed.schema['source'].dataType.simpleString()}, source_size long, target double, blocks long",
    )
    start = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    start = totals.select("source", "bucket", F.coalesce(F.sum("size").over(start), F.lit(0)).alias("bucket_start"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    start = start.join(plan, same(start, plan)).select("src", start["source"].alias("source"), "bucket", "bucket_start", "source_size", "target", "blocks")
    start = land(start, "mix_sources")
    shards = -(-int(quota.sum()) // slots_per_shard)
    # some dozen shards (a million slots) a task
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 64))))
    slots = spark.range(0, shards, 1, tasks).mapInArrow(_slots(quota, blocks, slots_per_shard, seed), "shard long, src long, turn long, block long")
    return Mix(placed, start, slots, block)


def _located(placed: DataFrame, sources: DataFrame, source: str, bucket: str) -> DataFrame:
    s = sources.withColumnsRenamed({"source": "_src_name", "bucket": "_src_bucket"})
    return placed.join(s, placed[f"`{source}`"].eqNullSafe(s["_src_name"]) & (placed[bucket] == s["_src_bucket"])).drop("_src_name", "_src_bucket")


def pieces(mix: Mix) -> DataFrame:
    """(src, block, start, lo, hi): words lo..hi of the document at ``start`` of its source lie in the block."""
    d = _located(mix.placed.filter("size > 0"), mix.sources, "source", "bucket").select("src", (F.col("bucket_start") + F.col("before")).alias("start"), "size")
    b = F.lit(mix.block)
    d = d.select("src", "start", "size", F.explode(F.sequence(F.expr(f"start div {mix.block}"), F.expr(f"(start + size - 1) div {mix.block}"))).alias("block"))
    lo = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    hi = F.least(F.col("block") * b + b - F.col("start"), F.col("size"))
    return d.select("src", "block", "start", lo.alias("lo"), hi.alias("hi"))


def taken(mix: Mix) -> DataFrame:
    """Per document row: doc_id, size, source_size, target (its source's) and taken, the words that the mix takes of it."""
    # slots come from a small table of draws, whose size says nothing about theirs: never broadcast them
    uses = mix.slots.groupBy("src", "block").agg(F.count("*").alias("uses"))
    words = pieces(mix).hint("merge").join(uses, ["src", "block"]).groupBy("src", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
    d = _located(mix.placed, mix.sources, "source", "bucket").withColumn("start", F.col("bucket_start") + F.col("before"))
    # a document without words shares its offset with the next one
    d = d.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    w = words.withColumnsRenamed({"start": "at"})
    return d.hint("merge").join(w, ["src", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The mix as documents: for every pass, the words taken of each document, with all other columns unchanged.

    A document taken whole keeps its text as it is; of others the taken words
    are joined by single blanks. The length column, if there is one, follows.
    """
    cols = docs.columns
    # columns by number, so that none can clash with those made here
    kind = docs.schema
    docs = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    id_col, text_col, source_col, length_col = (f"c{cols.index(c)}" if c in cols else c for c in (id_col, text_col, source_col, length_col))
    drawn = pieces(mix).hint("merge").join(mix.slots, ["src", "block"]).groupBy("src", "start", "turn").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_mix_spans"), F.sum(F.col("hi") - F.col("lo")).alias("_mix_taken")
    )
    drawn = drawn.withColumnsRenamed({"src": "_mix_src", "start": "_mix_start", "turn": "_mix_turn"})
    s = mix.sources.select(F.col("source").alias("_mix_source"), F.col("bucket").alias("_mix_b"), F.col("src").alias("_mix_own"), F.col("bucket_start").alias("_mix_offset"))
    placed = _place(docs, id_col, text_col, source_col).filter("_mix_size > 0")
    placed = placed.join(s, F.col(f"`{source_col}`").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bucket") == F.col("_mix_b")))
    rows = placed.hint("merge").join(drawn, (F.col("_mix_own") == F.col("_mix_src")) & (F.col("_mix_offset") + F.col("_mix_before") == F.col("_mix_start")))
    words = F.expr(f"regexp_extract_all(`{text_col}`, '({WORD.replace(chr(92), chr(92) * 2)})', 1)")
    # the outer transform binds the words once for all spans
    cut = lambda w: F.concat_ws(" ", F.flatten(F.transform("_mix_spans", lambda x: F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))))
    part = F.transform(F.array(words), cut)[0]
    text = F.when(F.col("_mix_taken") == F.col("_mix_size"), F.col(f"`{text_col}`")).otherwise(part)
    out = rows.withColumn(text_col, text)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns).toDF(*kind.names)
