"""Corpus preparation as one plan: combine -> dedup -> shuffle -> exact splits.

The published corpus came out of these steps (four human sources combined,
deduplicated, shuffled, cut into four fixed-size splits); only the result was
published, so this is the rebuilt procedure with reproducible choices
(md5-seeded order, ``ceil`` sizes for all splits but the last).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import dedup, lineage, metrics, ranking
from tandem.schema import PAIR
from tandem.sinks.writers import land

SPLIT_FRACTION = 0.5  # share of the corpus that the published splits took
REST = "left_out"


@dataclass
class PreparedCorpus:
    combined: DataFrame
    deduped: DataFrame
    splits: DataFrame
    left_out: DataFrame
    breakdown: DataFrame
    crosstab: DataFrame
    checks: DataFrame


def combine(*corpora: DataFrame) -> DataFrame:
    """Union corpora in the pair schema (N4) with one file order: all rows of the
    first input, then the second, ... Each input's ``ord`` is moved past the
    largest one before it (one small aggregate per input, no shuffle); the
    result is an order key, not a dense index."""
    cols = [f.name for f in PAIR.fields]
    parts, offset = [], 0
    for c in corpora:
        parts.append(c.select((F.col("ord").cast("long") + F.lit(offset)).alias("ord"), *cols))
        top = c.agg(F.max("ord")).first()[0]
        offset += 0 if top is None else int(top) + 1
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def prepare(*corpora: DataFrame, seed: int | str = 42, sizes=None, out_dir: str | None = None,
            fraction: float = SPLIT_FRACTION) -> PreparedCorpus:
    """Combine, dedup on the target text (first wins), shuffle and split.

    The splits take ``fraction`` of the corpus (the published procedure took
    half) or the given sizes; ``left_out`` holds all other rows.

    With ``out_dir`` the splits are written partitioned by ``split`` (readers
    then prune to the split they need)."""
    combined = combine(*corpora)
    # Landed once: the split sizes need its row count and the split reads it
    # again; without landing, the dedup shuffle would run twice.
    deduped = land(dedup.dedup_first_wins(combined, key_col="tgt_text", order_col="ord"), "deduped")
    whole = ranking.exact_split(deduped, sizes=sizes, seed=seed, fraction=fraction, rest=REST)
    splits = whole.where(F.col("split") != REST)
    if out_dir is not None:
        splits.write.mode("overwrite").partitionBy("split").parquet(out_dir)
        splits = splits.sparkSession.read.parquet(out_dir)
    return PreparedCorpus(
        combined=combined,
        deduped=deduped,
        splits=splits,
        left_out=whole.where(F.col("split") == REST).drop("split"),
        breakdown=metrics.source_breakdown(deduped),
        crosstab=metrics.split_crosstab(splits),
        checks=lineage.split_checks(splits, deduped),
    )
