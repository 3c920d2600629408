"""The corpus pipeline: quality filter, near-duplicate removal, source mixing, BPE ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

An empty table passes through every stage. Null texts count as empty: the
quality stage scores them by its bias, near-duplicate removal keeps them, the
mix takes nothing of them. Extra columns stay with their rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bpe, minhash, mixing, quality
from tandem.llm.tables import land

TOKENIZER = "byte_bpe_50k.json"


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows outside its held-out fold."""
    weight = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "_quality_score")
    return quality.score(docs, weight, score_col=score).filter(F.col(score) >= quality.ACCEPT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, as documents of the words that each pass takes."""
    return mixing.mixed_documents(docs, mixing.draw(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them."""
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded_col="decoded")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe", encode)]

# Trained, hashed and drawn stages: no SQL equivalent, tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
