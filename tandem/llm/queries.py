"""Registered queries of the operators, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bpe, embed, minhash, mixing, packing, prefix_trie, quality, runs, spotsigs, suffix_lm, token_counts, warc, wavelet
from tandem.llm.tables import land
from tandem.session import landing_path

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing_path(spark, "token_shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return wavelet.read_documents(spark, path, with_ids=False)


def ids_text(ids_col: str) -> Column:
    """Decimal ids joined by commas, as one text per row: no string per id on the heap."""
    return F.btrim(F.to_json(ids_col), F.lit("[]"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(land(warc.read_records(spark, path, with_payload=False), "warc_records"))
    return captures.select(
        F.col("capture.page_id").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("refers_to"),
        F.col("request.url").alias("requested_url"),
        F.col("metadata.fetched_bytes").alias("fetched_bytes"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.draw(table(spark, sf_dir, "documents")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weight = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), weight)
    return scored.select(
        "doc_id",
        (quality.fold() == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing_path(spark, "sequences")
    packing.write_sequences(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=0)
    pieces = packing.read_sequences(spark, path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_repeated_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), F.array_join(lines, "").alias("lines"), runs.longest_by_period(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_wavelet_shards, op2_bpe, op3_minhash, op4_warc, op5_mixing, op6_embedding_dedup, op7_suffix_tree, op8_token_counts, op9_spotsigs, op10_quality, op11_prefix_trie, op12_packing, op13_periodic_runs)}
