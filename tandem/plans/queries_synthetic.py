"""Registered queries: prompts, sampling, reply ingestion, synthetic records, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.constants import ID_FORMAT_1X, ID_FORMAT_5X, MAX_INPUT_TOKENS_ZERO_SHOT
from tandem.functions.replies import with_reply_pairs
from tandem.functions.text import n_tokens, truncate_tokens
from tandem.operators import lineage, prompts, replies, sampling
from tandem.plans import synthetic
from tandem.plans.queries import query
from tandem.session import ensure_conf
from tandem.sources import bindings as B

EOS = "</s>"


def _docs_run(spark, sf_dir):
    seeds = B.docs_pairs(spark, sf_dir)
    return synthetic.plan_requests(spark, seeds, multiplier=1, seed=42)


def _docs_ingest(spark, sf_dir):
    run = _docs_run(spark, sf_dir)
    return synthetic.ingest_replies(run, B.responses(spark, sf_dir), id_format=ID_FORMAT_1X)


@query("batch_plan")
def q_batch_plan(spark, sf_dir):
    total = B.docs_pairs(spark, sf_dir).count()
    return sampling.batch_plan(spark, total)


@query("fewshot_sample")
def q_fewshot_sample(spark, sf_dir):
    return _docs_run(spark, sf_dir).sample.select("batch_id", "rank", "text_id")


@query("fewshot_prompt")
def q_fewshot_prompt(spark, sf_dir):
    seeds = B.chat_pairs(spark, sf_dir)
    run = synthetic.plan_requests(spark, seeds, multiplier=1, seed=42)
    return run.prompts.select("batch_id", "n_examples", "requested", F.md5("prompt").alias("prompt_md5"))


@query("zero_shot_prompt")
def q_zero_shot_prompt(spark, sf_dir):
    p = B.chat_pairs(spark, sf_dir)
    return p.select("text_id", prompts.zero_shot_prompt("src_text").alias("text"))


@query("tuned_prompt")
def q_tuned_prompt(spark, sf_dir):
    p = B.chat_pairs(spark, sf_dir)
    return p.select("text_id", prompts.tuned_prompt("src_text").alias("text"))


@query("training_text")
def q_training_text(spark, sf_dir):
    p = B.chat_pairs(spark, sf_dir)
    return p.select("text_id", prompts.training_text("src_text", "tgt_text", EOS).alias("text"))


@query("completion_split")
def q_completion_split(spark, sf_dir):
    p = B.chat_pairs(spark, sf_dir)
    pr, comp = prompts.completion_split(prompts.training_text("src_text", "tgt_text", EOS))
    return p.select("text_id", pr.alias("prompt"), comp.alias("completion"))


@query("truncate_tokens")
def q_truncate_tokens(spark, sf_dir):
    p = B.chat_pairs(spark, sf_dir)
    t = truncate_tokens(prompts.zero_shot_prompt("src_text"), MAX_INPUT_TOKENS_ZERO_SHOT)
    return p.select("text_id", t.alias("text")).withColumn("n_tokens", n_tokens("text"))


@query("sft_dataset")
def q_sft_dataset(spark, sf_dir):
    return prompts.sft_dataset(B.chat_pairs(spark, sf_dir), eos_token=EOS)


def subword_encoder():
    """Character offsets of a public byte-level tokenizer's tokens (stand-in for the model's own)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).offsets


@query("sft_subword")
def q_sft_subword(spark, sf_dir):
    """Training rows cut after 64 subword tokens instead of words."""
    return prompts.sft_dataset(B.chat_pairs(spark, sf_dir), eos_token=EOS, max_tokens=64, make_encoder=subword_encoder)


@query("reply_pairs")
def q_reply_pairs(spark, sf_dir):
    ensure_conf(spark)
    a = replies.classify_attempts(B.responses(spark, sf_dir))
    return replies.accepted_pairs(a)


@query("attempt_status")
def q_attempt_status(spark, sf_dir):
    ensure_conf(spark)
    a = replies.classify_attempts(B.responses(spark, sf_dir))
    return a.select("batch_id", F.col("attempt").cast("long").alias("attempt"), "status", "n_valid", "used")


@query("batch_status")
def q_batch_status(spark, sf_dir):
    ensure_conf(spark)
    plan = sampling.batch_plan(spark, B.docs_pairs(spark, sf_dir).count())
    # batch 2 gets no reply at all: it is pending
    attempts = replies.classify_attempts(B.responses(spark, sf_dir).where("batch_id <> 2"))
    return replies.batch_status(attempts, plan=plan)


@query("batch_shortfall")
def q_batch_shortfall(spark, sf_dir):
    return synthetic.shortfall(_docs_ingest(spark, sf_dir))


def records_out(df):
    return df.select(
        "text_id", "src_text", "tgt_text", "origin", "is_synthetic",
        F.col("seed_group").cast("long").alias("seed_group"),
        F.size("derived_from").cast("long").alias("n_sources"),
    )


@query("synthetic_records")
def q_synthetic_records(spark, sf_dir):
    return records_out(_docs_ingest(spark, sf_dir).final)


@query("synthetic_numbered")
def q_synthetic_numbered(spark, sf_dir):
    """Records before the final dedup: every accepted pair numbered."""
    return records_out(_docs_ingest(spark, sf_dir).records)


@query("resume_pending")
def q_resume_pending(spark, sf_dir):
    """Batches still to do after a first pass that landed only first-attempt successes."""
    run = _docs_ingest(spark, sf_dir)
    first_pass = run.attempts.where(F.col("used") & (F.col("attempt") == 1))
    return synthetic.pending_batches(run.plan, first_pass, batch_col="batch_id").select("batch_id")


@query("synthetic_5x")
def q_synthetic_5x(spark, sf_dir):
    """A resumed production run: half as many records as documents exist already, the
    target is 1.2 times the documents, so the last accepted pairs are cut (W1, L4);
    six-digit ids. Every reply is delivered twice."""
    seeds = B.docs_pairs(spark, sf_dir)
    n = seeds.count()
    run = synthetic.plan_requests(spark, seeds, seed=42, total=n * 6 // 5)
    twice = B.responses(spark, sf_dir)
    synthetic.ingest_replies(run, twice.unionByName(twice), id_format=ID_FORMAT_5X, base=n // 2)
    return records_out(run.records)


@query("reply_edges")
def q_reply_edges(spark, sf_dir):
    """One reply per whole document in sixteen kinds: duplicate keys, typed values, non-objects,
    edge blanks, fences, no valid pair, trailing text with a sentinel-like element,
    no array, nested values, very long whole numbers, bare infinities (J1, J2, J4, F1-F3, X2)."""
    ensure_conf(spark)
    parsed = with_reply_pairs(B.edge_replies(spark, sf_dir), "response_text", "pairs")
    return parsed.select(
        "doc_id", F.coalesce(F.size("pairs"), F.lit(-1)).cast("long").alias("n_pairs"),
        F.get("pairs", F.lit(0))["pos"].cast("long").alias("pos"), F.md5(F.get("pairs", F.lit(0))["src"]).alias("src_md5"),
        F.get("pairs", F.lit(0))["tgt"].alias("tgt"),
    )


@query("lineage_seeds")
def q_lineage_seeds(spark, sf_dir):
    return lineage.lineage_edges(_docs_ingest(spark, sf_dir).final)


@query("seed_usage")
def q_seed_usage(spark, sf_dir):
    return lineage.seed_usage(_docs_ingest(spark, sf_dir).final)


@query("copied_examples")
def q_copied_examples(spark, sf_dir):
    run = _docs_ingest(spark, sf_dir)
    return lineage.copied_examples(run.final, B.docs_pairs(spark, sf_dir))
