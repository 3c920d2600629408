"""Prompt and training-text rendering (P1-P5, U3, T1, T2). All built-in expressions,
but for a caller's subword tokenizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.constants import (
    FEWSHOT_EXAMPLE_FORMAT,
    FEWSHOT_TEMPLATE,
    MAX_SEQ_TOKENS,
    RESPONSE_TEMPLATE,
    TRAIN_TARGET_PREFIX,
    ZERO_SHOT_PREFIX,
)
from tandem.functions.text import n_tokens, subword_truncate, truncate_tokens


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def zero_shot_prompt(src, prefix: str = ZERO_SHOT_PREFIX) -> Column:
    """``Translate the following from Luganda to English: {src}``."""
    return F.concat(F.lit(prefix), _c(src))


def model_prompts(df: DataFrame, templates: DataFrame, model_col: str = "model", src_col: str = "src_text",
                  out_col: str = "prompt") -> DataFrame:
    """Add each row's prompt by its model's template (U3): ``templates`` holds ``model,
    template`` with ``{source}`` where the source goes; a model without one gets
    the zero-shot prompt. A join on the model key, sized by AQE."""
    t = templates.select(F.col("model").alias(model_col), F.col("template").alias("_template"))
    filled = F.replace(F.col("_template"), F.lit("{source}"), F.col(src_col))
    return df.join(t, model_col, "left").withColumn(out_col, F.coalesce(filled, zero_shot_prompt(src_col))).drop("_template")


def tuned_prompt(src, prefix: str = ZERO_SHOT_PREFIX, response_template: str = RESPONSE_TEMPLATE) -> Column:
    """P1 text followed by ``\\nEnglish:`` with no trailing space."""
    return F.concat(F.lit(prefix), _c(src), F.lit(response_template))


def training_text(src, tgt, eos_token: str = "", prefix: str = ZERO_SHOT_PREFIX) -> Column:
    """``...: {src}\\nEnglish: {tgt}{eos}``."""
    return F.concat(F.lit(prefix), _c(src), F.lit(TRAIN_TARGET_PREFIX), _c(tgt), F.lit(eos_token))


def completion_split(text, response_template: str = RESPONSE_TEMPLATE) -> tuple[Column, Column]:
    """``(prompt, completion)``: split after the LAST occurrence of the response
    template (P4). Text without the template gets a null completion."""
    import re

    pat = "(?s)^(.*" + re.escape(response_template).replace("\\\n", "\\n") + ")(.*)$"
    t = _c(text)
    has = t.rlike(pat)
    return (
        F.when(has, F.regexp_extract(t, pat, 1)),
        F.when(has, F.regexp_extract(t, pat, 2)),
    )


def sft_dataset(
    pairs: DataFrame,
    eos_token: str = "",
    max_tokens: int = MAX_SEQ_TOKENS,
    limit: int | None = None,
    src_col: str = "src_text",
    tgt_col: str = "tgt_text",
    order_col: str = "ord",
    make_encoder: Callable | None = None,
) -> DataFrame:
    """Training rows: first ``limit`` pairs -> training text -> token cap -> prompt /
    completion split (T2). Tokens are those of white space, or with ``make_encoder``
    a subword tokenizer's (:func:`tandem.functions.text.subword_truncate`); ``n_tokens``
    counts those that the cap leaves."""
    from tandem.operators.ranking import first_n

    d = first_n(pairs, limit, order_col=order_col)
    text = training_text(src_col, tgt_col, eos_token)
    if make_encoder is None:
        d = d.withColumn("text", truncate_tokens(text, max_tokens))
        kept = n_tokens("text")
    else:
        # one projection for the cut, so the tokenizer runs once a row
        d = d.withColumn("_cut", subword_truncate(text, make_encoder, max_tokens)).withColumn("text", F.col("_cut.text"))
        kept = F.least(F.col("_cut.n_tokens"), F.lit(max_tokens).cast("long"))
    prompt, completion = completion_split(F.col("text"))
    return d.select("text_id", "text", kept.alias("n_tokens"), prompt.alias("prompt"), completion.alias("completion"))


def fewshot_prompts(
    sample: DataFrame,
    plan: DataFrame,
    src_col: str = "src_text",
    tgt_col: str = "tgt_text",
    template: str = FEWSHOT_TEMPLATE,
    example_format: str = FEWSHOT_EXAMPLE_FORMAT,
) -> DataFrame:
    """``batch_id, n_examples, requested, prompt`` (P5).

    ``sample``: ``batch_id, rank, src, tgt`` of the examples; ``plan``:
    ``batch_id, requested``. Examples are grouped per batch (at most ``k``
    rows per group), ordered by rank and joined by newlines.
    """
    lines = sample.select("batch_id", "rank", F.format_string(example_format, F.col(tgt_col), F.col(src_col)).alias("line"))
    g = lines.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    g = g.select(
        "batch_id",
        F.size("_l").cast("long").alias("n_examples"),
        F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("block"),
    )
    d = g.join(plan, "batch_id")
    return d.select(
        "batch_id",
        "n_examples",
        "requested",
        F.format_string(template, F.col("n_examples"), F.col("block"), F.col("requested")).alias("prompt"),
    )
